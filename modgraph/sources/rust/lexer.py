"""Rust text to token trees.

A token is (kind, text, line, joint): kind "i" for names and keywords, "p" for one sign, "l" for literals, "t" for
lifetimes; joint tells that a sign follows a sign at once. Bracketed tokens are a Group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

SPACE = re.compile(r"\s+|//[^\n]*")
NAME = re.compile(r"(?:r#)?[^\W\d]\w*")
STRING = re.compile(r'[bc]?"(?:[^"\\]|\\.)*"', re.S)
RAW = re.compile(r'[bc]?r(#*)"')
CHAR = re.compile(r"b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])'", re.S)
LIFETIME = re.compile(r"'[^\W\d]\w*")
NUMBER = re.compile(r"\d[\w]*(?:\.(?!\.)\d[\w]*|\.(?![.\w]))?(?:(?<=[eE])[+-]\d\w*)?")
SIGNS = "!#$%&*+,-./:;<=>?@^|~"
CLOSE = {"(": ")", "[": "]", "{": "}"}


class LexError(ValueError):
    """A text that is no sequence of Rust tokens."""


class Token(NamedTuple):
    kind: str
    text: str
    line: int = 0
    joint: bool = False


@dataclass
class Group:
    """Tokens within brackets."""

    open: str
    body: list
    line: int = 0
    kind: str = "g"
    text: str = ""


def token_trees(text: str) -> list:
    """All tokens of a file; LexError where brackets or quotes do not close."""
    text = text.removeprefix("﻿")
    if text.startswith("#!") and not text.startswith("#!["):
        text = "//" + text
    stack: list[Group] = []
    out: list = []
    at, n, line = 0, len(text), 1
    while at < n:
        c = text[at]
        start = at
        if m := SPACE.match(text, at):
            at = m.end()
        elif text.startswith("/*", at):
            depth, at = 1, at + 2
            while depth:
                m = re.compile(r"/\*|\*/").search(text, at)
                if not m:
                    raise LexError(f"unterminated block comment at line {line}")
                depth += 1 if m[0] == "/*" else -1
                at = m.end()
        elif m := RAW.match(text, at):
            end = text.find('"' + m[1], m.end())
            if end < 0:
                raise LexError(f"unterminated raw string at line {line}")
            at = end + 1 + len(m[1])
            out.append(Token("l", '"', line))
        elif m := STRING.match(text, at):
            at = m.end()
            out.append(Token("l", '"', line))
        elif c == '"':
            raise LexError(f"unterminated string at line {line}")
        elif m := CHAR.match(text, at):
            at = m.end()
            out.append(Token("l", "'", line))
        elif m := LIFETIME.match(text, at):
            at = m.end()
            out.append(Token("t", m[0], line))
        elif m := NAME.match(text, at):
            at = m.end()
            out.append(Token("i", m[0].removeprefix("r#"), line))
        elif m := NUMBER.match(text, at):
            at = m.end()
            out.append(Token("l", "0", line))
        elif c in CLOSE:
            at += 1
            stack.append(Group(c, out, line))
            out = []
        elif c in ")]}":
            at += 1
            if not stack or CLOSE[stack[-1].open] != c:
                raise LexError(f"unexpected closing delimiter `{c}` at line {line}")
            group = stack.pop()
            out, group.body = group.body, out
            out.append(group)
        elif c in SIGNS:
            at += 1
            out.append(Token("p", c, line, at < n and text[at] in SIGNS))
        else:
            raise LexError(f"unexpected character {c!r} at line {line}")
        line += text.count("\n", start, at)
    if stack:
        raise LexError(f"unclosed delimiter `{stack[-1].open}` of line {stack[-1].line}")
    return out
