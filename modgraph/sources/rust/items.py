"""Token trees to rows: declared modules, named items and raw references of one file.

References are read without knowing any module: their first names are judged later, as relations. What depends on order,
the imports that a path inside a macro may go through, is settled here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from modgraph.sources.rust.lexer import Group, LexError, Token, token_trees

KEYWORDS = frozenset(
    "as async await break const continue dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct trait true type unsafe use where while yield".split()
)
PATH_KEYWORDS = ("crate", "self", "super")
#: The name after one of these is declared, not used.
DECLARES = frozenset("fn struct enum trait type const static mod let mut ref union for".split())
NAMED = {"const": "const", "enum": "enum", "fn": "fn", "mod": "mod", "static": "static", "struct": "struct", "trait": "trait", "type": "type", "union": "union"}


@dataclass
class Reference:
    """kind: use, path, macro or token; prefix: none, crate, self or super with levels; suffix: none, alias, glob, group."""

    kind: str
    prefix: str
    levels: int
    segments: list[str]
    suffix: str = "none"
    suffix_text: str = ""
    #: what a declaration stands for, item by item: names, whether a glob, and the group that a glob in a group keeps
    leaves: list[tuple[list[str], bool, str]] = field(default_factory=list)
    #: for tokens whose first name is imported: where the import leads
    via: tuple[str, int, list[str]] | None = None


@dataclass
class Scope:
    """What one module of a file holds; path: its inline place in the file."""

    path: tuple[str, ...]
    modules: list[tuple[str, str, str, bool, bool]] = field(default_factory=list)  # name, vis, vis path, test, has body
    items: list[tuple[str, str, str, str]] = field(default_factory=list)  # name, kind, vis, vis path
    references: list[Reference] = field(default_factory=list)
    imports: dict[str, tuple[str, int, list[str]]] = field(default_factory=dict)


def parse_file(text: str, package: str | None = None) -> list[Scope]:
    """The scopes of a file, outermost first; LexError if it is no Rust."""
    scopes: list[Scope] = []
    _Body(scopes, package).module(token_trees(text), ())
    return scopes


def token_paths(text: str) -> list[str]:
    """Paths of two or more names in a stream of tokens, as a macro's arguments are scanned; LexError if it is none."""
    body = _Body([], None)
    body.tokens(token_trees(text))
    starts = {"none": "", "crate": "crate::", "self": "self::"}
    return [starts.get(r.prefix, "super::" * r.levels) + "::".join(r.segments) for r in body.scope.references]


def is_sign(tokens: list, at: int, text: str) -> bool:
    return 0 <= at < len(tokens) and tokens[at].kind == "p" and tokens[at].text == text


def is_name(tokens: list, at: int, *text: str) -> bool:
    return 0 <= at < len(tokens) and tokens[at].kind == "i" and (not text or tokens[at].text in text)


def is_group(tokens: list, at: int, opening: str = "([{") -> bool:
    return 0 <= at < len(tokens) and tokens[at].kind == "g" and tokens[at].open in opening


def is_sep(tokens: list, at: int) -> bool:
    """A path separator."""
    return is_sign(tokens, at, ":") and tokens[at].joint and is_sign(tokens, at + 1, ":")


def mentions_test(tokens: list) -> bool:
    """Whether ``test`` stands in the condition of a cfg, outside of ``not(...)``."""
    at = 0
    while at < len(tokens):
        if is_name(tokens, at, "test"):
            return True
        if is_name(tokens, at, "not") and is_group(tokens, at + 1):
            at += 1
        elif is_group(tokens, at) and mentions_test(tokens[at].body):
            return True
        at += 1
    return False


def after_angles(tokens: list, at: int) -> int:
    """The place after the angle brackets that open at ``at``, or ``at`` if they do not close like generics."""
    depth, i = 0, at
    while i < len(tokens):
        if is_sign(tokens, i, "<"):
            depth += 1
        elif is_sign(tokens, i, ">") and not (is_sign(tokens, i - 1, "-") or is_sign(tokens, i - 1, "=")):
            depth -= 1
            if not depth:
                return i + 1
        elif is_sign(tokens, i, ";") or is_group(tokens, i, "{"):
            break
        i += 1
    return at


def keyword_prefix(names: list[str]) -> tuple[str, int, list[str]]:
    """Prefix, levels and names of a path as an expression or type has it: ``super`` counts wherever it stands."""
    prefix, levels, rest = "none", 0, []
    for i, name in enumerate(names):
        if i == 0 and name in ("crate", "self"):
            prefix = name
        elif name == "super":
            levels = levels + 1 if prefix == "super" else 1
            prefix = "super"
        else:
            rest.append(name)
    return prefix, levels, rest


class _Body:
    def __init__(self, scopes: list[Scope], package: str | None):
        self.scopes, self.package = scopes, package
        self.scope = Scope(())

    # ---- items

    def module(self, tokens: list, path: tuple[str, ...]) -> None:
        outer, self.scope = self.scope, Scope(path)
        self.scopes.append(self.scope)
        at = 0
        while at < len(tokens):
            at = self.item(tokens, at)
        self.scope = outer

    def item(self, tokens: list, at: int) -> int:
        """Read one item of a module; the place behind it."""
        start, attributes = at, []
        while is_sign(tokens, at, "#"):
            at += 1 + is_sign(tokens, at + 1, "!")
            if not is_group(tokens, at, "["):
                raise LexError(f"expected an attribute at line {tokens[start].line}")
            attributes.append(tokens[at].body)
            at += 1
        if at >= len(tokens):
            self.attributes(attributes)
            return at
        (vis, vis_path), at = self.visibility(tokens, at)
        while is_name(tokens, at, "unsafe", "async", "default", "auto") and (is_name(tokens, at + 1) or tokens[at + 1 : at + 2] and tokens[at + 1].kind == "l"):
            at += 1
        if is_name(tokens, at, "const") and is_name(tokens, at + 1, "fn", "unsafe", "async", "extern"):
            at += 1
            while is_name(tokens, at, "unsafe", "async"):
                at += 1
        if is_name(tokens, at, "extern") and is_name(tokens, at + 1, "crate"):
            self.attributes(attributes)
            end = self.until(tokens, at, ";")
            self.scope.items.append((tokens[at + 2].text, "extern crate", vis, vis_path))
            return end
        if is_name(tokens, at, "extern"):
            at += 1
            if at < len(tokens) and tokens[at].kind == "l":
                at += 1
            if is_group(tokens, at, "{"):
                self.attributes(attributes)
                self.code(tokens[at].body)
                return at + 1
        word = tokens[at].text if is_name(tokens, at) else ""
        if word == "use":
            end = self.until(tokens, at, ";")
            self.use(tokens[at + 1 : end - 1], vis, vis_path)
            return end
        if word == "mod" and is_name(tokens, at + 1):
            name = tokens[at + 1].text
            test = any(is_name(a, 0, "cfg") and is_group(a, 1) and mentions_test(a[1].body) for a in attributes)
            body = is_group(tokens, at + 2, "{")
            if not body and not is_sign(tokens, at + 2, ";"):
                raise LexError(f"expected `;` or `{{` at line {tokens[at].line}")
            self.scope.modules.append((name, vis, vis_path, test, body))
            self.scope.items.append((name, "mod", vis, vis_path))
            if body:
                self.module(tokens[at + 2].body, (*self.scope.path, name))
            return at + 3
        self.attributes(attributes)
        if word in NAMED and (is_name(tokens, at + 1) or is_sign(tokens, at + 1, "_")):
            name = tokens[at + 1 + is_name(tokens, at + 1, "mut")].text
            end = self.until(tokens, at, ";" if word in ("const", "static", "type") else ";{", word == "struct")
            self.scope.items.append((name, NAMED[word], vis, vis_path))
            self.code(tokens[at:end], word)
            return end
        if word == "impl":
            end = self.until(tokens, at, "{")
            self.code(tokens[at:end], word)
            return end
        if is_sign(tokens, at, ";"):
            return at + 1
        end = at
        while end < len(tokens) and not is_sign(tokens, end, "!"):
            if not (is_name(tokens, end) or is_sign(tokens, end, ":")):
                raise LexError(f"expected an item at line {tokens[end].line}")
            end += 1
        end += 1 + is_name(tokens, end + 1)
        if not is_group(tokens, end):
            raise LexError(f"expected an item at line {tokens[start].line}")
        self.code(tokens[at : end + 1])
        return end + 1 + is_sign(tokens, end + 1, ";")

    def until(self, tokens: list, at: int, ends: str, tuple_struct: bool = False) -> int:
        """The place behind the sign or the braces that end an item."""
        i = at
        while i < len(tokens):
            if tokens[i].kind == "p" and tokens[i].text in ends:
                return i + 1
            if is_group(tokens, i, "{") and "{" in ends and not is_sign(tokens, i - 1, "="):
                return i + 1
            i += 1
        raise LexError(f"an item does not end after line {tokens[at].line}")

    def visibility(self, tokens: list, at: int) -> tuple[tuple[str, str], int]:
        if not is_name(tokens, at, "pub"):
            return ("inherited", ""), at
        if is_group(tokens, at + 1, "("):
            body = tokens[at + 1].body
            names = [t.text for t in body if t.kind == "i" and t.text != "in"]
            if is_name(body, 0, "in"):
                return ("in", "::".join(names)), at + 2
            if names == ["self"]:
                return ("inherited", ""), at + 2
            if len(names) == 1 and names[0] in ("crate", "super"):
                return (names[0], ""), at + 2
        return ("public", ""), at + 1

    def attributes(self, attributes: list[list]) -> None:
        """Paths in the arguments of list attributes."""
        for a in attributes:
            at = 0
            while at < len(a) and (is_name(a, at) or is_sign(a, at, ":")):
                at += 1
            if is_group(a, at):
                self.tokens(a[at].body)

    # ---- imports

    def use(self, tokens: list, vis: str = "inherited", vis_path: str = "") -> None:
        tree = _use_tree(tokens)
        for name in _use_names(tree):
            self.scope.items.append((name, "use", vis, vis_path))
        names, levels, prefix = [], 0, "none"
        while tree[0] == "path":
            name = tree[1]
            if not names and name in ("crate", "self"):
                prefix, levels = name, 0
            elif name == "super":
                prefix, levels = "super", levels + 1 if prefix == "super" else 1
            else:
                names.append(name)
            tree = tree[2]
        add = self.scope.references.append
        if tree[0] == "name":
            self.imported(tree[1], prefix, levels, [*names, tree[1]])
            add(Reference("use", prefix, levels, [*names, tree[1]], leaves=[([*names, tree[1]], False, "")]))
        elif tree[0] == "as":
            self.imported(tree[2], prefix, levels, [*names, tree[1]])
            add(Reference("use", prefix, levels, [*names, tree[1]], "alias", tree[2], [([*names, tree[1]], False, "")]))
        elif tree[0] == "glob":
            add(Reference("use", prefix, levels, names, "glob", "*", [(names, True, "")]))
        else:
            for item in tree[1]:
                if item[0] in ("name", "as"):
                    self.imported(item[-1], prefix, levels, [*names, item[1]])
            text = _braces(tree[1])
            leaves = [leaf for item in tree[1] for leaf in _leaves(item, names, text)]
            add(Reference("use", prefix, levels, names, "group", text, leaves))

    def imported(self, name: str, prefix: str, levels: int, names: list[str]) -> None:
        if prefix != "none" or self.package is not None and names[0] == self.package:
            self.scope.imports[name] = (prefix, levels, names)

    # ---- code

    def tokens(self, tokens: list) -> None:
        """Paths of two or more names in tokens that only a macro understands."""
        at = 0
        while at < len(tokens):
            if is_group(tokens, at):
                self.tokens(tokens[at].body)
            elif is_name(tokens, at):
                names = [tokens[at].text]
                while is_sep(tokens, at + 1) and is_name(tokens, at + 3):
                    names.append(tokens[at + 3].text)
                    at += 3
                if len(names) > 1:
                    self.token_path(names)
            at += 1

    def token_path(self, names: list[str]) -> None:
        levels = next((i for i, n in enumerate(names) if n != "super"), len(names))
        if names[0] in ("crate", "self"):
            prefix, levels, rest = names[0], 0, names[1:]
        else:
            prefix, rest = ("super" if levels else "none"), names[levels:]
        via = None
        if prefix == "none" and names[0] in self.scope.imports:
            p, n, start = self.scope.imports[names[0]]
            via = (p, n, [*start, *names[1:]])
        if rest:
            self.scope.references.append(Reference("token", prefix, levels, rest, leaves=[(rest, False, "")], via=via))

    def code(self, tokens: list, item: str = "") -> None:
        """Paths, macros, attributes and nested imports of an item or a body."""
        at = 0
        while at < len(tokens):
            token = tokens[at]
            if is_sign(tokens, at, "#") and (is_group(tokens, at + 1, "[") or is_sign(tokens, at + 1, "!") and is_group(tokens, at + 2, "[")):
                at += 1 if is_group(tokens, at + 1, "[") else 2
                self.attributes([tokens[at].body])
                at += 1
            elif token.kind == "g":
                self.code(token.body)
                at += 1
            elif token.kind != "i":
                at += 1
            elif token.text == "use" and not is_sign(tokens, at + 1, "<") and at + 1 < len(tokens):
                end = self.until(tokens, at, ";")
                items = len(self.scope.items)
                self.use(tokens[at + 1 : end - 1])
                del self.scope.items[items:]
                at = end
            elif token.text == "mod" and is_name(tokens, at + 1) and (is_group(tokens, at + 2, "{") or is_sign(tokens, at + 2, ";")):
                at += 3
            elif token.text == "pub":
                _, at = self.visibility(tokens, at)
            elif token.text == "let":
                end = self.pattern_end(tokens, at + 1)
                self.pattern(tokens[at + 1 : end])
                at = end
            elif token.text == "for" and item != "impl" and (end := self.loop_start(tokens, at + 1)):
                self.pattern(tokens[at + 1 : end])
                at = end + 1
            elif token.text == "match" and (body := next((i for i in range(at + 1, len(tokens)) if is_group(tokens, i, "{")), 0)):
                self.code(tokens[at + 1 : body])
                self.arms(tokens[body].body)
                at = body + 1
            elif token.text in KEYWORDS:
                at += 1
            else:
                at = self.path(tokens, at)

    # ---- patterns: a bare name in one is bound, not used

    def pattern_end(self, tokens: list, at: int) -> int:
        """The place of the type, the value or the end that follows a ``let`` pattern."""
        while at < len(tokens):
            if is_sep(tokens, at):
                at += 2
                continue
            if is_sign(tokens, at, ":") or is_sign(tokens, at, ";") or is_sign(tokens, at, "=") and not is_sign(tokens, at - 1, "."):
                return at
            at += 1
        return at

    def loop_start(self, tokens: list, at: int) -> int:
        """The place of the ``in`` of a loop, or 0 where ``for`` begins none."""
        while at < len(tokens) and not is_group(tokens, at, "{") and not is_sign(tokens, at, ";"):
            if is_name(tokens, at, "in"):
                return at
            at += 1
        return 0

    def arms(self, tokens: list) -> None:
        """The arms of a match: a pattern, perhaps a condition, and a value each."""
        at = 0
        while at < len(tokens):
            while is_sign(tokens, at, "#") and is_group(tokens, at + 1, "["):
                self.attributes([tokens[at + 1].body])
                at += 2
            arrow = at
            while arrow < len(tokens) and not (is_sign(tokens, arrow, "=") and tokens[arrow].joint and is_sign(tokens, arrow + 1, ">")):
                arrow += 1
            condition = next((i for i in range(at, arrow) if is_name(tokens, i, "if")), arrow)
            self.pattern(tokens[at:condition])
            self.code(tokens[condition:arrow])
            at = end = arrow + 2
            if is_group(tokens, at, "{") and not is_sign(tokens, at + 1, ".") and not is_sign(tokens, at + 1, "?"):
                end = at + 1
            else:
                while end < len(tokens) and not is_sign(tokens, end, ","):
                    end += 1
            self.code(tokens[at:end])
            at = end + is_sign(tokens, end, ",")

    def pattern(self, tokens: list) -> None:
        at = 0
        while at < len(tokens):
            if tokens[at].kind == "g":
                self.pattern(tokens[at].body)
                at += 1
            elif tokens[at].kind != "i" or tokens[at].text in KEYWORDS:
                at += 1
            elif is_sep(tokens, at + 1) or is_group(tokens, at + 1, "({") or is_sign(tokens, at + 1, "!"):
                at = self.path(tokens, at)
            else:
                at += 1

    def path(self, tokens: list, at: int) -> int:
        start, names = at, [tokens[at].text]
        at += 1
        while True:
            if is_sep(tokens, at) and is_name(tokens, at + 2):
                names.append(tokens[at + 2].text)
                at += 3
                continue
            inner = at + 2 if is_sep(tokens, at) else at
            if is_sign(tokens, inner, "<"):
                end = after_angles(tokens, inner)
                if end > inner and is_sep(tokens, end) and is_name(tokens, end + 2):
                    self.code(tokens[inner + 1 : end - 1])
                    names.append(tokens[end + 2].text)
                    at = end + 3
                    continue
            if is_name(tokens, start - 1, "as") and is_sign(tokens, at, ">") and is_sep(tokens, at + 1) and is_name(tokens, at + 3):
                names.append(tokens[at + 3].text)
                at += 4
                continue
            break
        if is_sign(tokens, at, "!") and not is_sign(tokens, at + 1, "="):
            body = at + 1 + is_name(tokens, at + 1)
            if is_group(tokens, body):
                self.add("macro", names)
                self.tokens(tokens[body].body)
                return body + 1
        if len(names) == 1 and names[0] not in PATH_KEYWORDS:
            declared = is_name(tokens, start - 1) and tokens[start - 1].text in DECLARES
            field_name = is_sign(tokens, at, ":") and not is_sep(tokens, at)
            member = is_sign(tokens, start - 1, ".") and not is_sign(tokens, start - 2, ".")
            binding = is_sign(tokens, at, "=") and not tokens[at].joint and is_sign(tokens, start - 1, "<,")
            if declared or field_name or member or binding:
                return at
        self.add("path", names)
        return at

    def add(self, kind: str, names: list[str]) -> None:
        prefix, levels, rest = keyword_prefix(names)
        if rest:
            self.scope.references.append(Reference(kind, prefix, levels, rest, leaves=[(rest, False, "")]))


# ---- use trees: ("path", name, tree), ("name", n), ("as", n, alias), ("glob",), ("group", [trees])


def _use_tree(tokens: list):
    at = 2 if is_sep(tokens, 0) else 0
    if is_group(tokens, at, "{"):
        parts, part = [], []
        for t in [*tokens[at].body, Token("p", ",")]:
            if t.kind == "p" and t.text == ",":
                if part:
                    parts.append(_use_tree(part))
                part = []
            else:
                part.append(t)
        return "group", parts
    if is_sign(tokens, at, "*"):
        return ("glob",)
    if not is_name(tokens, at):
        raise LexError("expected a name in a use declaration")
    name = tokens[at].text
    if is_sep(tokens, at + 1):
        return "path", name, _use_tree(tokens[at + 3 :])
    if is_name(tokens, at + 1, "as") and at + 2 < len(tokens):
        return "as", name, tokens[at + 2].text
    return "name", name


def _use_names(tree) -> list[str]:
    """The names that a declaration brings in."""
    if tree[0] == "path":
        return _use_names(tree[2])
    if tree[0] == "group":
        return [n for t in tree[1] for n in _use_names(t)]
    return [] if tree[0] == "glob" else [tree[-1]]


def _chain(tree) -> tuple[list[str], tuple]:
    names = []
    while tree[0] == "path":
        names.append(tree[1])
        tree = tree[2]
    return names, tree


def _rendered(tree) -> str:
    """An item of a group as text: a single name behind a path goes without braces."""
    names, last = _chain(tree)
    if not names and last[0] != "group":
        return {"name": last[-1], "as": " as ".join(last[1:]), "glob": "*"}[last[0]]
    inner = last[1] if last[0] == "group" else [last]
    path = "::".join(names)
    if not inner:
        return path
    if len(inner) == 1 and inner[0][0] == "name" and inner[0][1] != "self":
        return f"{path}::{inner[0][1]}"
    if len(inner) == 1 and last[0] == "name":
        return f"{path}::{last[1]}"
    return f"{path}::{{{', '.join(map(_rendered, inner))}}}"


def _braces(trees: list) -> str:
    return "{" + ", ".join(map(_rendered, trees)) + "}"


def _leaves(tree, names: list[str], group: str) -> list[tuple[list[str], bool, str]]:
    """The references that an item of a group stands for; group: the group as text."""
    more, last = _chain(tree)
    path = [*names, *more]
    if last[0] == "group":
        return [leaf for t in last[1] for leaf in _leaves(t, path, _braces(last[1]))]
    if last[0] == "glob":
        return [(path, False, "{*}" if more else group)]
    if last[1] == "self" and not more:
        return [(path, False, "")]
    return [([*path, last[1]], False, "")]
