import hashlib
import random
import re

from modgraph.llm import pii

SCHEMA = "doc_id bigint, text string, lang string, n_chars bigint, key int, _row string"


def brute_base(text):
    def luhn(digits):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits[::-1])) % 10 == 0

    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def texts():
    rng = random.Random(11)
    parts = ["a@b.c", "@", ".", "x.y@z-1.de.", "1.2.3.4", "300.1.2.3", ".5", "0255.0.0.1", "4111111111111111", "4111 1111-1111 1111", "-", " ", "  ", "4", "+1 (743) 555-3824", "+", "(", "é", "😀", "\n", "99999999999", "a_%+", "4465758382889437 4465758382889437"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [*out, None, "", "1," * 20_000, "a" * 200_000, "1 " * 50_000, "a@b.c " * 3_000, "😀 4111111111111111"]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, "en", 0, 1, "r") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want = brute_base(text or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == w[0] for w in want) for k in ("email", "ip", "card", "phone")], text
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), text
        spans = set(r.spans.split(",")) - {""}
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= spans


def luhn_card(rng):
    head = [rng.randint(0, 9) for _ in range(15)]
    for last in range(10):
        digits = [*head, last]
        if sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits[::-1])) % 10 == 0:
            return "".join(map(str, digits))


def test_patterns_of_seeds_bring_in_unseen_identifiers(spark):
    rng = random.Random(3)
    rows = [(i, f"note {i} account {luhn_card(rng)} paid", "en", 0, 1, "r") for i in range(40)]
    a, b = luhn_card(rng), luhn_card(rng)
    doubled, alone, known = f"my account {a} {b} paid", "total 1234 5678 1234 5679 units", f"see {rows[0][1][15:31]} {b}"
    rows += [(100, doubled, "en", 5, 1, "r"), (101, alone, "en", 5, 1, "r"), (102, known, "en", 5, 1, "r"), (100, doubled, "en", 5, 1, "r")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got[100].split(",")[0] == "card:11:27"
    assert got[101] == ""
    start = known.index(rows[0][1].split()[3]) if rows[0][1].split()[3] in known else None
    assert start is None or f"card:{start}:{start + 16}" in got[102]


def test_precision_and_recall_on_unseen_shapes(spark):
    """Identifiers of shapes that no expression knows, in the contexts of seeds, among numbers in other contexts."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    ways = {
        "phone": ("ring me on", "please", lambda: f"+1 ({digit(3)}) {digit(3)}-{digit(4)}", [lambda: f"({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"0{digit(3)}/{digit(7)}", lambda: f"{digit(3)} {digit(2)} {digit(2)} {digit(3)}"]),
        "email": ("write to", "soon", lambda: f"{rng.choice(words)}@{rng.choice(words)}.org", [lambda: f"{rng.choice(words)} (at) {rng.choice(words)} (dot) org", lambda: f"{rng.choice(words)}@{rng.choice(words)}", lambda: f"{rng.choice(words)}{digit(2)}#1"]),
        "card": ("charge card", "today", lambda: luhn_card(rng), [lambda: "4" + digit(11), lambda: f"X{digit(3)}-{digit(4)}-{digit(4)}", lambda: f"{digit(4)}.{digit(4)}.{digit(4)}.{digit(4)}x"]),
        "ip": ("host", "answered", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), [lambda: f"fe80::{digit(4)}:1", lambda: f"10-20-{digit(2)}-7"]),
    }
    decoys = [("page", "of", 3), ("costs", "euro", 6), ("since", "was", 4), ("item", "arrived", 9), ("charge", "people", 8), ("write", "pages", 5)]
    fill = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 12)))
    rows, want = [], set()
    for kind, (before, after, seed, others) in ways.items():
        for n in range(90):
            value = rng.choice(others)() if n % 3 == 0 else seed()
            start = f"{fill()} {before} "
            i = len(rows)
            rows.append((i, f"{start}{value} {after} {fill()}", "en", 0, 1, "r"))
            if n % 3 == 0:
                want.add((i, f"{kind}:{len(start)}:{len(start) + len(value)}"))
    for before, after, n in decoys * 30:
        rows.append((len(rows), f"{fill()} {before} {digit(n)} {after} {fill()}", "en", 0, 1, "r"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    base = {i: {f"{k}:{s}:{e}" for k, s, e in brute_base(t)} for i, t, *_ in rows}
    got = {(r.doc_id, x) for r in pii.report(docs).collect() for x in r.spans.split(",") if x and x not in base[r.doc_id]}
    want = {w for w in want if w[1] not in base[w[0]]}
    assert len(want & got) >= 0.95 * len(want), sorted(want - got)[:5]
    assert len(want & got) >= 0.95 * len(got), sorted(got - want)[:5]


def test_redact_masks_spans_and_keeps_other_columns(spark):
    rows = [(1, "mail a@b.c or +1 (743) 555-3824!", "en", 33, 9, "x"), (2, None, None, None, None, None), (3, "plain é", "fr", 7, 1, "y"), (3, "plain é", "fr", 7, 1, "y"), (None, "no id", None, 5, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in pii.redact(docs).collect()), key=str)
    assert got == sorted([(1, "mail [EMAIL] or [PHONE]!", "en", 24, 9, "x"), *rows[1:]], key=str)
    assert pii.redact(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pii.report(docs).count() == 0 and pii.redact(docs).count() == 0
