"""Surrogates against a rewriter in plain Python, which goes over all texts at once and looks everything up in dictionaries."""

import hashlib
import random
import re

import regex

from tidebar.llm import pii

KINDS = {k: regex.compile(f"(?V1){v}") for k, v in pii.KINDS.items()}
FOUND = regex.compile(f"(?V1){pii._FOUND}")
TITLES = regex.compile(rf"(?V1)^(?:{pii._ANY} )+")
SMALL = re.compile(f"{pii._SMALL}$")


def number(h, i):
    at = i * 2 % 62
    return int(h[at : at + 2], 16)


def like(value, h):
    def one(c, n):
        if c in "0123456789":
            return str(n % 10)
        return chr((65 if c.isupper() else 97) + n % 26) if c.isalpha() else c

    return "".join(one(c, number(h, i)) for i, c in enumerate(value))


def drawn(kind, value, attempt, key):
    h = hashlib.sha256(f"{key}|{kind}|{value}|{attempt}".encode()).hexdigest()
    if kind in pii.NAMES:
        if not attempt:
            first = pii.NAMES[kind].split()
            return first[number(h, 0) % len(first)]
        syllables, last = pii.SYLLABLES["c" if kind.endswith("c") else ""].split(), pii.ENDINGS[kind].split()
        return ("".join(syllables[number(h, j) % len(syllables)] for j in range(1 + attempt)) + last[number(h, 30) % len(last)]).capitalize()
    if kind == "email":
        out, host = like(value, h), value.split("@")[1]
        top = host.rsplit(".", 1)[1]
        return out[: len(out) - len(top)] + top
    if kind == "phone":
        return str(2 + number(h, 30) % 8) + like(value, h)[1:]
    if kind == "ip":
        return ".".join(str({1: 1 + number(h, i) % 9, 2: 10 + number(h, i) % 90}.get(len(c), 100 + number(h, i) % 155)) for i, c in enumerate(value.split(".")))
    assert kind in ("ssn", "secret"), kind
    if kind == "secret" and re.fullmatch("[0-9a-f]{8,192}", value):
        return (h + "".join(hashlib.sha256(x.encode()).hexdigest() for x in (h, h + h)))[: len(value)]
    return like(value, h)


def initial(value, key):
    h = hashlib.sha256(f"{key}|initial".encode()).hexdigest()
    for alphabet in pii.ALPHABETS:
        if value[0].upper() in alphabet:
            return alphabet[(alphabet.index(value[0].upper()) + 1 + number(h, 0) % (len(alphabet) - 1)) % len(alphabet)] + "."
    raise AssertionError(value)


def kind_of(spelling):
    return next(k for k, p in KINDS.items() if p.fullmatch(spelling))


def name_of(spelling):
    return TITLES.sub("", spelling).split(" ")


def entities(spelling, genders):
    """(kind, value) of each part."""
    kind = kind_of(spelling)
    if kind.startswith("name_"):
        words, c = [w for w in name_of(spelling) if not SMALL.match(w)], "c" if kind.endswith("c") else ""
        of = lambda i: f"family{'_c' if c else ''}" if i == len(words) - 1 else f"given_{genders[' '.join(name_of(spelling)).lower()]}{c}"
        return [("initial" if p.endswith(".") else of(i), p.lower()) for i, w in enumerate(words) for p in w.split("-")]
    if kind in ("phone", "call"):
        return [("phone", re.sub(r"^0+(?=\d{6})", "", re.sub(r"\D", "", spelling)[-10:]))]
    if kind == "secret":
        return [(kind, re.search(r"[=:]\s{0,2}[\"']?(.*)$", spelling)[1])]
    return [(kind, {"email": spelling.lower(), "ssn": re.sub(r"\D", "", spelling)}.get(kind, spelling))]


def rewritten(texts, key=pii.KEY):
    found = {t: [m[0] for m in FOUND.finditer(t)] for t in texts if t}
    spellings = sorted({x for f in found.values() for x in f})
    titled = {}
    for x in spellings:
        if kind_of(x).startswith("name_"):
            titled.setdefault(" ".join(name_of(x)).lower(), set()).update({kind_of(x)[5]} - {"n"})
    genders = {p: g.pop() if len(g) == 1 else "n" for p, g in titled.items()}
    kind_class = lambda k: "name" if k in pii.NAMES else k
    all_of = {e for x in spellings for e in entities(x, genders) if e[0] != "initial"}
    real, taken, settled, pending, attempt = {(kind_class(k), v) for k, v in all_of}, set(), {}, all_of, 0
    while pending:
        by = {}
        for e in sorted(pending):
            s = drawn(*e, attempt, key)
            by.setdefault((kind_class(e[0]), s.lower() if e[0] in pii.NAMES else s), (e, s))
        for at, (e, s) in by.items():
            if at not in real and at not in taken:
                settled[e] = s
        taken |= {at for at, (e, _) in by.items() if e in settled}
        pending, attempt = pending - settled.keys(), attempt + 1

    def replacement(x):
        kind, parts = kind_of(x), entities(x, genders)
        if kind.startswith("name_"):
            put, parts = [], iter(parts)
            for w in name_of(x):
                if SMALL.match(w):
                    put.append(w)
                    continue
                new = []
                for p in w.split("-"):
                    e = next(parts)
                    s = initial(e[1], key) if e[0] == "initial" else settled[e]
                    new.append(s.upper() if len(p) > 1 and p.isupper() else s)
                put.append("-".join(new))
            return x[: len(x) - len(" ".join(name_of(x)))] + " ".join(put), dict(zip(name_of(x), put, strict=True))
        s = settled[parts[0]]
        if kind in ("phone", "call", "ssn"):
            digits, n = iter(s), len(re.sub(r"\D", "", x)) - len(s)
            out = []
            for c in x:
                n -= c.isdigit()
                out.append(next(digits) if c.isdigit() and n < 0 else c)
            return "".join(out), {}
        if kind == "email":
            return "".join(b.upper() if "A" <= a <= "Z" else b for a, b in zip(x, s, strict=True)), {}
        return (x[: len(x) - len(parts[0][1])] + s if kind == "secret" else s), {}

    out = []
    for t in texts:
        if not t:
            out.append((t, 0))
            continue
        words, given = {}, {}
        for x in found[t]:
            names = [w for w in name_of(x) if not SMALL.match(w)] if kind_of(x).startswith("name_") else []
            for i, w in enumerate(names):
                if not w.endswith("."):
                    (given if i < len(names) - 1 else words).setdefault(w, set()).add(replacement(x)[1][w])
        again = {w: min(s) for w, s in (given | words).items()}
        pattern = regex.compile(r"(?<![\p{L}\p{N}_])(?:" + "|".join(sorted(again, key=lambda w: (-len(w), w))) + r")(?![\p{L}\p{N}_])") if again else None
        n, at, new = len(found[t]), 0, []
        for m in [*FOUND.finditer(t), None]:
            between = t[at : m.start() if m else len(t)]
            if pattern:
                between, k = pattern.subn(lambda w: again[w[0]], between)
                n += k
            new.append(between + (replacement(m[0])[0] if m else ""))
            at = m.end() if m else at
        out.append(("".join(new), n))
    return out


ODD = [
    "Mr. Adam Stone came.", "Stone walls are old. Adam is a name.", "Dr. John Smith, Mr. John Smith and Mr. J. Smith; John Smith", "Mr. John Smith", "Prof. Kim Lee, Mr. Kim Lee and Mrs. Kim Lee", "MR. SMITH", "Mr. SMITH saw Mrs. Anna SMITH-Jones, SMITH, Smith",
    "password: hunterhunter", "passwd = \"letters.only\" token: nothingatall secret=abc12345", "call 2745559629, tel. 02745559629 or 274-555-9629, Phone: 12745559629", "Herr Ludwig van Beethoven, Beethoven van", "г-н Иван Петров и д-р Иван Петров. Петров?", "г-жа А. Римская-Корсакова",
    "Mr. Bauer and Mrs. Alice Weber", "a.b@c.de A.B@C.de x.y+z@mail.example.org 10.0.0.1 123-45-6789", "", None, "  ", "nothing here",
]


def test_equals_a_plain_rewriter(spark):
    r = random.Random(4)
    first = [f"{a}{b}" for a in ("Ad", "Bel", "Cor", "Dan", "El") for b in ("am", "ina", "o", "us")]
    many = [f"{r.choice(('Mr.', 'Mrs.', 'Dr.'))} {r.choice(first)} Fam{chr(97 + i % 26)}{chr(97 + i // 26)} wrote to 10.1.{i % 200}.{i % 7}" for i in range(400)]
    long = " ".join(many) * 3
    texts = ODD + many + [long]
    rows = [(None if i % 3 == 0 else i // 4, t, "k") for i, t in enumerate(texts)] + [(None, ODD[0], "k"), (None, ODD[0], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest string")
    got = pii.replace_pii(df, count_as="n")
    assert got.columns == ["doc_id", "text", "_digest", "n"]
    want = rewritten([t for _, t, _ in rows])
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(((a.doc_id, a.text, a.n) for a in got.collect()), key=order) == sorted(((d, t, n) for (d, _, _), (t, n) in zip(rows, want, strict=True)), key=order)


def test_no_shared_names_between_rows_and_no_longer_names(spark):
    rows = [(None, "Mr. Adam Stone came."), (None, "Stone walls are old. Adam is a name."), (7, "Dr. John Smith and Mr. John Smith"), (8, "Mr. John Smith")]
    got = {t: r.text for (_, t), r in zip(rows, sorted(pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, "Stone" in r.text)), strict=True)}
    assert got[rows[1][1]] == rows[1][1]
    one, two = re.fullmatch(r"Dr\. (\S+ \S+) and Mr\. (\S+ \S+)", got[rows[2][1]]).groups()
    assert one == two == got[rows[3][1]][4:] and one.split()[0] in pii.NAMES["given_m"]
    r = random.Random(5)
    families = sorted({"".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4)).capitalize() for _ in range(2000)})
    found = spark.createDataFrame([(f"Mr. {f}",) for f in families], "spelling string")
    put = [x.replacement for x in pii.replacements(found).collect()]
    assert len(set(put)) == len(families) and all(re.fullmatch(r"Mr\. [A-Z][a-z]+", x) for x in put)
