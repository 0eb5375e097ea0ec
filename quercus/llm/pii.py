"""Operator 9: personal data by gradient-boosted candidates.

Generators propose spans of four kinds. Base generators are exact patterns whose spans always stay. Wider generators
(addresses written out, other separators, numbers without a plus sign, IPv6) propose more, overlapping ones included;
boosted trees score each from its format and its context, a threshold per kind, calibrated on held-out candidates for
precision, selects, and of selected spans that overlap the likelier stays. The trees are trained here on generated
candidates with known answers: the tables hold no labels for personal data.

Cases: null is the empty text: no spans. Offsets are code points, ends exclusive. A text may be of any length; it is
searched as a whole. Of candidates that overlap the likelier stays, of equally likely ones the first; a null id is kept. Equal
rows give equal results, an empty table none; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_rows, small_batches, table
from .gbdt import Trees

#: The kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
AT, DOT = r"(?: ?[\[({] ?at ?[\])}] ?| at )", r"(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)"
WIDE = {
    "email": re.compile(rf"[a-z0-9_%+-]+(?:{DOT}[a-z0-9_%+-]+){{0,3}}{AT}[a-z0-9-]+(?:{DOT}[a-z0-9-]+){{1,4}}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./_\xa0-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[ ]?)?(?:\([0-9]{1,4}\)|[0-9]{2,5})(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])"),
}
# The parts of WIDE["email"] around a written at, for wide_emails: the word itself, what follows, and what precedes, backwards.
WRITTEN = re.compile(r"[aA](?<=[ \[({].)[tT](?=[ \])}])")
AT_DOMAIN = re.compile(rf"{AT}[a-z0-9-]+(?:{DOT}[a-z0-9-]+){{1,4}}", re.I)
LOCAL_BACK = re.compile(r"[a-z0-9_%+-]+(?:(?: ?[\])}] ?tod ?[\[({] ?| tod |\.)[a-z0-9_%+-]+){0,3}", re.I)
WORDS = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "dial", "cell"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pay"),
    "email": ("mail", "contact", "write", "address", "reach"),
    "ip": ("ip", "host", "server", "addr", "from", "login"),
    "none": ("order", "invoice", "serial", "version", "isbn", "token", "hash", "ticket", "part", "page", "date", "ref", "total", "rev", "build"),
}
#: The precision that a kind's threshold must reach on held-out candidates.
PRECISION = 0.995


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_emails(text: str) -> list[tuple[int, int]]:
    """EMAIL's matches, found from their at signs: the pattern itself is slow on long words."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        m = EMAIL.match(text, s) if s < at else None
        if m:
            out.append(m.span())
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = [(s, 0, e) for s, e in base_emails(text)] if "@" in text else []
    if m := DIGIT.search(text):
        at = m.start()
        if "." in text:
            out += [(x.start(), 1, x.end()) for x in IP.finditer(text, at) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in x[0].split("."))]
        for x in CARD.finditer(text, at):
            if x.end() - x.start() >= 14 and 14 <= len(d := _digits(x[0])) <= 19 and luhn(d):
                out.append((x.start(), 2, x.end()))
        if "+" in text:
            out += [(x.start(), 3, x.end()) for x in PHONE.finditer(text) if 10 <= len(_digits(x[0])) <= 15]
    return sorted(out)


def wide_emails(text: str) -> list[tuple[int, int]]:
    """WIDE["email"]'s matches, found from their written ats: the pattern itself is slow on plain prose. Each at has its own, so they may overlap."""
    out, back = [], ""
    for at in WRITTEN.finditer(text):
        for s in range(max(0, at.start() - 3), at.start()):  # a blank and a bracket may precede
            m = AT_DOMAIN.match(text, s)
            if m and text[s : at.start()].strip(" [({") == "":
                back = back or text[::-1]
                if local := LOCAL_BACK.match(back, len(text) - s):
                    out.append((len(text) - local.end(), m.end()))
                    break
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Spans of the wider generators; they may overlap each other and base spans."""
    out = []
    out += [(s, 0, e) for s, e in wide_emails(text)]
    if m := DIGIT.search(text):
        if text.count(":") >= 2:
            out += [(x.start(), 1, x.end()) for x in WIDE["ip"].finditer(text) if len(x[0]) > 6]
        for k, name in ((2, "card"), (3, "phone")):
            out += [(x.start(), k, x.end()) for x in WIDE[name].finditer(text, max(0, m.start() - 1)) if k == 2 or 8 <= len(_digits(x[0])) <= 15]
    return sorted(set(out))


def vector(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context features of one candidate."""
    s, k, e = span
    x, before, after = text[s:e], text[max(0, s - 32) : s].lower(), text[e : e + 16].lower()
    d = _digits(x)
    groups = [len(g) for g in re.findall("[0-9]+", x)] or [0]
    seps = re.findall("[^0-9A-Za-z]", x)
    return [
        k, len(x), len(d), float(luhn(d)) if d else 0.0, len(groups), max(groups), min(groups), len(set(seps)), len(seps),
        float("(" in x), float(x.startswith("00")), float(d[:1] in "3456") if d else 0.0, len(set(d)), float(len(set(groups[:-1])) <= 1 if len(groups) > 1 else 0),
        float(":" in x), float(x.count("::")), float("[" in x or "(" in x or "{" in x), float(sum(c.isalpha() for c in x)),
        float(bool(before) and before[-1].isalnum()), float(bool(after) and after[0].isalnum()), float(before[-1:] in "-_/#=$€£" and bool(before)), float(after[:1] in "-_/%" and bool(after)),
        float("." in seps), float("/" in seps),
        *(float(any(w in before or (w in after and n == "none") for w in ws)) for n, ws in WORDS.items()),
    ]


def training_set(seed: int = 7, n: int = 6000) -> tuple[list[tuple[str, tuple[int, int, int]]], np.ndarray]:
    """Generated candidates with known answers, of every kind, half of them personal data."""
    r = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(pick(*"bcdfglmnprstv") + pick(*"aeiou") for _ in range(int(r.integers(1, 4))))

    def card(ok: bool) -> str:
        d = pick("4", "5", "37", "6") + num(14)
        d = (d + num(4))[:15]
        good = next(c for c in "0123456789" if luhn(d + c))
        return d + (good if ok else pick(*(c for c in "0123456789" if c != good)))

    out, y = [], []
    while len(out) < n:
        k, ok = int(r.integers(4)), bool(r.integers(2))
        context = WORDS[KINDS[k]] if ok or r.random() < 0.2 else WORDS["none"]
        lead = f"{word()} {pick(*context)}{pick('', ':', ' is', ' no.')} " if r.random() < (0.8 if ok else 0.6) else f"{word()} {word()} "
        if k == 0:
            if ok:
                form = pick(("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", " [dot] "))
                x = f"{word()}{pick('', '.', '_')}{word()}{form[0]}{word()}{form[1]}{pick('com', 'org', 'net', 'io', 'de')}"
            else:
                x = f"{word()} at {word()} dot {word()}{pick('', ' at ' + word())}{word() * 2}"
        elif k == 1:
            x = ":".join(f"{int(v):x}" for v in r.integers(256, 65536, 8)) if ok else ":".join(f"{int(v):02d}" for v in r.integers(0, 60, pick(3, 4)))
        elif k == 2:
            x = card(ok) if r.random() < 0.9 or ok else num(pick(13, 14, 17, 19))
            if ok or r.random() < 0.7:
                sep = pick(" ", "-", ".", "/", "_", "  ", "\xa0")
                x = sep.join(x[i : i + 4] for i in range(0, len(x), 4))
        elif ok:
            x = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0049 {num(3)} {num(4)} {num(3)}", f"{num(5)} {num(6)[:5]}")
        else:
            x = pick(f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(3)}.{num(3)}", f"{num(4)}-{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(3)}.{num(3)}.{num(3)}", f"{num(4)} {num(4)} {num(4)}")
        if not ok and r.random() < 0.3:
            x, lead = x, lead + pick("#", "$", "=", "-", "v")
        text = f"{lead}{x}{pick(' ', '.', ',', ' ' + word())} {word()}"
        span = (len(lead), k, len(lead) + len(x))
        out.append((text, span))
        y.append(ok and not (k == 3 and lead.split()[-1:] and any(w in lead for w in WORDS["none"])))
    for _ in range(n // 4):  # addresses with a written at alone, and what is said to be at a site
        ok, plain = bool(r.integers(2)), bool(r.integers(2))
        end = pick("com", "org", "net", "io", "de", "co.uk", "example.org")
        lead = f"{word()} {word()} "
        if ok:
            local = f"{word()}{pick('', '.', '_')}{word()}"
            x = local + (" at " if plain else pick("[at]", "(at)", "{at}", " [at] ", " (at) ", " {at} ", "[ at ]")) + f"{word()}{pick('', '-' + word())}.{end}"
            if plain or r.random() < 0.5:
                lead = f"{word()} {pick(*WORDS['email'])}{pick('', ':', ' is', ' to', ' me')} "
        else:
            x = f"{pick('look', 'see', 'available', 'hosted', 'sold', 'met', 'is', word(), word())} at {word()}.{pick(end, word(), word().capitalize())}"
        if not plain:
            x = x.replace("at", "AT", 1) if ok and r.random() < 0.2 else x
        text = f"{lead}{x}{pick(' ', '.', ',', ' ' + word())} {word()}"
        out.append((text, (len(lead), 0, len(lead) + len(x))))
        y.append(ok)
    return out, np.array(y, float)


def train(seed: int = 7) -> tuple[Trees, list[float], float]:
    """The trees, a threshold per kind and the held-out accuracy. A third of the candidates calibrates."""
    rows, y = training_set(seed)
    x = np.array([vector(t, s) for t, s in rows])
    held = np.arange(len(y)) % 3 == 0
    trees = Trees().fit(x[~held], y[~held])
    p = trees.predict(x[held])
    limits = []
    for k in range(len(KINDS)):
        at = x[held][:, 0] == k
        q, t = p[at], y[held][at]
        order = np.argsort(-q, kind="stable")
        precision = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        limits.append(max(0.5, float(q[order][good[-1]])) if len(good) else 1.1)
    return trees, limits, float(((p >= 0.5) == (y[held] == 1)).mean())


def select(text: str, trees: Trees, limits: list[float]) -> list[tuple[int, int, int]]:
    """Base spans and the selected candidates, by start, then kind."""
    base = base_spans(text)
    found = candidates(text)
    if found:
        found = [c for c in found if not any(c[0] < e and s < c[2] for s, _, e in base)] if base else found
    if not found:
        return base
    p = trees.predict(np.array([vector(text, c) for c in found]))
    taken: list[tuple[int, int, int]] = []
    for score, c in sorted(((-q, c) for q, c in zip(p, found) if q >= limits[c[1]]), key=lambda z: (z[0], z[1])):
        if not any(c[0] < e and s < c[2] for s, _, e in taken):
            taken.append(c)
    return sorted(base + taken)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts of base spans by kind and of all spans, base spans, all spans, and the redacted text."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train()[:2])
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        trees, limits = model.value
        rows = []
        for t in b.column(1).to_pylist():
            t = t or ""
            base, spans = base_spans(t), select(t, trees, limits)
            n = [0] * len(KINDS)
            for _, k, _ in base:
                n[k] += 1
            rows.append((*n, len(spans), shown(base), shown(spans), redacted(t, spans) if spans else t))
        cols = list(zip(*rows))
        return pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.string()) for c in cols[5:])], names)

    names = [id_col, *(f"n_{k}" for k in KINDS), "n_spans", "base_spans", "spans", "redacted"]
    return docs.select(id_col, text_col).mapInArrow(by_rows(run), f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_spans string, spans string, redacted string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, all rows and columns, with personal data in the texts replaced; the length column follows, if there is one."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train()[:2])
    at = docs.columns.index(text_col)
    also = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        trees, limits = model.value
        old = b.column(at).to_pylist()
        new = [redacted(t, s) if t and (s := select(t, trees, limits)) else t for t in old]
        columns = list(b.columns)
        columns[at] = pa.array(new, columns[at].type)
        if also is not None:
            columns[also] = pa.array([len(y) if y is not x and y is not None else n for x, y, n in zip(old, new, columns[also].to_pylist())], columns[also].type)
        return pa.record_batch(columns, schema=b.schema)

    return docs.mapInArrow(by_rows(run), docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans", "n_spans")


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
