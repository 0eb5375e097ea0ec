"""Operators 11 to 13 against brute-force versions, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quercus.llm import align, centroids, html_extract, licenses
from test_operators import LONG, SF, docs, none, real  # noqa: F401


# --- 11 ---
def plain_alignment(rows):
    """Both libraries' tokens of whole texts, every pair of ends compared."""
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    a_lib.no_truncation()
    a_lib.no_padding()
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    docs, total = [], collections.Counter()
    for i, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False) if text else None
        raw_a = [bytes(byte[c] for c in t) for t in a.tokens] if a else []
        ids = b_lib.encode(text) if text else []
        raw_b = [bytes([int(b_lib.id_to_piece(t)[3:5], 16)]) if b_lib.is_byte(t) else b_lib.id_to_piece(t).replace("▁", " ").encode() for t in ids]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            docs.append((i, [], [], [], ""))
            continue
        ids_a = a.ids  # a new list each time
        end_a, end_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
        where = {e: j for j, e in enumerate(end_b)}
        links = [(ids_a[j], ids[where[e]]) for j, e in enumerate(end_a) if e in where]
        cuts = [e for e in end_a if e in where]
        groups, x, y = [], 0, 0
        for e in cuts:
            x2, y2 = end_a.index(e, x) + 1, where[e] + 1
            groups.append(",".join(map(str, ids_a[x:x2])) + "|" + ",".join(map(str, ids[y:y2])))
            x, y = x2, y2
        docs.append((i, ids_a, ids, links, ";".join(groups)))
        total.update(links)
    best = collections.Counter()
    for (_, t), n in total.items():
        best[t] = max(best[t], n)
    return [
        (i, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, a, b, links, g in docs
    ]


ODD = [
    (20, "<|endoftext|> <s> </s> <unk> <0x41>"), (21, "a▁b"), (22, "  zwei  Leerzeichen \n\t und mehr   "), (23, " "), (24, "\x00 null \r\n"), (25, "é é 日本語テスト \U0001f600 "),
    (26, "don't we'll 'S 12345 ½ ²"), (27, "x" * 3000), (28, "é" * 500 + " " * 200 + "\n" * 90), (29, "▁"), (31, "a b "), (32, " a  "), (30, "foo_bar(baz)\n\n  return x  # note\n"),
]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_alignment_is_the_plain_one(spark, docs, real):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD + [(r.doc_id + 1000, r.text) for r in real.collect()]
    table = docs.select("doc_id", "text", F.lit(1).alias("pairs"), F.lit("x").alias("n_best")).unionByName(spark.createDataFrame([(*r, 1, "x") for r in rows[len(docs.collect()) :]], "doc_id long, text string, pairs int, n_best string"))
    got = align.alignment(table.repartition(5)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_alignment(rows), key=key)
    assert align.alignment(none(docs)).count() == 0


def test_alignment_gives_groups(spark):
    r = align.alignment(spark.createDataFrame([(1, "Hallo Welt")], "doc_id long, text string"), keep_groups=True).first()
    assert r.groups.count(";") + 1 == r.n_groups and r.n_links == r.n_groups


def test_pair_sums_in_parts(spark):
    """Sums given out early, several shards, and files that are read instead of mapped."""
    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(1 << 34, (1 << 34) + 400), 50)), [rng.randint(1, 9) for _ in range(50)]) for _ in range(60)]
    df = spark.createDataFrame(rows, "pairs array<long>, times array<long>").repartition(3)
    want = collections.Counter()
    for k, n in rows:
        want.update(dict(zip(k, n)))
    folder = align.new_folder(spark, "t")
    shards = align.count_shards(align.partial_counts(df, held=60), folder)
    files = [(s["name"], s["n"], s["first"], s["last"]) for s in shards]
    pairs = np.array(sorted(want), np.int64)
    mapped, read = align.Shards(folder, files), align.Shards(folder, files)
    read.fs = type("Remote", (), {"type_name": "far", "open_input_file": read.fs.open_input_file})()
    for x in (mapped, read):
        assert x.find(pairs).tolist() == [want[k] for k in pairs.tolist()]
        assert x.find(pairs[7:9]).tolist() == [want[k] for k in pairs[7:9].tolist()]
    assert sum(s["n"] for s in shards) == len(want)


# --- 13 ---
def plain_lloyd(rows, dim, k, rounds):
    """Every vector against every centroid, in Python's own integers."""
    full = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centre = [v for _, _, v in sorted((hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest(), v, v) for i, v in full)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in full:
            of[nearest(v)[1]].append(v)
        centre = [[sum(x) // len(of[j]) for x in zip(*of[j])] if j in of else c for j, c in enumerate(centre)]
    last = [(i, *nearest(v)) for i, v in full]
    total = collections.Counter()
    for _, d, j in last:
        total[j] += d
    return [(i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centre[j])).encode()).hexdigest()) for i, d, j in last]


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v int"


@pytest.mark.parametrize("dim, n, seed", [(2, 400, 1), (64, 150, 2), (3, 5, 3)])
def test_lloyd_is_the_plain_one(spark, dim, n, seed):
    """Ties (coarse grids), repeated rows and ids, groups far apart, fewer vectors than centroids, odd rows."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice((0, 100)) + round(rng.gauss(0, 1) * 2) / 2 for _ in range(dim)]) for i in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (7, None), (8, []), (9, [1.0] * (dim - 1)), (10, [None] + [1.0] * (dim - 1)), (11, [float("nan")] * dim), (12, [float("-inf")] * dim)] + [(1000 + i, rows[2][1]) for i in range(50)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(3)
    got = sorted(map(tuple, centroids.clustered(df, dim=dim, rounds=4, block=64).collect()), key=key)
    assert got == sorted(plain_lloyd(rows, dim, 8, 4), key=key)
    assert centroids.clustered(none(df), dim=dim).count() == 0


def test_lloyd_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = plain_lloyd([(r.vec_id, r.embedding) for r in table.collect()], 64, 8, 10)
    assert sorted(map(tuple, centroids.op13_centroids(spark, SF).collect())) == sorted(want)


def test_components_too_large(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], 1, "", 1)], VECTORS)
    with pytest.raises(Exception, match="after scaling"):
        centroids.clustered(df, dim=2).collect()


def test_cover_tree():
    """Children cover their vectors, their centres are apart, spans are whole, and the descent prunes."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(-20, 20, (300, 4)) + c for c in ([0] * 4, [4000] * 4, [-9000, 0, 0, 9000])])
    tree = centroids.Tree.of(v)
    w = v[tree.order].astype(float)
    assert sorted(tree.order.tolist()) == list(range(len(v)))
    for i in range(len(tree.start)):
        span = w[tree.start[i] : tree.end[i]]
        assert np.sqrt(((span - span[0]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        kids = tree.children(i)
        assert not kids or [int(tree.start[i]), *(int(tree.end[x]) for x in kids)] == [*(int(tree.start[x]) for x in kids), int(tree.end[i])]
        for a in range(len(kids)):
            for b in range(a):
                gap = np.sqrt(((w[tree.start[kids[a]]] - w[tree.start[kids[b]]]) ** 2).sum())
                assert gap > max(tree.radius[kids[a]], tree.radius[kids[b]]) - 1e-9
    whole, compared = [], []
    ends = centroids.Descent(np.array([[0] * 4, [4000] * 4, [-9000, 0, 0, 9000]]))
    ends.nearest(tree, v[tree.order], lambda what, whose: (compared if isinstance(what, slice) else whole).append(what))
    assert not compared and len(whole) < 40


# --- 12 ---
def plain_scan(text, templates=licenses.TEMPLATES, gap=licenses.GAP):
    """Every place of the text against every place of every template."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    w = words(text or "")
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    spans, best = [], 0.0
    for tid, (label, t) in enumerate(templates):
        t = words(t)
        hits = sorted((i - j, i, j) for i in range(len(w) - 3) for j in range(len(t) - 3) if w[i : i + 4] == t[j : j + 4])
        groups = []
        for h in hits:
            if groups and h[0] - groups[-1][-1][0] <= gap:
                groups[-1].append(h)
            else:
                groups.append([h])
        for n, g in enumerate(groups):
            covered = len({x for _, _, j in g for x in range(j, j + 4)})
            a, z = min(i for _, i, _ in g), max(i for _, i, _ in g) + 4
            best = max(best, covered / len(t))
            if covered >= licenses.SHARE * len(t) and covered >= licenses.DENSITY * (z - a):
                spans.append((a, -z, -covered, tid, n, label))
    spans.sort()
    own = {s[-1] for i, s in enumerate(spans) if not any(b[1] <= s[1] for b in spans[:i])}
    base = {x for _, x in found}
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if base else best


def test_licenses_are_the_plain_ones(spark, docs, real):  # noqa: F811
    t = [x for _, x in licenses.TEMPLATES]
    made = [
        t[0] + " " + t[4], t[7].upper(), "intro " + t[7].replace("free of charge", "gratis") + " outro", " ".join(t[9].split()[:8]), t[13], t[12], t[13] + "\n" + t[12], (t[10] + " x ") * 3, "cc by cc by-sa MIT\n\tLicense apache  license",
        t[5][:150], "maſk the Kelvin sign: licensed \u212aGNU General Public License", "İstanbul MIT License", "gnu general public", "a b c", "Licensed under CC BY-NC 4.0.", " ".join(f"w{i}" for i in range(4090)) + " " + t[9] + " mit license" + " z" * 9000,
    ]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(500 + i, x) for i, x in enumerate(made)] + [(1000 + r.doc_id, r.text) for r in real.collect()]
    df = spark.createDataFrame([(i, x, 1, "y", 2) for i, x in rows], "doc_id long, text string, row int, tid string, id int").repartition(4)
    got = sorted((tuple(r)[:8] for r in licenses.scanned(df).collect()), key=key)
    assert got == sorted(((i, *plain_scan(x)) for i, x in rows), key=key)
    assert licenses.scanned(none(df)).count() == 0


def test_license_spans(spark):
    text = "one two three " + licenses.TEMPLATES[9][1] + " four"
    r = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in r.spans] == [(3, 3 + 21, "bsd", 1.0)] and r.labels == "bsd" and r.base_labels == "" and r.score == 1.0
    with pytest.raises(ValueError):
        licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"), templates=[("x", "too short")])


# --- 2 ---
STORY = "The river rose slowly for three days before it reached the old mill. Nobody in the village had seen such water. "


def read(page, path=None):
    return html_extract.text_at(html_extract.blocks(page), path)


def test_html_a_page_that_differs_from_its_host():
    page = f"<html><body><div class=content><p>Tiny.</p></div><div class=longread><p>{STORY * 2}</p><p>{STORY}</p></div></body></html>"
    assert read(page, "body/div.content") == f"{(STORY * 2).strip()}\n\n{STORY.strip()}"
    pages = f"<html><body><div class=content><p>{STORY}</p></div><div class=longread><p>{STORY}</p></div></body></html>"
    assert read(pages, "body/div.content") == STORY.strip()  # about as much elsewhere: the host decides


def test_html_title_beside_the_container():
    page = f"<body><h1>Flood</h1><div class=content><p>{STORY * 3}</p></div></body>"
    assert read(page) == read(page, "body/div.content") == f"Flood\n\n{(STORY * 3).strip()}"
    own = f"<body><h1>Site</h1><div class=content><h1>Flood</h1><p>{STORY * 3}</p></div></body>"
    assert read(own, "body/div.content") == f"Flood\n\n{(STORY * 3).strip()}"
    header = f"<body><header><h1>Site</h1></header><div class=content><p>{STORY * 3}</p></div><div class=x><h1>Later</h1></div></body>"
    assert read(header, "body/div.content") == (STORY * 3).strip()


def test_html_whole_names_of_classes():
    page = (
        f'<body><article><p>{STORY}</p><div class="share-price-report"><p>Shares rose to nine.</p></div><div class="social-history"><p>They were weavers.</p></div><p class="notice-of-intent">We intend to go on.</p><p>He looked for <span class="search-term">water</span> everywhere.</p>'
        '<div class="social-share"><p>Tell friends</p></div><div class="relatedPosts"><p>More</p></div><div class="cookie-banner"><p>Cookies</p></div><div class="ad-container"><p>Buy</p></div><div class="comment-list"><p>First!</p></div><a class="login" href="/x">Log in</a><p>End of <a href="/y">it</a>.</p></article></body>'
    )
    assert read(page) == "\n\n".join([STORY.strip(), "Shares rose to nine.", "They were weavers.", "We intend to go on.", "He looked for water everywhere.", "End of it."])


def test_html_unclosed_link():
    assert read(f'<body><article><p>{STORY}<a class="login">Log in<p>More of it here.</p></article></body>').endswith("More of it here.")
    page = "<body><article>" + f"<p>{STORY}</p>" * 4000 + "<p>" + "word " * 100_000 + "</p></article></body>"  # a very long page
    assert read(page).count("\n\n") == 4000 and read("") == "" and read("<h1>Only</h1>") == "Only"
