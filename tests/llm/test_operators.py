"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import html as html_lib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quercus.llm import bpe, decontaminate, html_extract, lm, media, minhash, pii, quality, token_counts, warc
from quercus.llm.common import new_folder, remainder
from tests_llm_helpers import plain_components, sets_of

SF = "/root/testdata/sf0.001"
LONG = "wort " * 30_000 + "x" * 70_000
TEXTS = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, ""), (5, "   \n\t "), (6, "Eins"), (7, LONG), (8, "a b c d e f g x"), (9, "naïve 日本 \U0001f600 don't <|endoftext|> 12"), (1, "a b c d e f g h"), (None, "ohne id")]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns whose names clash with those the operators make."""
    rows = [(i, t, "de", "s", "z", 7, 8.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, n long, score double").repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def none(df):
    return df.where("false")


# --- 1 ---
def test_warc_round_trip(spark):
    rows = [(3, "http://a/x y", "<p>1"), (1, None, "<p>1"), (2, "http://b", None), (2, "http://b", None), (None, "http://c", "<p>1"), (5, "u", "é" * 50_000), (9, "http://q", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = new_folder(spark, "warc")
    warc.write_archive(pages, path)
    got = sorted(((r.page_id is None, r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect())
    want, seen = [], set()
    for i, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        x = (h or "").encode()
        first = min((r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None))
        want.append(((i is None, i), len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "revisit" if x in seen else "response", first if x in seen else None))
        seen.add(x)
    assert got == sorted(want)
    assert spark.read.parquet(f"{path}/blobs").count() == len(seen)
    full = warc.reconstruct(spark, path).collect()
    for r in full:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        body = rest[:-4]
        assert rest.endswith(b"\r\n\r\n") and int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) == len(body)
        if b"WARC-Type: response" in head:
            assert hashlib.sha256(body).hexdigest() == r.digest
    warc.write_archive(none(pages), path + "-0")
    assert warc.read_archive(spark, path + "-0").count() == 0


# --- 2 ---
PAGE = '<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; more</h1><p>First  line<br>goes on.<p>Second &lt;one&gt;</p><aside>side</aside><script>var p="</p>";</script></article><div id="comments"><p>a reader</p></div><footer>f &copy;</footer></body>'


def test_html_cases(spark):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", None), (3, None, "plain &amp; simple"), (4, "http://[bad", "<p>x<p>y"), (5, "http://h/5", "<div><b>unclosed <i>text"), (1, "http://h/1", PAGE), (6, "http://h/6", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, path string").repartition(2)
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    main = "Head & more\n\nFirst line goes on.\n\nSecond <one>"
    assert got == collections.Counter({(1, main, len(main)): 2, (2, "", 0): 1, (3, "plain & simple", 14): 1, (4, "x\n\ny", 4): 1, (5, "unclosed text", 13): 1, (6, "", 0): 1})
    assert html_extract.extract(none(pages)).count() == 0


def test_html_of_real_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html_lib.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside))
        assert got[r.page_id] == "\n\n".join(filter(None, parts))


def test_the_host_decides():
    own = "<body><div class='x1'><p>" + "word " * 20 + "</p></div><div class='y'><p>" + "more text here " * 3 + "</p></div></body>"
    found = html_extract.blocks(own)
    assert html_extract.best_path(found)[0] == "body/div.x#"
    assert html_extract.text_at(found, "body/div.y").startswith("more text") and html_extract.text_at(found, "gone").startswith("word")


def whole(page):
    found = html_extract.blocks(page)
    return html_extract.text_at(found, html_extract.best_path(found)[0])


def test_html_keeps_the_whole_article():
    long, short = "long prose here " * 20, "short prose " * 5
    strip = lambda *x: "\n\n".join(y.strip() for y in x)
    assert whole(f"<body><article><h1>Head</h1><p>Lead</p><div class=content><p>{long}</p></div></article><div class=x><p>{short}</p></div></body>") == strip("Head", "Lead", long)
    assert whole(f"<body><article><section class=a><p>{long}</p></section><section class=b><p>{short}</p></section></article></body>") == strip(long, short)
    assert whole(f"<body><main><h1>Head</h1><article><div class=content><p>{long}</p></div></article></main></body>") == strip("Head", long)
    assert whole(f"<body><main><article><p>{long}</p></article><div class=x><p><a href=1>{short}</a></p></div></main></body>") == strip(long)
    assert whole(f"<body><div id=w><div class=a><p>{long}</p></div><div class=b><p>{short}</p></div></div></body>") == strip(long, short)


def test_html_wrappers_and_unclosed_elements():
    long, short = "long prose here " * 20, "short prose " * 5
    p, q = long.strip(), short.strip()
    for wrapper in ("div class='page has-sidebar'", "main class='no-sidebar'", "article class='post comments-open'", "div class='widget'", "app-root class='login'"):
        end = wrapper.split()[0]
        assert whole(f"<body><{wrapper}><p>{long}</p><div class=sidebar><p>{short}</p></div></{end}></body>") == p
    assert whole(f"<body><div class=content><p>{short}</p></div><div id=comments><p>{long * 3}</p></div></body>") == q
    assert whole(f"<body><article><p>{short}</p></article><div class=cookie><p>{q} {q}</p></div></body>") == q
    assert whole(f"<body><article><p>{short}</p><article class=comment><p>{short}</p></article></article></body>") == q
    assert whole(f"<html><head><title>t</title><meta charset=x><body><p>{long}</p></body>") == p
    assert whole(f"<html><head><title>t <p>x</title><script>'<p>'</script></head><body><p>{long}</p></body>") == p
    for tag in ("button", "select", "svg", "object", "noscript"):
        assert whole(f"<body><div><{tag} a=1>x</div><p>{long}</p></body>") == p
        assert whole(f"<body><div><{tag}>x</div><p>{long}</p><{tag}>y</{tag}></body>") == p
        assert whole(f"<body><p>{long}</p><{tag}><div>x</div></{tag}></body>") == p
    assert whole("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>") == "so x=2 holds"


# --- 3 ---
def near_copies(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for g in range(6):
        base = [r.choice(words) for _ in range(60)]
        for _ in range(n):
            t = list(base)
            for _ in range(r.randint(0, 7)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
    return list(enumerate(out))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, real, k):
    rows = [(r.doc_id, r.text) for r in real.collect()] + [(100_000 + i, t) for i, t in near_copies(k, 12)]
    want = plain_components(sets_of(rows, k))
    got = {r.doc_id: r for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=k).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) and r.n_shingles == len(s) for (i, r), s in zip(sorted(got.items()), (s for _, s in sorted(sets_of(rows, k).items()))))


def test_links_between_members_that_are_not_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SQUARE", 4)
    rows = near_copies(99, 40)
    want = plain_components(sets_of(rows, 2))
    assert {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()} == want


def test_near_duplicates_of_odd_rows(docs):
    rows = minhash.link(docs, k=2).collect()
    assert len(rows) == len(TEXTS)
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert got[1] == {(7, 1, True)} and got[2] == {(7, 1, False)} and got[3] == {(0, 3, True)} and got[5] == {(0, 5, True)} and got[6] == {(1, 6, True)} and got[8] == {(7, 8, True)}
    assert got[None] == {(1, None, True)}
    assert minhash.link(none(docs), k=2).count() == 0


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8):
        a, b = (np.unique(r.integers(0, 2**63, 900, dtype=np.uint64)) for _ in range(2))
        shared = a[: int(900 * j)]
        m = (900 - len(shared)) // 2
        x, y = np.union1d(shared, a[len(shared) : len(shared) + m]), np.union1d(shared, b[:m])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((minhash.sketch(x) == minhash.sketch(y)).mean() - true) < 5 * np.sqrt(true * (1 - true) / minhash.T)
    one = minhash.sketch(np.array([5], np.uint64))
    assert (one != np.iinfo(np.uint64).max).all()  # one element fills every coordinate


# --- 4 and 6 ---
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_matches_the_library(docs, real):
    lib = library()
    for df in (docs, real):
        rows = {(r.doc_id, r.text) for r in df.collect()}
        want = collections.Counter()
        for r in df.collect():
            e = lib.encode(r.text or "", add_special_tokens=False).ids
            d = lib.decode(e, skip_special_tokens=False)
            want[r.doc_id, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()] += 1
        assert rows and collections.Counter(tuple(r) for r in bpe.round_trip(df).collect()) == want
    assert bpe.round_trip(none(docs)).count() == 0
    assert {r.decoded for r in bpe.round_trip(docs, keep_texts=True).collect()} == {t or "" for _, t in TEXTS}


def test_bpe_in_chunks(monkeypatch):
    lib, b, r = library(), bpe.loaded(bpe.tokenizer_spec()), random.Random(4)
    pool = list("ab' \t\nstredllve.,!09²½ªéɐ 　日語\U0001f600\x1c\x85ΩЖ٣Ⅷ") + ["the", "'s", "   "]
    for chunk in (3, 50, 1 << 16):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        for _ in range(150):
            x = "".join(r.choice(pool) for _ in range(r.randint(0, 40))) + r.choice(["a" * 2000, " " * 90, "1" * 80, "ab" * 900, "\n " * 30, ""]) + "".join(r.choice(pool) for _ in range(20))
            assert b.encode_text(x) == ",".join(map(str, lib.encode(x, add_special_tokens=False).ids))


def test_lookahead_suffices():
    """Random merge lists: encoding in windows equals encoding as a whole."""
    r = random.Random(8)
    of = bpe.byte_alphabet()
    by_byte = {v: k for k, v in of.items()}
    for _ in range(40):
        tokens = [by_byte[c] for c in b"abc"]
        vocab, merges = {t: i for i, t in enumerate([by_byte[x] for x in range(256)])}, []
        for _ in range(r.randint(3, 25)):
            u, v = r.choice(tokens), r.choice(tokens)
            if u + v not in vocab and len(u + v) < 9:
                vocab[u + v] = len(vocab)
                tokens.append(u + v)
                merges.append([u, v])
        import json

        b = bpe.Bpe(json.dumps({"model": {"vocab": vocab, "merges": merges}, "added_tokens": []}))
        b.window = b.lookahead + 2  # as small as it may be
        for _ in range(20):
            x = bytes(r.choice(b"abc") for _ in range(r.randint(0, 200)))
            run = bpe.Run(b)
            out = [t for i in range(0, len(x), 3) for t in run.feed(x[i : i + 3])] + run.finish()
            assert out == b.merged(x) == (b.merged_many([x])[0] if x else [])


def test_token_counts(docs, real):
    lib = library()
    for df in (docs, real):
        n = sorted(len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect())
        got = {r.n_tokens: r for r in token_counts.length_histogram(token_counts.token_lengths(df)).collect()}
        assert {k: r.n_docs for k, r in got.items()} == collections.Counter(n)
        for k, r in got.items():
            assert (r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == (sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n))
            assert abs(r.quantile - sum(x <= k for x in n) / len(n)) < 1e-12
    report = {r.context: tuple(r)[1:] for r in token_counts.context_report(token_counts.length_histogram(token_counts.token_lengths(real)), [0, 100, 10**6]).collect()}
    assert report == {c: (sum(x <= c for x in n), sum(x > c for x in n), sum(min(x, c) for x in n)) for c in (0, 100, 10**6)}
    assert token_counts.length_histogram(token_counts.token_lengths(none(docs))).count() == 0


# --- 5 ---
def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op5_quality(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len(held) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (2, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit(docs, labels)).collect()
    by = collections.defaultdict(set)
    for r in scored:
        by[r.doc_id].add(round(r.score, 9))
    assert len(scored) == len(TEXTS) and all(len(v) == 1 for v in by.values()) and by[1] == by[2] and by[3] == by[4] == by[5]
    assert {round(r.score, 9) for r in quality.score(docs, quality.fit(docs, none(labels))).collect()} == {0.5}
    assert quality.score(none(docs), quality.Model()).count() == 0


# --- 7 ---
def test_lm_matches_the_automaton(spark, docs):
    r = random.Random(2)
    words = ["a", "B", "b", "c", "the", "</s>", "é", ""]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12))) if i % 7 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).sortWithinPartitions("doc_id")
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for order in (1, 2, 3):
        machine = lm.Automaton(train, order)
        for g in lm.score(df, lambda c: remainder(c, 5) == 1, order=order).collect():
            text = (dict(rows)[g.doc_id] or "").encode()
            seq = [*text.lower().split(), None]
            base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in seq)
            assert (g.n_tokens, g.n_known, g.train_tokens) == (len(seq), sum(w in counts for w in seq), n)
            assert abs(g.base_score - base) < 1e-9 and abs(g.score - machine.score(text)) < 1e-9
    odd = lm.score(docs, lambda c: remainder(c, 5) == 1).collect()
    assert len(odd) == len(TEXTS) and {r.n_tokens for r in odd if r.doc_id in (3, 4, 5)} == {1}
    assert lm.score(none(docs), lambda c: F.lit(False)).count() == 0
    assert {r.base_score for r in lm.score(docs, lambda c: F.lit(True)).collect()} == {0.0}


def test_lm_blocks(spark, real, monkeypatch):
    want = {r.doc_id: r.score for r in lm.score(real, lambda c: remainder(c, 5) == 1).collect()}
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 1)
    got = {r.doc_id: r.score for r in lm.score(real, lambda c: remainder(c, 5) == 1).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_lm_learns(spark):
    rows = lm.op7_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_probabilities_add_up():
    m = lm.Automaton([b"a b a", b"a c", b"b b"])
    for h in [(lm.START,), (b"a",), (b"b",)]:
        p = 0.0
        for w in [*(g for g in m.arcs[()]), "unknown"]:
            x, k = 0.0, h
            while k and w not in m.arcs.get(k, {}):
                x, k = x + m.fail.get(k, 0.0), k[1:]
            p += 10 ** (x + m.arcs.get(k, {}).get(w, m.unknown))
        assert abs(p - 1) < 1e-9


# --- 8 ---
def test_media(spark, docs):
    folder = new_folder(spark, "media")
    rows, index = media.store(docs, folder)
    assert rows.count() == len(TEXTS) and index.count() == len({t or "" for _, t in TEXTS}) == len(media.member_names(folder.removeprefix("file:")))
    got = rows.join(media.features(index, folder), "digest").collect()
    assert len(got) == len(TEXTS)
    texts = collections.defaultdict(set)
    for i, t in TEXTS:
        texts[i].add(t or "")
    for r in got:
        (t,) = texts[r.id]
        raw = t.encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        png = media.to_png(raw)
        assert media.from_png(png) == want
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]), len(png), hashlib.sha256(png).hexdigest())
    heads = media.header_columns(index, folder).collect()
    assert all(h.width == 64 and h.height * 64 >= h.n_bytes == h.header_n_bytes and h.depth == 8 for h in heads)
    rows, index = media.store(none(docs), folder + "0")
    assert rows.count() == index.count() == 0


# --- 9 ---
def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    ok = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    out += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and ok(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_base_spans(spark, real, docs):
    r = random.Random(3)
    pool = list("ab@@..--__%+ +((01234567890123456789)) é\n") + ["a@b.c", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (415) 555-2671"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(3000)] + [x.text for x in real.collect()]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)
    got = {x.doc_id: x for x in pii.find(real).collect()}
    for x in real.collect():
        assert got[x.doc_id].base_spans == pii.shown(plain_spans(x.text))
        assert set(filter(None, got[x.doc_id].base_spans.split(","))) <= set(got[x.doc_id].spans.split(","))
    odd = pii.find(docs).collect()
    assert len(odd) == len(TEXTS) and {x.redacted for x in odd if x.doc_id == 3} == {""}
    assert pii.find(none(docs)).count() == 0


def test_pii_candidates():
    trees, limits, accuracy = pii.train()
    assert accuracy > 0.97
    found = lambda t: pii.shown(pii.select(t, trees, limits))
    assert found("mail bob.smith [at] corp [dot] com please") == "email:5:34" and found("my card is 4111.1111.1111.1111 ok") == "card:11:30" and found("date 2024-10-11") == ""
    assert pii.redacted("x a@b.co y", pii.base_spans("x a@b.co y")) == "x [EMAIL] y"


def test_pii_written_at():
    r = random.Random(9)
    pool = ["a", "b.c", "x-y", " ", " ", ".", "[at]", "(at)", " [ at ] ", " at ", " AT ", " dot ", "[dot]", " {Dot} ", "at", "that", "\u0130", "\n", "@", "com", "z" * 150]
    for _ in range(4000):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 14)))
        assert {m.span() for m in pii.WIDE["email"].finditer(t)} <= set(pii.wide_emails(t)), t
        for s, e in pii.wide_emails(t):
            assert pii.WIDE["email"].fullmatch(t, s, e)
    trees, limits, _ = pii.train()
    found = lambda t: [t[s:e] for s, k, e in pii.select(t, trees, limits) if k == 0]
    for x in ("john [at] example.com", "john (at) example.co.uk", "john[AT]mail-host.org", "john {at} example.com", "bob [at] corp [dot] com"):
        assert found(f"the owner {x}, then") == [x] and found("\u0130" * 200 + f" mail {x}, then") == [x]
    assert found("please write to john.smith at example.com today") == ["john.smith at example.com"]
    assert found("have a look at google.com for more") == found("they met at noon.Then they left") == []


# --- 10 ---
def test_decontamination(spark, docs, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    r = random.Random(5)
    rows, want = [], set()
    for n, b in enumerate(bench):
        w = b.text.split()
        edited = list(w)
        edited[len(w) // 2] = "ANDERS"
        for m, (t, hit) in enumerate(((" ".join(w), True), (" ".join(x.upper() + "," for x in w), True), (" ".join(edited), len(w) > 52), (" ".join(w[: len(w) // 2]), False))):
            pad = [f"{r.choice('xyz')}{r.randrange(9999)}" for _ in range(200)]
            rows.append((n * 10 + m, " ".join([*pad[:90], t, *pad[90:]])))
            if hit:
                want.add((n * 10 + m, b.item_id))
    items = spark.createDataFrame([(b.item_id, b.text) for b in bench] + [(900, None), (901, "zwei Worte"), (902, "?!")], "item_id long, text string")
    df = spark.createDataFrame([*rows, (7001, "ja zwei worte nein"), (7002, None), (7002, None)], "doc_id long, text string")
    for part in (20_000, 7):
        got = {(x.doc_id, x.item_id) for x in decontaminate.search(df, items, part_items=part).collect()}
        assert want | {(7001, 901)} <= got and not {(i, j) for i, j in got if i % 10 == 3 and i < 7000}
    B = decontaminate.Benchmark([(b.item_id, b.text) for b in bench])
    for x in real.limit(60).collect():  # every window of every item
        h = decontaminate.word_hashes(x.text)
        s, found = decontaminate.shingles(h, 5), {j for j, *_ in B.matches(h)}
        for j in range(len(B.items)):
            size = min(len(B.shingles[j]), len(s))
            near = np.isin(s, B.shingles[j])
            hit = any(near[a : a + size].any() and (lambda p: 100 * p[0] >= 80 * p[1])(B.similarity(s[a : a + size], j)) for a in range(len(s) - size + 1)) if size else False
            assert hit == (j in found)
    assert decontaminate.search(none(docs), items).count() == 0 and decontaminate.search(docs, none(items)).count() == 0
    assert decontaminate.without(df, items).where("doc_id = 7002").count() == 2


def test_decontamination_in_parts(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    common = [[r.choice(words) for _ in range(12)] for _ in range(4)]
    items = [(i, " ".join(r.choice(common) + [r.choice(words) for _ in range(r.randint(8, 30))] + r.choice(common))) for i in range(60)] + [(60, ""), (61, None), (62, "two words")]
    texts = []
    for i, t in items * 6:
        w = [r.choice(words) if r.random() < 0.04 else x for x in (t or "").split()]
        texts.append((len(texts), " ".join([r.choice(words) for _ in range(5)] + r.choice(common) + w + r.choice(common))))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(tuple, decontaminate.search(docs, bench, part_items=n).collect())) for n in (1000, 20, 5)]
    assert got[0] and any(x[2] < 0.85 for x in got[0]) and got[1] == got[0] and got[2] == got[0]
    assert decontaminate.without(docs, bench, part_items=5).count() == decontaminate.without(docs, bench).count()


# --- whole contracts beside neighbours, sizes and orders ---
def test_quality_of_a_text_depends_on_nothing_beside_it(spark, real):
    model = quality.fit(real, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [b"hello world this is a short text", b"next", b"", b"\n" * 200, b"  a b", b"x" * 5000 + b" y  \n ", "größe ".encode() * 500] + [r.text.encode() for r in real.limit(20).collect()]
    alone = [model.score_texts([t])[0] for t in texts]
    r = random.Random(1)
    for _ in range(10):
        order = [r.randrange(len(texts)) for _ in range(40)]
        assert np.array_equal(model.score_texts([texts[i] for i in order]), [alone[i] for i in order])


def test_quality_learns_from_a_bounded_part_of_long_texts(spark):
    rows = [(1, "good words here. " * 40_000), (1, "other text"), (2, "|| $$ 99 " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.w is not None and len(quality._spread(np.zeros((10**5, 3)))) == quality.SAMPLE_PASSAGES
    assert quality.score(docs, model).count() == 3


def test_the_host_decides_in_spark(spark):
    """Pages that by themselves would be read at another place, on a host whose other pages vote; with and without a broadcast."""
    prose, side = "the story goes on here " * 12, "another block of text " * 20
    page = lambda a, b: f"<body><div class='story-x'><p>{a}</p></div><div class='y'><a href=1>{b}</a></div></body>"
    odd = f"<body><div class='story-x'><p>{prose}</p></div><div class='y'><p>{side}</p><p>{side}</p></div><div class='z'><a href=1>{side}</a></div></body>"
    rows = [(i, f"https://User@Host.example:80/{i}", page(prose, side)) for i in range(6)] + [(6, "http://host.example/6", odd), (7, "http://other.example/", odd)]
    rows += [(10 + i, f"http://h{i}.example/", page(prose, side)) for i in range(5)] + [(20, None, odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [{r.page_id: r.text for r in html_extract.extract(pages, broadcast_bytes=n).collect()} for n in (1 << 20, 0)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert got[0][6] == prose.strip() and side.strip() in got[0][7] and side.strip() in got[0][20]
    plan = html_extract.extract(pages)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(host" not in plan


def test_host_of(spark):
    urls = {"http://A.example/x": "a.example", "https://u:p@b.example:8080/": "b.example", "//c.example?x": "c.example", "http://[::1]:80/": "[::1]", "/path": None, "mailto:x@y": None, "": None, None: None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", html_extract.host_of(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in rows} == urls


def test_links_in_large_buckets(spark, monkeypatch):
    """Boilerplate of two thirds fills buckets with documents that aren't alike; some beside them are."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    boiler = [r.choice(words) for _ in range(60)]
    rows = []
    for _ in range(150):
        own = [r.choice(words) for _ in range(34)]
        for _ in range(r.choice([1, 1, 2, 3])):
            t = boiler + own
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t)))
    r.shuffle(rows)
    want = plain_components(sets_of(rows, 2))
    calls = []
    rare = minhash._rare_groups
    monkeypatch.setattr(minhash, "_rare_groups", lambda *x: calls.append(1) or rare(*x))
    monkeypatch.setattr(minhash, "SQUARE", 16)
    monkeypatch.setattr(minhash, "LARGE", 16)
    assert {x.doc_id: x.component_id for x in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()} == want
    assert calls
    calls.clear()
    monkeypatch.setattr(minhash, "LARGE", 1000)
    assert {x.doc_id: x.component_id for x in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()} == want
    assert not calls


def own_similarity(doc, item, k, weight, total):
    """The largest weighted similarity of an item to the windows of its length, from words."""
    import string

    clean = lambda t: t.casefold().translate({ord(c): " " for c in string.punctuation}).split()
    w, v = clean(doc), clean(item)
    k = min(k, len(v))
    grams = lambda x: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
    size, best = len(v), 0.0
    b = collections.Counter(grams(v))
    for at in range(max(1, len(w) - size + 1)):
        a = collections.Counter(grams(w[at : at + size]))
        of = lambda g: weight.get(g, total)
        both, either = sum(min(a[g], b[g]) * of(g) for g in a), sum(max(a[g], b[g]) * of(g) for g in a.keys() | b.keys())
        best = max(best, both / either if either else 0.0)
    return best


def test_decontamination_by_its_own_measure(spark):
    """400 items with a lead in common; edited copies; the rows are the same for every part size, and those of a measure of its own."""
    r = random.Random(21)
    words = [f"v{i}" for i in range(900)]
    lead = [r.choice(words) for _ in range(8)]
    items = [(i, " ".join(lead + [r.choice(words) for _ in range(56)])) for i in range(400)]
    docs = []
    for i, t in items[:60]:
        w = t.split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = "neu"
        docs.append((i, " ".join([r.choice(words) for _ in range(6)] + w + [r.choice(words) for _ in range(6)])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(tuple(x) for x in decontaminate.search(d, b, part_items=n).collect()) for n in (10_000, 100, 37)]
    assert got[0] == got[1] == got[2]
    count = collections.Counter(g for _, t in items for g in {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)})
    of = lambda n: 1 + round(4 * np.log2(1 + len(items) / n))
    weight, most = {g: of(n) for g, n in count.items()}, of(1)
    want = {(i, j) for i, t in docs for j, x in items[:60] if own_similarity(t, x, 5, weight, most) >= 0.8}
    assert {x[:2] for x in got[0]} == want and len(want) > 25
    assert all(abs(x[2] - own_similarity(dict(docs)[x[0]], dict(items)[x[1]], 5, weight, most)) < 1e-9 for x in got[0])


def test_decontamination_in_small_steps(monkeypatch, spark):
    bench = [(b.item_id, b.text) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [decontaminate.word_hashes(f"x y {t} z {u}") for (_, t), (_, u) in zip(bench, bench[1:])]
    B = decontaminate.Benchmark(bench)
    want = [B.matches(h) for h in texts]
    monkeypatch.setattr(decontaminate, "CELLS", 7)
    assert [B.matches(h) for h in texts] == want and all(want)


def test_lm_block_ends_with_its_text(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    monkeypatch.setattr(lm, "BLOCK_TOKENS", 10)
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    b = pa.record_batch([pa.array(range(9)), pa.array(["a b c"] * 8 + ["w " * 50]), pa.array([False] * 9)], ["id", "text", "held_out"])
    found = list(lm._blocks(iter([b, b]), 2))
    assert [n for n, _, _ in found] == [(3 << 24) + i for i in range(len(found))] and all(len(x.lengths) <= 3 for _, _, x in found)
    assert [i for _, ids, _ in found for c, _ in ids for i in c.to_pylist()] == [*range(9), *range(9)]


def test_lm_machine_walks_alike(monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 30))).encode() for _ in range(60)] + [b"a b " * 300, b""]
    train = [r.random() < 0.7 for _ in texts]
    for order in (1, 2, 3, 4):
        block = lm.Block([lm.tokens(t) for t in texts], train, order)
        n, v = int(block.counts[0].sum()), int((block.counts[0] > 0).sum())
        machine = lm.Automaton([t for t, x in zip(texts, train) if x], order)
        for few in (0, 12, 1000):
            monkeypatch.setattr(lm, "FEW", few)
            assert np.allclose(lm.traverse(block, block.counts, n, v, lm.K)[3], [machine.score(t) for t in texts], atol=1e-9)


def test_media_query_fills_columns_from_headers(spark):
    rows = {r.doc_id: r for r in media.op8_media(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw, r = (d.text or "").encode(), rows[d.doc_id]
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = np.frombuffer(padded, np.uint8).astype(float)
        assert (r.n_bytes, r.width, r.height, r.depth) == (len(raw), 64, len(padded) // 64, 8)
        import json

        f = json.loads(r.feature)
        p = np.array([c / len(padded) for c in collections.Counter(padded).values()])
        assert (f["w"], f["h"]) == (64, len(padded) // 64) and abs(f["mean"] - x.mean()) < 1e-3 and abs(f["spread"] - x.std()) < 1e-3 and abs(f["entropy"] + (p * np.log2(p)).sum()) < 1e-3


def test_warc_headers(spark):
    pages = spark.createDataFrame([(3, "http://a/3", "<p>1"), (1, "http://a/1", "<p>1"), (2, None, None)], "page_id long, url string, html string")
    path = new_folder(spark, "warc")
    warc.write_archive(pages, path)
    heads = [dict(x.split(": ", 1) for x in bytes(r.header).decode().strip().split("\r\n")[1:]) for r in spark.read.parquet(f"{path}/records").collect()]
    by = {h["X-Page-ID"]: h for h in heads}
    assert by["3"]["WARC-Refers-To"] == by["1"]["WARC-Record-ID"] and by["3"]["WARC-Refers-To-Target-URI"] == "http://a/1" and by["3"]["WARC-Profile"] == warc.REVISIT_PROFILE
    assert by["3"]["Content-Length"] == "0" and "WARC-Block-Digest" not in by["3"] and by["1"]["WARC-Block-Digest"] == by["1"]["WARC-Payload-Digest"]
    assert by["1"]["Content-Type"].startswith("text/html") and "WARC-Profile" not in by["1"] and "WARC-Target-URI" not in by["2"]
    assert {r.page_id for r in warc.read_archive(spark, path, "string").collect()} == {"1", "2", "3"}


def test_context_report_between_lengths(spark):
    hist = token_counts.length_histogram(spark.createDataFrame([(n,) for n in (0, 3, 3, 500, 4000)], "n_tokens long"))
    got = {r.context: tuple(r)[1:] for r in token_counts.context_report(hist, [0, 2, 3, 3, 600, 10**7]).collect()}
    n = (0, 3, 3, 500, 4000)
    assert got == {c: (sum(x <= c for x in n), sum(x > c for x in n), sum(min(x, c) for x in n)) for c in (0, 2, 3, 600, 10**7)}
    assert [tuple(r) for r in token_counts.context_report(hist.where("false"), [5]).collect()] == [(5, 0, 0, 0)]
