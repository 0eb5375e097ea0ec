"""The pipeline's stages one by one against plain versions, on their own inputs."""

import zlib

import corpus_pipeline
from quercus.llm import bpe, decontaminate, pii, quality
from tests_llm_helpers import plain_components, sets_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = decontaminate.Benchmark([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    model = quality.fit(docs, labels, held_out=quality.is_held_out)
    trees, limits, _ = pii.train()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = {r.doc_id: r for r in docs.collect()}
        if n == 0:
            want = {i for i, r in before.items() if model.score_texts([r.text.encode()])[0] >= 0.5}
        elif n == 1:
            comp = plain_components(sets_of([(i, r.text) for i, r in before.items()], 5))
            want = {i for i, c in comp.items() if i == c}
        elif n == 2:
            want = {i for i, r in before.items() if not bench.matches(decontaminate.word_hashes(r.text))}
        else:
            want = set(before)
        assert set(after) == want, name
        if n < 4:
            assert docs.columns == columns
        if n < 3:
            assert all(after[i] == before[i] for i in after)
        elif n == 3:
            for i, r in before.items():
                assert after[i].text == pii.redacted(r.text, pii.select(r.text, trees, limits)) and after[i].n_chars == len(after[i].text)
        else:
            b = bpe.loaded(bpe.tokenizer_spec())
            for i, r in before.items():
                joined = b.encode_text(r.text)
                assert after[i].n_tokens == (joined.count(",") + 1 if joined else 0)
    good = {r.doc_id for r in labels.where("quality = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names the operators use."""
    long = "ein gutes Wort nach dem andern steht hier im Satz. " * 4000
    texts = [(1, "Ein Text mit genug Worten, der so nur einmal vorkommt."), (1, "Ein Text mit genug Worten, der so nur einmal vorkommt."), (2, None), (3, ""), (4, "  "), (None, "Ein anderer Text ohne Nummer, aber mit Adresse a.b@example.com."), (5, long), (6, long), (7, "kurz")]
    rows = [(i, t, "de", "s", len(t or ""), "x", 0.5, 9) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string, score double, id long")
    columns = docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "ganz andere Worte stehen in diesem Eintrag")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/stage{n}")
        df = spark.read.parquet(f"{tmp_path}/stage{n}")
        if n < 4:
            assert df.columns == columns
        sizes.append(df.count())
    assert sizes == [9, 8, 8, 8, 8]  # one of the two long copies goes
    last = {r.doc_id: r.n_tokens for r in df.collect()}
    assert last[2] == last[3] == 0 and last[7] > 0 and None in last
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
