"""Operator 4: the exact histogram of encoded lengths, with suffix sums.

Every document is encoded as a whole; documents are aggregated by length before anything is shuffled. For each length n
that occurs: n_docs of that length; docs_at_least and tokens_at_least, the documents of n tokens or more and their
tokens; truncated_tokens, what is left of the corpus when every document is cut to n tokens; quantile, the share of
documents of at most n tokens. `context_report` answers any context limit from these rows, exactly.

The suffix sums run in two levels, within blocks of lengths and over the few blocks, so no task gets all lengths.

Cases: null and empty texts have length 0 and count as documents; a text of any length is encoded as a whole, its tokens only
counted; documents of equal length share a row; repeated rows count each; an empty table gives no rows; columns other than
the text are ignored, whatever their names.
"""

from __future__ import annotations

import operator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import loaded, tokenizer_spec, transduce
from .common import by_rows, kept, small_batches, table

#: Lengths in one block of the suffix sums.
BLOCK = 256


def token_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens of every row."""
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = [0] * b.num_rows
        commas = operator.methodcaller("count", ",")

        def add(i: int, groups: list[str]) -> None:
            counts[i] += sum(map(commas, groups)) + len(groups)

        transduce(loaded(spec.value), [t or "" for t in b.column(0).to_pylist()], add)
        return pa.record_batch([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select(text_col).mapInArrow(by_rows(run), "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """The histogram of a column n_tokens with its suffix sums."""
    hist = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    hist, _ = kept(hist, "lengths")  # used twice: texts must not be encoded twice
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("n_tokens") * F.col("n_docs")
    rows = hist.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum(mass).over(inside)})
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(mass).alias("bt"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block", (F.sum("bd").over(above) - F.col("bd")).alias("d0"), (F.sum("bt").over(above) - F.col("bt")).alias("t0"),
        F.sum("bd").over(every).alias("docs"), F.sum("bt").over(every).alias("tokens"),
    )
    at = rows.join(blocks, "block").withColumns({"docs_at_least": F.col("d") + F.col("d0"), "tokens_at_least": F.col("t") + F.col("t0")})
    return at.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )


def context_report(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that fit, documents that are cut, and tokens kept. Limits need not occur as lengths.

    Read from the suffix sums of the next length above a limit: one pass over the histogram, whatever the limits. Without
    documents every figure is 0; repeated limits have one row.
    """
    limits = sorted({int(x) for x in limits})
    above = [F.min(F.when(F.col("n_tokens") > c, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"c{i}") for i, c in enumerate(limits)]
    one = hist.agg(F.max("docs_at_least").alias("docs"), F.max("tokens_at_least").alias("tokens"), *above)
    rows = []
    for i, c in enumerate(limits):
        cut, beyond = (F.coalesce(F.col(f"c{i}.{x}"), F.lit(0)) for x in ("docs_at_least", "tokens_at_least"))
        docs, tokens = F.coalesce("docs", F.lit(0)), F.coalesce("tokens", F.lit(0))
        rows.append(F.struct(F.lit(c).cast("long").alias("context"), (docs - cut).alias("docs_that_fit"), cut.alias("docs_cut"), (tokens - beyond + cut * c).alias("tokens_kept")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
