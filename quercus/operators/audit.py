"""The audit of articles' journal links: states, differences, transitions and known bad cases (inventory A61, Z10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized

# Fixed value: what articles without a stratum count under.
NO_STRATUM = "Sem Qualis"


def link_state(items: DataFrame, links: DataFrame) -> DataFrame:
    """id, journal_id, qualis and the sorted databases of every article. links: journal_id, acronym. An empty stratum is none."""
    bases = links.groupBy("journal_id").agg(F.array_sort(F.collect_set("acronym")).alias("databases"))
    a = items.where("item_type = 'ARTIGO'").select("id", F.col("qualis_journal_id").alias("journal_id"), F.nullif("qualis", F.lit("")).alias("qualis"))
    return a.join(bases, "journal_id", "left").select("id", "journal_id", "qualis", F.coalesce("databases", F.array().cast("array<string>")).alias("databases"))


def write_state(state: DataFrame, path: str, taken_at: str) -> None:
    """A snapshot as JSON lines, each with the time it was taken at; one that is there is an error."""
    state.withColumn("taken_at", F.lit(taken_at)).write.json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, journal_id long, qualis string, databases array<string>, taken_at string").json(path)


def _both(before: DataFrame, after: DataFrame) -> DataFrame:
    side = lambda df, n: df.select("id", F.struct("journal_id", "qualis", "databases").alias(n))
    return side(before, "b").join(side(after, "a"), "id", "full_outer")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Section, key, before, after: the articles by outcome (`links`: same, other_changes, changed, gained, lost, new, removed; in after), the totals, and the articles of
    each stratum and database before and after. Of the same journal with another stratum or other databases an article is in same and in other_changes."""
    j = _both(before, after)
    old, new = F.col("b.journal_id"), F.col("a.journal_id")
    outcome = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(old.eqNullSafe(new), "same").when(old.isNull(), "gained").when(new.isNull(), "lost").otherwise("changed")
    n = j.groupBy(outcome.alias("key"), (old.eqNullSafe(new) & ~F.col("a").eqNullSafe(F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull()).alias("other")).agg(F.count(F.lit(1)).alias("after"))
    outcomes = n.groupBy("key").agg(F.sum("after").cast("bigint").alias("after")).unionByName(n.where("other").groupBy(F.lit("other_changes").alias("key")).agg(F.sum("after").cast("bigint").alias("after")))
    out = outcomes.select(F.lit("links").alias("section"), "key", F.lit(None).cast("bigint").alias("before"), "after")

    def counts(df: DataFrame, name: str) -> DataFrame:
        base = df.select(F.lit("stratum").alias("section"), F.coalesce("qualis", F.lit(NO_STRATUM)).alias("key"))
        base = base.unionByName(df.select(F.lit("database").alias("section"), F.explode("databases").alias("key")))
        base = base.unionByName(df.select(F.lit("total").alias("section"), F.explode(F.array(F.lit("articles"), F.when(F.col("journal_id").isNotNull(), "linked"))).alias("key")).where("key IS NOT NULL"))
        return base.groupBy("section", "key").agg(F.count(F.lit(1)).alias(name))

    sums = counts(before, "before").join(counts(after, "after"), ["section", "key"], "full_outer").fillna(0, ["before", "after"])
    return out.unionByName(sums.select("section", "key", "before", "after"))


def transitions(before: DataFrame, after: DataFrame, titles: DataFrame, limit: int = 30) -> DataFrame:
    """The most frequent changes of a journal, from and to with their titles (null: no journal); ties by titles, then ids. titles: id, title."""
    j = _both(before, after).where("b IS NOT NULL AND a IS NOT NULL").select(F.col("b.journal_id").alias("from_id"), F.col("a.journal_id").alias("to_id"))
    n = j.where(~F.col("from_id").eqNullSafe(F.col("to_id"))).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))
    name = lambda c: titles.select(F.col("id").alias(f"{c}_id"), F.col("title").alias(f"{c}_title"))
    return n.join(name("from"), "from_id", "left").join(name("to"), "to_id", "left").orderBy(F.desc("n"), "from_title", "to_title", "from_id", "to_id").limit(limit)


def known_cases(items: DataFrame, journals: DataFrame, cases: dict[str, tuple[list[str], list[str], list[str]]], examples: int = 5) -> DataFrame:
    """Of each known bad case the linked articles that are one, with the smallest ids as examples; 0 where there are none.

    cases, a short list of the caller's: key -> (parts of the article's journal name, parts that it may not have, parts of the linked journal's title), all normalised here.
    """
    a = items.where("item_type = 'ARTIGO' AND qualis_journal_id IS NOT NULL").select("id", F.col("qualis_journal_id").alias("journal_id"), normalized(F.coalesce("journal_name", F.lit(""))).alias("name"))
    t = journals.select(F.col("id").alias("journal_id"), normalized(F.coalesce("title", F.lit(""))).alias("title"))

    def has(c: str, parts: list[str]):
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(F.col(c), normalized(F.lit(p)))
        return out

    # An article can be several cases; names are looked at before the join, so that few rows are joined.
    hit = lambda c: F.filter(F.array(*(F.when(c(x), F.lit(k)) for k, x in cases.items())), lambda k: k.isNotNull())
    named = a.withColumn("case", F.explode(hit(lambda x: has("name", x[0]) & ~has("name", x[1]))))
    titled = t.withColumn("case", F.explode(hit(lambda x: has("title", x[2]))))
    rows = named.join(titled.select("journal_id", "case"), ["journal_id", "case"])
    found = rows.groupBy("case").agg(F.count(F.lit(1)).alias("articles"))
    parts = [rows.where(F.col("case") == k).select("case", "id").orderBy("id").limit(examples) for k in cases]
    least = reduce(DataFrame.unionByName, parts).groupBy("case").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("examples"))
    keys = items.sparkSession.createDataFrame([(k,) for k in cases], "case string")
    return keys.join(found, "case", "left").join(least, "case", "left").select("case", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("examples", F.lit("")).alias("examples"))
