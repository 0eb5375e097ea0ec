"""Authority names (inventory B6, R6, B25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import inverted_name, normalized, own_case, unescape
from .families import components


def usual_spelling(names: DataFrame, least: int = 2) -> DataFrame:
    """Of each family the most frequent spelling with `least` occurrences; ties: more accented letters, then the smaller bytes. names: fid, name.

    A spelling of mixed case stays; another one gets title case.
    """
    clean = F.trim(F.regexp_replace(unescape(F.col("name")), r"\s+", " "))
    n = names.select("fid", clean.alias("name")).where("name <> ''").groupBy("fid", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    accents = F.length(F.regexp_replace("name", r"[\x00-\x7F]", ""))
    w = Window.partitionBy("fid").orderBy(F.desc("n"), F.desc(accents), "name")
    best = n.withColumn("place", F.row_number().over(w)).where("place = 1")
    return best.select("fid", own_case(F.col("name")).alias("shown"), "n")


# The sources of titles in their order: those that keep accents first.
TITLE_SOURCES = ["scielo", "doaj", "latindex", "scopus", "wos", "openalex", "pubmed"]


def display_names(rows: DataFrame, candidates: DataFrame, names: DataFrame) -> DataFrame:
    """Of each family the shown name and where it is from: the first source in order that has a title, else the usual spelling of the curricula (two or more), else the
    title of the family's own row.

    A name of plain ASCII gives way to the spelling of the same key with most accented letters, of all there are; a name in one case gets N17.
    rows: id, fid, title; candidates: fid, source, n (order), title; names: fid, name (one row an article). Ties of spellings: the smaller one.
    """
    clean = lambda c: F.trim(F.regexp_replace(unescape(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    place = F.array_position(F.array(*map(F.lit, TITLE_SOURCES)), F.col("source"))
    told = candidates.select("fid", "source", "n", clean("title").alias("title"), place.alias("p")).where("title <> '' AND p > 0")
    best = told.groupBy("fid").agg(F.min(F.struct("p", "n", "title", "source")).alias("x")).select("fid", F.col("x.title").alias("t1"), F.col("x.source").alias("s1"))
    said = names.select("fid", clean("name").alias("name")).where("name <> ''")
    n = said.groupBy("fid", "name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    accents = lambda c: F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    usual = n.groupBy("fid").agg(F.min(F.struct((-F.col("n")).alias("n"), (-accents(F.col("name"))).alias("a"), "name")).alias("x")).select("fid", F.col("x.name").alias("t2"))
    own = rows.groupBy("fid").agg(F.min_by(clean("title"), F.struct((F.col("id") != F.col("fid")).alias("o"), "id")).alias("t3"))
    chosen = own.join(best, "fid", "left").join(usual, "fid", "left").select("fid", F.coalesce("t1", "t2", "t3").alias("title"), F.when(F.col("t1").isNotNull(), F.col("s1")).when(F.col("t2").isNotNull(), "lattes").otherwise("title").alias("source"))
    spellings = rows.select("fid", clean("title").alias("sp")).unionByName(told.select("fid", F.col("title").alias("sp"))).unionByName(said.select("fid", F.col("name").alias("sp"))).where("sp <> ''").distinct()
    keyed = spellings.select("fid", "sp", normalized(F.col("sp")).alias("key"), accents(F.col("sp")).alias("a")).where("a > 0")
    richest = keyed.groupBy("fid", "key").agg(F.min(F.struct((-F.col("a")).alias("a"), "sp")).alias("x")).select("fid", "key", F.col("x.sp").alias("accented"))
    c = chosen.where("title <> ''").withColumn("key", normalized(F.col("title"))).join(richest, ["fid", "key"], "left")
    title = F.when(F.col("title").rlike(r"[^\x00-\x7F]"), F.col("title")).otherwise(F.coalesce("accented", "title"))
    return c.select("fid", F.substring(own_case(title), 1, 255).alias("shown"), "source")


def identities(names: DataFrame) -> DataFrame:
    """Name, identity: names that share a key, as written or inverted, directly or through others, are one; its number is the smallest key.

    The order in which names come has no part in it.
    """
    n = names.select("name").where("name IS NOT NULL").distinct()
    keys = n.select("name", normalized(F.col("name")).alias("a"), normalized(inverted_name(F.col("name"))).alias("b")).where("a <> ''")
    c = components(keys.select("a", F.when(F.col("b") == "", F.col("a")).otherwise(F.col("b")).alias("b")))
    return keys.join(c.select(F.col("node").alias("a"), F.col("root").alias("identity")), "a").select("name", "identity")


def affiliations(experiences: DataFrame, own: str, as_of_year: int) -> DataFrame:
    """Of each researcher the first year at the own institution, the last one if none is current, and whether one is. experiences: researcher_id, institution_name, start_year, end_year, is_current."""
    e = experiences.where(F.col("institution_name") == own)
    now = F.col("is_current") | F.coalesce(F.col("end_year") >= as_of_year, F.lit(False))
    g = e.groupBy("researcher_id").agg(F.min("start_year").alias("admission_year"), F.max("end_year").alias("last"), F.max(now).alias("active"))
    return g.select("researcher_id", "admission_year", F.when(~F.col("active"), F.col("last")).alias("leave_year"), "active")
