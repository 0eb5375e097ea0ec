"""Readers of repositories and journal sources that Spark reads itself (inventory S1, S10, S12, S13, S15, S17, S18); curricula are in `curriculum`, spreadsheets, lists and thesauri in `lists`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import issn_valid, issns

_S = T.StringType()


def _row(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


def theses(spark: SparkSession, path: str) -> DataFrame:
    """A thesis repository's CSV of 31 columns by position; the year from the date, else its first four digits."""
    raw = spark.read.schema(_row(*(f"c{i}" for i in range(31)))).csv(path, header=True, quote='"', escape='"', multiLine=True)
    day = F.try_to_timestamp(F.substring("c21", 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return raw.select(
        F.col("c0").alias("kind"), F.col("c1").alias("title"), F.col("c2").alias("alternative_title"), F.col("c3").alias("student_name"), F.split("c6", ";").alias("advisors"), F.regexp_extract_all(F.coalesce("c7", F.lit("")), F.lit(r"(\d{16})"), F.lit(1)).alias("advisor_ids"),
        F.col("c15").alias("program"), F.col("c16").alias("center"), F.col("c17").alias("campus"), day.alias("defense_date"), F.coalesce(F.year(day), F.regexp_extract("c21", r"^(\d{4})", 1).try_cast("int")).alias("year"),
        F.col("c22").alias("abstract"), F.split(F.coalesce("c23", F.lit("")), "[;,]").alias("keywords"), F.col("c26").alias("doi"), F.col("c29").alias("handle"), F.col("c30").alias("uuid"),
    )


def valid_issns(*columns: str) -> F.Column:
    """The distinct valid ISSNs of some columns, in order."""
    return F.filter(issns(F.concat_ws(" ", *columns)), issn_valid)


def _labels(c: F.Column, sep: str) -> F.Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != ""))


def _evidence(df: DataFrame, src: str, rec, issn, title, labels) -> DataFrame:
    return df.select(F.lit(src).alias("src"), rec.alias("rec"), issn.alias("issns"), title.alias("title"), labels.alias("labels"))


def doaj(spark: SparkSession, path: str) -> DataFrame:
    """Subjects separated by bars."""
    d = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return _evidence(d, "doaj", F.col("`URL in DOAJ`"), valid_issns("`Journal ISSN (print version)`", "`Journal EISSN (online version)`"), F.col("`Journal title`"), _labels(F.col("Subjects"), r"\|"))


def latindex(spark: SparkSession, path: str) -> DataFrame:
    """Semicolons and a byte order mark."""
    d = spark.read.csv(path, header=True, sep=";", quote='"', escape='"')
    d = d.toDF(*(c.lstrip("﻿") for c in d.columns))
    return _evidence(d, "latindex", F.col("folio_u"), valid_issns("issn_e", "issn_l", "issn_imp"), F.col("tit_propio"), _labels(F.col("subtemas"), ","))


def scielo(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map by ISSN with three groups of labels, each a source of its own."""
    value = "map<string,struct<title:string,issns:array<struct<issn:string,type:string>>,area:array<string>,wos:array<string>,desc:array<string>,status:string>>"
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", value)).alias("rec", "j"))
    issn = F.filter(issns(F.concat_ws(" ", F.col("rec"), F.array_join("j.issns.issn", " "))), issn_valid)
    parts = [_evidence(d, f"scielo_{g}", F.col("rec"), issn, F.col("j.title"), F.coalesce(F.col(f"j.{g}"), F.array().cast("array<string>"))) for g in ("area", "wos", "desc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.size("labels") > 0)


# The order of the indexes that decides which title stands.
WOS_PRIORITY = ["SCIE", "SSCI", "AHCI", "ESCI"]


def wos(spark: SparkSession, path: str) -> DataFrame:
    """All lists but JCR's; rows of the same ISSNs (else folded title) merge; the best index decides the title."""
    d = spark.read.option("pathGlobFilter", "*.csv").csv(path, header=True, quote='"', escape='"').withColumn("file", F.col("_metadata.file_name"))
    d = d.where(~F.startswith("file", F.lit("JCR")))
    d = d.withColumns({"issns": valid_issns("ISSN", "eISSN"), "index": F.upper(F.regexp_extract("file", r"^([A-Za-z]+)", 1))})
    key = F.when(F.size("issns") > 0, F.array_join(F.array_sort("issns"), ",")).otherwise(F.lower(F.trim("`Journal title`")))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, WOS_PRIORITY)), F.col("index")), F.lit(0)), F.lit(99))
    rows = d.withColumns({"key": key, "place": place, "label": F.explode_outer(_labels(F.col("`Web of Science Categories`"), r"\|"))})
    g = rows.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.min_by(F.col("`Journal title`"), F.struct("place", "file", "`Journal title`")).alias("title"), F.min_by("issns", F.struct("place", "file")).alias("issns"))
    return _evidence(g, "wos", F.col("key"), F.col("issns"), F.col("title"), F.col("labels"))


def openalex(spark: SparkSession, path: str) -> DataFrame:
    """Journals with a valid ISSN; a label's share is its topics' count over all, to four places."""
    schema = "id string, type string, display_name string, issn array<string>, works_count long, topics array<struct<count:long,subfield:struct<id:string>>>"
    d = spark.read.schema(schema).json(path).where("type = 'journal'").withColumn("issns", F.filter(issns(F.array_join("issn", " ")), issn_valid)).where(F.size("issns") > 0).dropDuplicates(["id"])
    t = d.select("id", F.explode("topics").alias("t")).groupBy("id", F.regexp_extract("t.subfield.id", r"(\d+)$", 1).alias("code")).agg(F.sum("t.count").alias("n"))
    w = Window.partitionBy("id")
    t = t.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4)).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "code", "share"))), lambda x: F.struct(x["code"].alias("code"), x["share"].alias("share"))).alias("labels"))
    return d.join(t, "id", "left").select(F.lit("openalex").alias("src"), F.col("id").alias("rec"), "issns", F.col("display_name").alias("title"), "labels", "works_count")
