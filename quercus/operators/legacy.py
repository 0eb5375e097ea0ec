"""Evidence of a journal's areas that its own rows hold, and its versions (inventory B10).

Evidence is kept by source: a new load of a source retires that source's old rows and no others (`PartedTable`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..sources.keyed import PartedTable

# The longest value that is one area, and the longest label.
AREA_CHARS, LABEL_CHARS = 150, 255


def _case_key(c):
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def legacy_evidence(journals: DataFrame, areas: DataFrame, known: DataFrame, canonical: DataFrame) -> DataFrame:
    """journal_id, source, record_key, label, weight from what a row gives as its area: the raw value, else the area.

    It counts if it is one value (no stroke, 150 characters at most) that is an area's name, whatever its case; or its name in capitals without accents; or what the thesaurus
    knows. A value that comes from the area, not the raw one, and is a label that the classifier writes is its own output and doesn't count. journals: id, area_raw, area; areas: name;
    known, canonical: value.
    """
    raw = F.nullif(F.col("area_raw"), F.lit(""))
    original = F.coalesce(raw, F.nullif(F.col("area"), F.lit("")))
    j = journals.select("id", raw.isNull().alias("from_area"), original.alias("value")).where(F.col("value").isNotNull() & ~F.contains("value", F.lit("|")) & (F.length("value") <= AREA_CHARS))
    j = j.withColumn("value", F.trim("value")).withColumns({"case_key": _case_key(F.col("value")), "plain": F.when(F.col("value") == F.upper("value"), normalized(F.col("value")))})
    flag = lambda df, c, name: df.select(c.alias(name)).distinct().withColumn(f"is_{name}", F.lit(True))
    # Values repeat in many rows, and the lists are short vocabularies.
    values = j.select("value", "case_key", "plain").distinct()
    values = values.join(flag(areas, _case_key(F.col("name")), "case_key"), "case_key", "left").join(flag(areas, normalized(F.col("name")), "plain"), "plain", "left")
    values = values.join(flag(known, F.col("value"), "value").withColumnRenamed("is_value", "is_known"), "value", "left").join(flag(canonical, F.trim("value"), "value").withColumnRenamed("is_value", "is_canonical"), "value", "left")
    good = values.where("is_case_key OR is_plain OR is_known").select("value", F.coalesce("is_canonical", F.lit(False)).alias("is_canonical"))
    out = j.join(good, "value").where(~(F.col("from_area") & F.col("is_canonical")))
    return out.select(F.col("id").alias("journal_id"), F.lit("legacy").alias("source"), F.lit("area").alias("record_key"), F.substring("value", 1, LABEL_CHARS).alias("label"), F.lit(1).cast("decimal(6,4)").alias("weight"))


def load_evidence(store: PartedTable, evidence: DataFrame, source: str, batch: str) -> None:
    """The rows of one source become its current ones."""
    store.load(source, evidence.where(F.col("source") == source).select("journal_id", "source", "record_key", "label", F.col("weight").cast("decimal(6,4)").alias("weight")), batch)


def current_evidence(store: PartedTable) -> DataFrame:
    return store.read().drop("part")
