"""The journals' production line: 22 steps in order, each an operator of this package over stored tables (inventory B31).

Sources: journals (id, title, issn, qualis, area, area_raw, canonical_journal_id, method, display_title, areas_locked), records (src, rec, title, issns, labels, country), items (id, item_type, title,
year, researcher_id, journal_name, issn, qualis_journal_id), links (journal_id, database_id), taxonomy (as `lists.taxonomy`), crosswalk (vocabulary, label, slug), thesaurus (as B15), and, if there are,
overrides (n, id, field, value) and ai_lines (n, line). A step whose source isn't there is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import resolver_key
from ..plans.steps import Pipeline, Step, Tables
from . import areas, curation, entities, families, journals as jn, legacy


def _normalized(t: Tables) -> Tables:
    return {"journals": t["journals"].withColumn("normalized_title", resolver_key(F.col("title")))}


def _snapshot(t: Tables) -> Tables:
    return {"links_before": t["items"].where("item_type = 'ARTIGO'").select("id", F.col("qualis_journal_id").alias("journal_id"))}


def _enriched(t: Tables) -> Tables:
    found = families.enriched_issns(t["journals"], t["records"].where("src = 'scielo'")).withColumnRenamed("issn", "__issn")
    return {"journals": t["journals"].join(found, "id", "left").withColumn("issn", F.coalesce(F.nullif("issn", F.lit("")), "__issn")).drop("__issn")}


def _thesaurus(t: Tables) -> Tables:
    labels = t["records"].select(F.col("src").alias("vocabulary"), F.explode("labels").alias("label"))
    usage = labels.groupBy("vocabulary", "label").agg(F.count(F.lit(1)).alias("occurrences"))
    return {"thesaurus": areas.synced_thesaurus(t["thesaurus"], t["taxonomy"], t["crosswalk"], usage)}


def _evidence(t: Tables) -> Tables:
    e = families.evidence(t["records"], t["journals"]).select(F.col("id").alias("journal_id"), F.col("src").alias("source"), F.col("rec").cast("string").alias("record_key"), "label", F.col("weight").cast("decimal(6,4)").alias("weight"))
    known = t["thesaurus"].where("status = 'active'").select(F.col("label").alias("value"))
    canonical = t["taxonomy"].select(F.col("name").alias("value")).where("false")
    return {"evidence": e.unionByName(legacy.legacy_evidence(t["journals"], t["taxonomy"].select("name"), known, canonical))}


def _families(t: Tables) -> Tables:
    j = t["journals"]
    n = t["items"].where("qualis_journal_id IS NOT NULL").groupBy(F.col("qualis_journal_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    f = families.families(j.withColumn("canonical", F.col("canonical_journal_id")), t["records"], n).select("id", "family")
    out = j.join(f, "id", "left").withColumn("canonical_journal_id", F.when(F.col("family") != F.col("id"), F.col("family"))).drop("family")
    return {"journals": out}


def _indexed(t: Tables) -> Tables:
    names = t["items"].where("item_type = 'ARTIGO'").select(F.col("journal_name").alias("name"), "issn").where("name IS NOT NULL OR issn IS NOT NULL")
    variants = t["names"].select(F.col("fid").alias("journal_id"), "name") if "names" in t else None
    found = jn.resolve(names, t["journals"], variants)
    plain = t["items"].drop("journal_id", "qualis", "databases", "qualis_journal_id")
    out = families.indexed(plain, found, jn.shown_stratum(t["journals"]), t["links"])
    return {"items": out.withColumnRenamed("journal_id", "qualis_journal_id")}


def _learned(t: Tables) -> Tables:
    fid = t["journals"].select(F.col("id").alias("qualis_journal_id"), F.coalesce("canonical_journal_id", "id").alias("fid"))
    learned = families.learned_names(t["items"].join(fid, "qualis_journal_id")).where("outcome = 'variant'")
    return {"names": learned.select(F.col("name_key").alias("key"), "name", "fid")}


def _overridden_names(t: Tables) -> Tables:
    n = curation.overridden_names(t["names"].select("key", "fid"), t["overrides"]).join(t["names"].select("key", "name"), "key", "left")
    return {"names": n.select("key", F.coalesce("name", "key").alias("name"), "fid")}


def _external(t: Tables) -> Tables:
    titles = t["journals"].select(F.coalesce("canonical_journal_id", "id").alias("fid"), "title").where("title IS NOT NULL")
    by_evidence = t["evidence"].select(F.col("source").alias("src"), F.col("record_key").alias("rec"), F.col("journal_id").alias("id")).distinct().join(t["journals"].select("id", F.coalesce("canonical_journal_id", "id").alias("fid")), "id")
    records = t["records"].join(by_evidence.select("src", "rec", "fid").distinct(), ["src", "rec"]).select("src", F.col("title").alias("name"), "fid").where("name IS NOT NULL")
    new = curation.external_names(records, t["names"].select("key").unionByName(titles.select(resolver_key(F.col("title")).alias("key"))).distinct(), titles)
    return {"names": t["names"].select("key", "name", "fid").unionByName(new.select("key", "name", "fid"))}


def _compared(t: Tables) -> Tables:
    after = t["items"].where("item_type = 'ARTIGO'").select("id", F.col("qualis_journal_id").alias("journal_id"))
    return {"audit": entities.snapshot_diff(t["links_before"], after)}


def _title_rules(rules: list[tuple[str, str]]):
    def run(t: Tables) -> Tables:
        found = curation.title_rules(t["journals"], rules)
        rows = found.select(F.col("id").alias("journal_id"), F.lit("title_rule").alias("source"), F.lit("title").alias("record_key"), F.col("slug").alias("label"), F.col("weight").cast("decimal(6,4)").alias("weight"))
        return {"evidence": t["evidence"].where("source <> 'title_rule'").unionByName(rows)}

    return run


def _classified(t: Tables) -> Tables:
    j = t["journals"].select("id", F.coalesce("canonical_journal_id", "id").alias("fid"))
    e = t["evidence"].join(j.withColumnRenamed("id", "journal_id"), "journal_id").select("fid", "source", "record_key", "label", "weight")
    if "ai_evidence" in t:
        e = e.unionByName(t["ai_evidence"], allowMissingColumns=True)
    own = t["taxonomy"].select(F.lit("title_rule").alias("vocabulary"), F.col("slug").alias("label"), "slug")
    crosswalk = t["thesaurus"].where("status = 'active'").select("vocabulary", "label", "slug").unionByName(own)
    decided = areas.decide(areas.contributions(e, crosswalk, t["taxonomy"]), t["taxonomy"])
    pubmed = t["records"].where("src = 'pubmed'").select("src", "rec").join(t["evidence"].select(F.col("source").alias("src"), F.col("record_key").alias("rec"), "journal_id"), ["src", "rec"]).join(j.withColumnRenamed("id", "journal_id"), "journal_id").select("fid").distinct()
    manual = t["manual_areas"] if "manual_areas" in t else t["journals"].select("id", F.lit(None).cast("string").alias("area")).where("false")
    return {"areas": areas.classified(areas.with_fallback(decided, j.select("fid"), pubmed), t["journals"], manual)}


def _ai(t: Tables) -> Tables:
    keys = t["journals"].select(F.concat(F.lit("title:"), resolver_key(F.col("title"))).alias("key"), F.coalesce("canonical_journal_id", "id").alias("fid")).distinct()
    e = curation.batch_evidence(curation.imported_batch(t["ai_lines"], keys, t["taxonomy"].select("slug")), "1")
    return {"ai_evidence": e.select("fid", "source", F.col("batch").alias("record_key"), "label", "weight", "confidence", "role")}


def _overridden_areas(t: Tables) -> Tables:
    o = t["overrides"]
    by_hand = o.where("field = 'area'").groupBy("id").agg(F.max_by("value", "n").alias("area")).join(t["taxonomy"].select(F.col("slug").alias("area")), "area", "left_semi").select("id", "area")
    return {"journals": curation.overridden(t["journals"], o.where("field <> 'area'")), "manual_areas": by_hand}


def _report(t: Tables) -> Tables:
    parts = {"report": jn.report(t["journals"], t["items"]), "report_confidence": jn.confidence_report(t["items"], t["journals"], t["areas"].withColumnRenamed("id", "journal_id")), "report_bases": jn.articles_by_base(t["items"], t["journals"], t["links"])}
    e = t["evidence"].groupBy("source").agg(F.countDistinct("journal_id").alias("journals"), F.count(F.lit(1)).alias("labels"))
    names = t["names"].select(F.col("fid").alias("journal_id"), F.lit("learned").alias("kind"))
    queue = jn.name_queue(t["items"])
    parts["report_full"] = jn.full_report(t["journals"], t["items"], t["links"], t["evidence"], names, queue.select(F.lit("pending").alias("status")))
    return parts | {"report_evidence": e, "report_queue": queue.agg(F.count(F.lit(1)).alias("names"), F.sum("articles").cast("bigint").alias("articles"))}


def _cleared(spark: SparkSession):
    def run(t: Tables) -> Tables:
        spark.catalog.clearCache()
        return {}

    return run


def steps(spark: SparkSession, rules: list[tuple[str, str]]) -> list[Step]:
    """The 22 steps in order."""
    family = ["journals", "records", "items"]
    index = ["items", "journals", "links"]
    classify = ["journals", "evidence", "thesaurus", "taxonomy", "records"]
    asks = lambda name: lambda tables: name in tables
    return [
        Step("normalize-titles", ["journals"], _normalized), Step("audit-before", ["items"], _snapshot), Step("scielo-enrich", ["journals", "records"], _enriched), Step("area-thesaurus-first", ["records", "thesaurus", "taxonomy", "crosswalk"], _thesaurus),
        Step("evidence-load", ["records", "journals", "thesaurus", "taxonomy"], _evidence), Step("families-first", family, _families), Step("index", index, _indexed), Step("families", family, _families), Step("learn", ["journals", "items"], _learned),
        Step("overrides-names", ["names", "overrides"], _overridden_names, when=asks("overrides")), Step("learn-external", ["journals", "evidence", "records", "names"], _external), Step("families-final", family, _families), Step("index-again", [*index, "names"], _indexed),
        Step("audit-after", ["links_before", "items"], _compared), Step("area-thesaurus", ["records", "thesaurus", "taxonomy", "crosswalk"], _thesaurus), Step("title-rules", ["journals", "evidence"], _title_rules(rules)), Step("classify", classify, _classified),
        Step("ai-import", ["ai_lines", "journals", "taxonomy"], _ai, when=asks("ai_lines")), Step("overrides-areas", ["journals", "overrides", "taxonomy"], _overridden_areas, when=asks("overrides")), Step("classify-again", classify, _classified, optional=["ai_evidence", "manual_areas"]),
        Step("report", ["journals", "items", "links", "evidence", "areas", "names"], _report), Step("cache-clear", [], _cleared(spark)),
    ]


def run(spark: SparkSession, folder: str, sources: dict[str, str | DataFrame], rules: list[tuple[str, str]], only: list[str] | None = None, skip: list[str] | None = None, first: str | None = None) -> tuple[Tables, list[tuple[str, str]]]:
    """The tables and what became of each step; see `Pipeline.run`."""
    return Pipeline(spark, folder, steps(spark, rules)).run(sources, only, skip, first)
