"""Subject areas: thesaurus, crosswalk, scorer and classifier (inventory B11-B15, B32, A60, N30, D6, D7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized

EPS = 1e-9
# The scorer's thresholds.
PRIMARY, CHILD, SPREAD, SECONDARY = 0.34, 0.20, 0.15, 0.25
HIGH_SHARE, HIGH_WEIGHT, MEDIUM_WEIGHT, MAX_SECONDARY = 0.50, 1.0, 0.5, 2
LEAST_SHARE, WORKS_DIGITS, AI_PRIMARY, AI_SECONDARY, AI_MEDIUM, AI_ROLE = 0.10, 3, 0.9, 0.45, 0.8, 0.75
SPREAD_SLUG, PUBMED_SLUG = "interdisciplinar", "ciencias-da-saude"
# The vocabulary and the weight of each source, those that suffice alone, and the pair of codes of which one moves.
VOCABULARY = {"wos": "wos", "scielo_wos": "wos", "scopus": "asjc", "openalex": "asjc", "doaj": "doaj", "latindex": "latindex", "scielo_area": "scielo_area", "scielo_desc": "scielo_desc", "legacy": "legacy"}
WEIGHTS = {"wos": 1.0, "scopus": 1.0, "scielo_wos": 1.0, "scielo_desc": 0.9, "legacy": 0.8, "doaj": 0.8, "latindex": 0.8, "scielo_area": 0.5, "title_rule": 0.5}
STRONG = ("wos", "scopus", "scielo_wos", "legacy")
PAIR_MOVED, PAIR_WITH, PAIR_SLUG = "1710", "3309", "comunicacao-informacao-museologia"
# Vocabularies in their order of priority, and those that are trusted.
PRIORITY = ["capes", "cnpq", "asjc", "wos", "doaj", "latindex", "scielo_area", "scielo_desc", "livre"]
TRUSTED = ["capes", "cnpq"]


def evidence_by_family(evidence: DataFrame) -> DataFrame:
    """Sum and mean weight by family, source and label."""
    return evidence.groupBy("fid", "source", "label").agg(F.sum("weight").alias("total"), F.avg("weight").alias("mean"))


def _lookup(c: Column, table: dict[str, object]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def openalex_weight(works: Column) -> Column:
    """min(1, log10(max(works, 1)) / 3)."""
    return F.least(F.lit(1.0), F.log10(F.greatest(F.coalesce(works, F.lit(1)), F.lit(1))) / WORKS_DIGITS)


def crosswalked(files: DataFrame, manual: DataFrame) -> DataFrame:
    """Vocabulary, key and slugs of labels: what is set by hand for a label replaces the file's entry as a whole. Both: vocabulary, label, slug (null: no area)."""
    keyed = lambda df: df.select("vocabulary", normalized(F.col("label"), upper=True).alias("key"), "slug").where("key <> ''").distinct()
    m = keyed(manual)
    return keyed(files).join(m.select("vocabulary", "key").distinct(), ["vocabulary", "key"], "left_anti").unionByName(m)


def contributions(evidence: DataFrame, crosswalk: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Of each family and area the share of the weights: Σ w·f / Σ w, with the family's weight, sources and the confidence of the models.

    A row counts once for each (source, record, label), the one of most weight; only known sources, positive weights, and shares of 0.10 or more of openalex.
    A label's weight is divided among its areas of the taxonomy; f is an area's part of what its source maps. Sources have fixed weights, openalex
    by its works (D6), and each row of a model its own, 0.9 or 0.45 times its confidence, whole on its slug. With both codes of the pair
    from sources that contribute, the first one moves. Labels of `legacy` are compared by key.
    evidence: fid, source, record_key, label, weight, works, confidence, role (the last three may be missing); crosswalk: vocabulary, label, slug; taxonomy: slug.
    """
    for c, t in (("works", "int"), ("confidence", "double"), ("role", "string")):
        evidence = evidence if c in evidence.columns else evidence.withColumn(c, F.lit(None).cast(t))
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    e = evidence.select("fid", "source", F.coalesce(F.col("record_key").cast("string"), F.lit("")).alias("record"), F.trim(F.col("label").cast("string")).alias("label"), weight.alias("weight"), "works", F.col("confidence").cast("double").alias("confidence"), "role")
    e = e.where(F.col("source").isin(*WEIGHTS, "openalex", "ai") & (F.col("label") != "")).groupBy("fid", "source", "record", "label").agg(F.max(F.struct("weight", "works", "confidence", "role")).alias("x")).select("fid", "source", "record", "label", "x.*")
    usable = e.where((F.col("source") != "ai") & (F.col("weight") > 0) & ((F.col("source") != "openalex") | (F.col("weight") + EPS >= LEAST_SHARE)))
    per = usable.groupBy("fid").agg(
        F.max(F.when(F.col("source") == "openalex", F.coalesce("works", F.lit(1)))).alias("works"),
        *(F.max((F.col("source").isin(s) & (F.col("label") == code)).cast("int")).alias(f"{s}_{code}") for s in ("scopus", "openalex") for code in (PAIR_MOVED, PAIR_WITH)),
    )
    alex = openalex_weight(F.col("works"))
    has = lambda code: (F.col(f"scopus_{code}") == 1) | ((F.col(f"openalex_{code}") == 1) & (alex > 0))
    facts = per.select("fid", alex.alias("alex"), (has(PAIR_MOVED) & has(PAIR_WITH)).alias("pair"))
    known = taxonomy.select("slug").distinct()
    table = crosswalk.select(F.col("vocabulary").alias("v"), F.when(F.col("vocabulary") == "legacy", normalized(F.col("label"))).otherwise(F.trim("label")).alias("k"), "slug").join(known, "slug", "left_semi").distinct()
    rows = usable.join(facts, "fid").withColumns({"v": _lookup(F.col("source"), VOCABULARY), "k": F.when(F.col("source") == "legacy", normalized(F.col("label"))).otherwise(F.col("label"))})
    moved = F.col("pair") & (F.col("v") == "asjc") & (F.col("label") == PAIR_MOVED)
    mapped = rows.where((F.col("source") != "title_rule") & ~F.coalesce(moved, F.lit(False))).join(table, ["v", "k"])
    others = rows.where(F.coalesce(moved, F.lit(False))).withColumn("slug", F.lit(PAIR_SLUG)).unionByName(rows.where(F.col("source") == "title_rule").withColumn("slug", F.col("label")).join(known, "slug", "left_semi").select(*rows.columns, "slug"))
    each = mapped.select(*rows.columns, "slug").unionByName(others)
    label = Window.partitionBy("fid", "source", "record", "label")
    s = each.withColumn("part", F.col("weight") / F.count(F.lit(1)).over(label)).groupBy("fid", "source", "slug").agg(F.sum("part").alias("s"), F.first("alex").alias("alex"))
    w = F.when(F.col("source") == "openalex", F.col("alex")).otherwise(_lookup(F.col("source"), WEIGHTS))
    f = s.withColumns({"f": F.col("s") / F.sum("s").over(Window.partitionBy("fid", "source")), "w": w}).where("w > 0").select("fid", "source", "slug", "w", "f", F.lit(False).alias("main"), F.lit(None).cast("double").alias("sure"))
    sure = F.least(F.lit(1.0), F.col("confidence"))
    main = F.when(F.col("role").isin("primary", "secondary"), F.col("role") == "primary").otherwise(F.col("weight") >= AI_ROLE)
    ai = e.where((F.col("source") == "ai") & (F.col("confidence") > 0)).join(known.withColumnRenamed("slug", "label"), "label", "left_semi")
    ai = ai.select("fid", "source", F.col("label").alias("slug"), (F.when(main, AI_PRIMARY).otherwise(AI_SECONDARY) * sure).alias("w"), F.lit(1.0).alias("f"), main.alias("main"), sure.alias("sure"))
    x = f.unionByName(ai)
    once = x.groupBy("fid", "source").agg(F.when(F.first("source") == "ai", F.sum("w")).otherwise(F.max("w")).alias("w"), F.max(F.when(F.col("main"), F.col("sure"))).alias("m"), F.max("sure").alias("a"))
    total = once.groupBy("fid").agg(F.sum("w").alias("weight"), F.array_sort(F.collect_list("source")).alias("sources"), F.max(F.coalesce("m", "a")).alias("ai_confidence"))  # at most the known sources
    return x.groupBy("fid", "slug").agg(F.sum(F.col("w") * F.col("f")).alias("wf")).join(total, "fid").select("fid", "slug", (F.col("wf") / F.col("weight")).alias("share"), "weight", "sources", "ai_confidence")


def decide(shares: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Primary area of each family, its confidence, and the secondary areas.

    Primary: the best second-level area of 0.34 or more; else the best first-level one, or its best child of 0.20 or more;
    else 'interdisciplinar' if areas of 0.15 or more lie in several first-level areas; else the best. Ties by slug.
    Secondary: up to two others of 0.25 or more, second level first; a first-level area only if none of its children has a share.
    taxonomy: slug, parent (null on the first level).
    """
    s = shares.join(taxonomy.select("slug", "parent"), "slug").withColumns({"level": F.when(F.col("parent").isNull(), 1).otherwise(2), "top": F.coalesce("parent", "slug"), "o": -F.round("share", 9)})
    rank = F.struct("o", "slug")
    at_least = lambda c, t: c + EPS >= t
    of = lambda level, t: F.min(F.when((F.col("level") == level) & at_least(F.col("share"), t), rank))
    g = s.groupBy("fid").agg(
        of(2, PRIMARY).alias("two"), of(1, PRIMARY).alias("one"), F.min(rank).alias("best"), F.countDistinct(F.when(at_least(F.col("share"), SPREAD), F.col("top"))).alias("spread"),
        F.first("weight").alias("weight"), F.first("sources").alias("sources"), F.first("ai_confidence").alias("ai"), F.collect_list(F.struct("o", "slug", "level", "parent", "share")).alias("rows"),  # at most the taxonomy
    )
    spread = taxonomy.agg(F.max((F.col("slug") == SPREAD_SLUG).cast("int")).alias("has_spread"))
    g = g.crossJoin(spread)  # one row
    child = F.array_min(F.transform(F.filter("rows", lambda r: (r["parent"] == F.col("one.slug")) & at_least(r["share"], CHILD)), lambda r: F.struct(r["o"].alias("o"), r["slug"].alias("slug"))))
    spreads = (F.col("spread") >= 2) & (F.col("has_spread") == 1)
    p = F.when(F.col("two").isNotNull(), F.col("two")).when(F.col("one").isNotNull(), F.coalesce(child, F.col("one"))).when(spreads, F.struct(F.lit(0.0).alias("o"), F.lit(SPREAD_SLUG).alias("slug"))).otherwise(F.col("best"))
    g = g.withColumn("p", p)
    own = F.get(F.filter("rows", lambda r: r["slug"] == F.col("p.slug")), 0)
    g = g.withColumns({"share": F.coalesce(own["share"], F.lit(0.0)), "fallback": F.col("two").isNull() & F.col("one").isNull()})
    strong = (F.size("sources") >= 2) | F.get("sources", 0).isin(*STRONG)
    high = at_least(F.col("share"), HIGH_SHARE) & at_least(F.col("weight"), HIGH_WEIGHT) & strong
    medium = at_least(F.col("share"), PRIMARY) & at_least(F.col("weight"), MEDIUM_WEIGHT)
    plain = F.when(F.col("fallback"), F.when(spreads, "medium").otherwise("low")).when(high, "high").when(medium, "medium").otherwise("low")
    alone = lambda x: (F.size("sources") == 1) & (F.get("sources", 0) == x)
    confidence = F.when(alone("title_rule"), "low").when(alone("ai"), F.when(at_least(F.col("ai"), AI_MEDIUM) & (plain != "low"), "medium").otherwise("low")).otherwise(plain)
    parents = F.concat(F.transform("rows", lambda r: r["parent"]), F.array(F.get(F.filter("rows", lambda r: r["slug"] == F.col("p.slug")), 0)["parent"]))
    rest = F.filter("rows", lambda r: (r["slug"] != F.col("p.slug")) & at_least(r["share"], SECONDARY) & ((r["level"] == 2) | ~F.coalesce(F.array_contains(F.col("parents"), r["slug"]), F.lit(False))))
    second = F.slice(F.transform(F.array_sort(F.transform(rest, lambda r: F.struct((-r["level"]).alias("l"), r["o"].alias("o"), r["slug"].alias("slug"), r["share"].alias("share")))), lambda r: F.struct(r["slug"].alias("slug"), r["share"].alias("share"))), 1, MAX_SECONDARY)
    out = g.withColumn("parents", F.array_compact(parents)).withColumn("second", second)
    return out.select("fid", F.col("p.slug").alias("primary_area"), F.round("share", 6).alias("share"), confidence.alias("confidence"), F.array_join(F.transform("second", lambda r: r["slug"]), ",").alias("secondary_areas"), "second")


def with_fallback(decided: DataFrame, families: DataFrame, in_pubmed: DataFrame) -> DataFrame:
    """Decisions of all families: without any mapped evidence, those in PubMed get the health sciences at share 0 and low confidence, the others none. families, in_pubmed: fid."""
    d = families.select("fid").distinct().join(decided, "fid", "left").join(in_pubmed.select("fid", F.lit(True).alias("pubmed")).distinct(), "fid", "left")
    falls = F.col("primary_area").isNull() & F.coalesce("pubmed", F.lit(False))
    return d.select(
        "fid", F.when(falls, PUBMED_SLUG).otherwise(F.col("primary_area")).alias("primary_area"), F.when(falls, 0.0).otherwise(F.col("share")).alias("share"), F.when(falls, "low").otherwise(F.coalesce("confidence", F.lit("none"))).alias("confidence"), "second",
        F.when(falls, "pubmed").alias("fallback"),
    )


def classified(decided: DataFrame, journals: DataFrame, manual: DataFrame) -> DataFrame:
    """Id, area, is_primary, score, confidence and method: the decided areas on every row of a family, scores between 0 and 1 with four places.

    Families with a locked row are left as they are; a pair of row and area that is set by hand stays as it is. decided: as of `with_fallback`;
    journals: id, canonical_journal_id, areas_locked; manual: id, area.
    """
    j = journals.select("id", F.coalesce("canonical_journal_id", "id").alias("fid"), F.coalesce("areas_locked", F.lit(False)).alias("locked"))
    is_open = j.join(j.where("locked").select("fid").distinct(), "fid", "left_anti").select("id", "fid")
    areas = F.concat(F.array(F.struct(F.col("primary_area").alias("slug"), F.col("share").cast("double").alias("share"), F.lit(1).alias("main"))), F.transform(F.coalesce("second", F.array().cast("array<struct<slug:string,share:double>>")), lambda r: F.struct(r["slug"].alias("slug"), r["share"].alias("share"), F.lit(0).alias("main"))))
    rows = decided.where("primary_area IS NOT NULL").select("fid", "confidence", F.explode(areas).alias("a")).join(is_open, "fid")
    auto = rows.select("id", F.col("a.slug").alias("area"), F.col("a.main").alias("is_primary"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "a.share")).cast("decimal(5,4)").alias("score"), "confidence", F.lit("auto").alias("method"))
    auto = auto.join(manual.select("id", "area").distinct(), ["id", "area"], "left_anti")
    return auto.unionByName(manual.select("id", "area", F.lit(None).cast("int").alias("is_primary"), F.lit(1).cast("decimal(5,4)").alias("score"), F.lit(None).cast("string").alias("confidence"), F.lit("manual").alias("method")))


def set_by_hand(manual: DataFrame, journals: DataFrame, taxonomy: DataFrame, changes: DataFrame) -> DataFrame:
    """The manual areas after changes, on all rows of each changed family: its slugs replace what was there, none clears; unknown slugs are passed over.

    manual: id, area; changes: id (any row of the family), slugs (array).
    """
    j = journals.select("id", F.coalesce("canonical_journal_id", "id").alias("fid"))
    c = changes.join(j, "id").groupBy("fid").agg(F.max_by("slugs", "id").alias("slugs"))
    new = c.select("fid", F.explode(F.array_distinct("slugs")).alias("area")).join(taxonomy.select(F.col("slug").alias("area")), "area", "left_semi").join(j, "fid").select("id", "area")
    return manual.join(j, "id").join(c.select("fid"), "fid", "left_anti").select("id", "area").unionByName(new)


# --- thesaurus ---
def is_code(key: Column) -> Column:
    """A label of digits alone, which is no text."""
    return key.rlike(r"^[\p{N}\s]+$")


def thesaurus_groups(variants: DataFrame, taxonomy: DataFrame, trusted: bool = False) -> DataFrame:
    """Key and slugs of the group that a label's key stands for: rows set by hand first, then vocabularies in their order; no slug at all means: no area.

    Slug and name of every area count as `capes` where that has no such key. variants: vocabulary, label, slug (null: ignored), manual (boolean), status; taxonomy: slug, name.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("vocabulary")), F.lit(0)), F.lit(99)) + F.when(F.col("manual"), 0).otherwise(100)
    v = variants.where("status IN ('active', 'ignored')").select("vocabulary", normalized(F.col("label"), upper=True).alias("key"), F.when(F.col("status") == "active", F.col("slug")).alias("slug"), "manual")
    own = taxonomy.select(F.explode(F.array("slug", "name")).alias("label"), "slug").select(F.lit("capes").alias("vocabulary"), normalized(F.col("label"), upper=True).alias("key"), "slug", F.lit(False).alias("manual"))
    own = own.groupBy("vocabulary", "key", "manual").agg(F.min("slug").alias("slug")).select("vocabulary", "key", "slug", "manual").join(v.where("vocabulary = 'capes' AND NOT manual").select("key").distinct(), "key", "left_anti").select(*v.columns)
    every = v.unionByName(own).where((F.col("key") != "") & ~is_code(F.col("key")))
    if trusted:
        every = every.where(F.col("manual") | F.col("vocabulary").isin(TRUSTED))
    g = every.groupBy("key", rank.alias("rank")).agg(F.array_sort(F.collect_set("slug")).alias("slugs"))  # at most the taxonomy
    return g.groupBy("key").agg(F.min_by("slugs", "rank").alias("slugs"))


def resolved_areas(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Id, slugs in the order of the text and unknown pieces of free texts: the whole text, else its parts between | and ;, else their parts between commas.

    rows: id, area; groups: key, slugs. A part that a known whole holds isn't looked at.
    """
    piece = lambda level, part, sub, t: F.struct(F.lit(level).alias("level"), part.alias("part"), sub.alias("sub"), F.trim(t).alias("t"))
    whole = F.array(piece(0, F.lit(0), F.lit(0), F.col("area")))
    parts = F.transform(F.split("area", r"[|;]"), lambda x, i: piece(1, i, F.lit(0), x))
    subs = F.flatten(F.transform(F.split("area", r"[|;]"), lambda x, i: F.when(F.contains(x, F.lit(",")), F.transform(F.split(x, ","), lambda y, k: piece(2, i, k, y))).otherwise(F.array().cast("array<struct<level:int,part:int,sub:int,t:string>>"))))
    r = rows.where("trim(area) <> ''").select("id", F.explode(F.concat(whole, parts, subs)).alias("x")).select("id", "x.*").where("t <> ''").withColumn("key", normalized(F.col("t"), upper=True)).join(groups, "key", "left")
    known = F.col("slugs").isNotNull()
    r = r.withColumn("all", F.max(((F.col("level") == 0) & known).cast("int")).over(Window.partitionBy("id")))
    one = Window.partitionBy("id", "part")
    r = r.withColumns({"whole_part": F.max(((F.col("level") == 1) & known).cast("int")).over(one), "commas": F.sum((F.col("level") == 2).cast("int")).over(one)})
    open_part = (F.col("all") == 0) & (F.col("whole_part") == 0)
    uses = ((F.col("level") == 0) & (F.col("all") == 1)) | ((F.col("level") == 1) & (F.col("all") == 0) & known) | ((F.col("level") == 2) & open_part & (F.col("commas") >= 2) & known)
    lost = open_part & ~known & (((F.col("level") == 1) & (F.col("commas") < 2)) | ((F.col("level") == 2) & (F.col("commas") >= 2)))
    place = F.struct("part", "sub", F.col("t").alias("t"), F.coalesce("slugs", F.array()).alias("slugs"))
    g = r.groupBy("id").agg(F.array_sort(F.collect_list(F.when(uses, place))).alias("u"), F.array_sort(F.collect_list(F.when(lost, place))).alias("l"))  # the pieces of one text
    return g.select("id", F.array_distinct(F.flatten(F.transform("u", lambda x: x["slugs"]))).alias("slugs"), F.transform("l", lambda x: x["t"]).alias("unknown"))


def area_columns(rows: DataFrame, groups: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Id, area and area_raw: a canonical label stays alone; else the label of the first area of the text, or the text, beside the text itself. Empty texts give nulls. taxonomy: slug, name."""
    t = rows.select("id", F.trim("area").alias("area"))
    slug = resolved_areas(t, groups).select("id", F.get("slugs", 0).alias("slug"))
    names = taxonomy.select("slug", F.col("name").alias("label"))
    j = t.join(slug, "id", "left").join(names, "slug", "left").join(names.select(F.col("label").alias("area"), F.lit(True).alias("canonical")).distinct(), "area", "left")
    empty = F.coalesce(F.col("area"), F.lit("")) == ""
    return j.select("id", F.when(~empty, F.when(F.col("canonical"), F.col("area")).otherwise(F.coalesce("label", "area"))).alias("area"), F.when(~empty & F.col("canonical").isNull(), F.col("area")).alias("area_raw"))


def synced_thesaurus(current: DataFrame, taxonomy: DataFrame, crosswalk: DataFrame, usage: DataFrame) -> DataFrame:
    """The thesaurus after a sync: seeds as taxonomy and crosswalk ask for them, rows set by hand as they are, occurrences of all, and unknown labels in use as pending.

    Seeds of a label that has a row by hand in its vocabulary are left to it; of labels that differ in accents alone one with an area wins over 'no area'. Pending
    rows whose label is known now, or used no more, go. current: vocabulary, label, slug, manual, status, occurrences; taxonomy: slug, name; crosswalk:
    vocabulary, label, slug (null: no area); usage: vocabulary, label, occurrences. The result has key as well.
    """
    key = normalized(F.col("label"), upper=True)
    at = ["vocabulary", "key"]
    by_hand = current.where("manual").withColumn("key", key)
    hands = by_hand.select(*at).distinct()
    asked = taxonomy.select(F.lit("capes").alias("vocabulary"), F.trim("name").alias("label"), "slug").unionByName(crosswalk.select("vocabulary", F.trim("label").alias("label"), "slug")).withColumn("key", key).where("key <> ''")
    valid = asked.join(taxonomy.select("slug"), "slug", "left_semi").select("vocabulary", "label", "slug", "key").unionByName(asked.where("slug IS NULL").select("vocabulary", "label", "slug", "key"))
    seeds = valid.groupBy(*at, "slug").agg(F.min("label").alias("label"))
    with_area = seeds.where("slug IS NOT NULL").select(*at).distinct()
    seeds = seeds.where("slug IS NOT NULL").unionByName(seeds.where("slug IS NULL").join(with_area, at, "left_anti")).join(hands, at, "left_anti")
    status = F.when(F.col("slug").isNull(), "ignored").otherwise("active")
    rows = seeds.select(*at, "label", "slug", F.lit(False).alias("manual"), status.alias("status")).unionByName(by_hand.select(*at, "label", "slug", "manual", "status"))
    used = usage.withColumn("key", key).where((F.col("key") != "") & ~is_code(F.col("key"))).groupBy(*at).agg(F.sum("occurrences").cast("bigint").alias("occurrences"), F.max_by("label", F.struct("occurrences", "label")).alias("label"))
    counted = rows.join(used.select(*at, "occurrences"), at, "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    unknown = used.join(rows.select(*at).distinct(), at, "left_anti")
    pending = unknown.select(*at, "label", F.lit(None).cast("string").alias("slug"), F.lit(False).alias("manual"), F.lit("pending").alias("status"), "occurrences")
    return counted.select(*pending.columns).unionByName(pending)


def sync_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows a sync inserted, updated (label or occurrences) and deleted, of seeds and of pending ones. Both: vocabulary, key, slug, label, manual, status, occurrences."""
    k = ["vocabulary", "key", "manual", "status"]
    b = before.select(*k, F.coalesce("slug", F.lit("")).alias("s"), F.col("label").alias("l0"), F.col("occurrences").alias("n0"))
    a = after.select(*k, F.coalesce("slug", F.lit("")).alias("s"), F.col("label").alias("l1"), F.col("occurrences").alias("n1"))
    j = b.join(a, [*k, "s"], "full_outer")
    state = F.when(F.col("l0").isNull(), "inserted").when(F.col("l1").isNull(), "deleted").when((F.col("l0") != F.col("l1")) | (F.col("n0") != F.col("n1")), "updated").otherwise("same")
    return j.groupBy((F.col("status") == "pending").alias("pending"), state.alias("change")).agg(F.count(F.lit(1)).alias("rows"))
