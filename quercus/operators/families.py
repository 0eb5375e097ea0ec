"""Journal families and evidence (inventory B1-B4, B8, B9, B16, B17, B19, B21, B24, A26, A27, A36, A55, A63-A65, Z5, Z6)."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import FOREIGN
from ..functions.text import fold, issn_valid, issns, normalized, plain_title_key, plain_title_score, resolver_key, weight_units
from ..plans.storage import remove, stored

#: A family holds together from this title score on (fixed value).
SAME_TITLE = 0.7


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) for edges a, b; an edge of a node with itself only names the node.

    Large and small stars in turn, until nothing changes: about log^2 rounds, also on chains. Every round is written out and
    read back, so neither lineage nor plan grows, and only a count and a checksum come to the driver.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).where("node IS NOT NULL").distinct()
    e, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sums = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    state = e.agg(*sums).first()
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        up, across = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(low, "u").select(F.explode(F.array(up, across)).alias("x")).select("x.*").where("u <> v").distinct()
        new, new_path = stored(small, "edges")
        was, state = state, new.agg(*sums).first()
        remove(spark, path)
        e, path = new, new_path
        if state == was:
            break
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def contradicted(records: DataFrame) -> DataFrame:
    """B2: (src, rec) of three ISSNs of which two other sources hold disjoint proper parts. records: src, rec, issns."""
    three = records.where(F.size("issns") == 3).select("src", "rec", F.posexplode("issns").alias("bit", "issn"))
    other = records.select(F.col("src").alias("s2"), F.col("rec").alias("r2"), F.explode("issns").alias("issn"))
    parts = three.join(other, "issn").where("s2 <> src").groupBy("src", "rec", "s2", "r2").agg(F.sum(F.pow(F.lit(2), F.col("bit"))).cast("int").alias("mask")).where("mask < 7")
    sides = parts.groupBy("src", "rec").agg(F.collect_set(F.struct("s2", "mask")).alias("m"))  # at most sources x 6 entries
    clash = F.exists("m", lambda x: F.exists(F.col("m"), lambda y: (x["s2"] != y["s2"]) & (x["mask"].bitwiseAND(y["mask"]) == 0)))
    return sides.where(clash).select("src", "rec")


def _joined_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows that would unite several groups, by id: the groups become one if they fit (B3), else the row is in conflict."""
    titles: dict[str, dict[str, str]] = {}
    countries: dict[str, set[str]] = {}
    for g in pdf[pdf["kind"] == "group"].itertuples():
        titles[g.root] = {plain_title_key(t): t for t in sorted(g.texts, reverse=True) if plain_title_key(t)}
        countries[g.root] = set(g.marks)
    up = {r: r for r in titles}

    def find(r: str) -> str:
        while up[r] != r:
            r = up[r]
        return r

    def alike(a: dict[str, str], b: dict[str, str]) -> float:
        return max((plain_title_score(x, y) for x in a.values() for y in b.values()), default=0.0)

    conflicts = []
    for row in pdf[pdf["kind"] == "row"].sort_values("id").itertuples():
        roots = sorted({find(r) for r in row.texts})
        titled = [r for r in roots if titles[r]]
        reason = None
        for a, b in itertools.combinations(titled, 2):
            if alike(titles[a], titles[b]) < SAME_TITLE:
                reason = "title"
                break
            if countries[a] and countries[b] and not countries[a] & countries[b]:
                reason = "country"
        if reason:
            own = {plain_title_key(row.title): row.title} if plain_title_key(row.title or "") else {}
            score = {r: alike(own, titles[r]) for r in titled}
            best = max(score.values())
            winners = [r for r in titled if score[r] >= best - 1e-9] if best >= SAME_TITLE else []
            conflicts.append((row.id, winners[0] if len(winners) == 1 else None, reason, round(best, 6), len(winners) > 1))
            continue
        for r in roots[1:]:
            up[r] = roots[0]
            titles[roots[0]] = titles[r] | titles[roots[0]]
            countries[roots[0]] |= countries[r]
    out = [("group", None, r, find(r), None, None, None) for r in up]
    out += [("row", i, None, find(d) if d else None, reason, score, tie) for i, d, reason, score, tie in conflicts]
    return pd.DataFrame(out, columns=["kind", "id", "root", "top", "reason", "score", "tie"])


def families(journals: DataFrame, records: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """B1: id, family (its canonical row), how a row came to it (issn, title, manual, alone), and of conflicts the reason, score and tie.

    ISSNs of a record (1 to 3, not contradicted) are one group. A row whose ISSNs lie in several groups unites them if all
    pairs of those with titles score 0.7 or more and their countries meet (B3), rows by id; else it is a conflict and goes to the
    group of the best title score alone, if that is 0.7 or more and no other has it (B4). A row without ISSN joins the only
    group of its normalised title, its rows' or its records'. The canonical row (B5) is no conflict if another is there, has most
    articles, then most ISSNs, then the smallest id; rows set by hand (method 'manual') keep their head, and a group with such takes it.

    Only groups that rows bind together meet in one task, as their order counts; all else is joins. journals: id, title, issn,
    and, if there are, method and canonical; records: src, rec, title, issns, and country if there is one; articles: id, n.
    Null titles have no key; empty tables give no rows or lone ones.
    """
    for c, t in (("method", "string"), ("canonical", "bigint")):
        journals = journals if c in journals.columns else journals.withColumn(c, F.lit(None).cast(t))
    records = records if "country" in records.columns else records.withColumn("country", F.lit(None).cast("string"))
    j = journals.select("id", "title", "canonical", F.coalesce(F.col("method") == "manual", F.lit(False)).alias("manual"), F.filter(issns(F.coalesce("issn", F.lit(""))), issn_valid).alias("own"), normalized(F.coalesce("title", F.lit(""))).alias("name"))
    there = journals.select(F.col("id").alias("canonical"), F.lit(True).alias("known"))
    hand = j.where("manual").join(there, "canonical", "left").select("id", F.when(F.col("known") & (F.col("canonical") != F.col("id")), F.col("canonical")).otherwise(F.col("id")).alias("head"))
    heads = hand.select(F.col("head").alias("id")).distinct()
    fixed = hand.select("id").unionByName(heads).distinct().withColumn("fixed", F.lit(True))

    valid = records.withColumn("issns", F.filter("issns", issn_valid)).where((F.size("issns") > 0) & (F.size("issns") <= 3))
    good = valid.join(contradicted(valid), ["src", "rec"], "left_anti")
    rows = j.where(F.size("own") > 0).select("id", "title", "name", "manual", F.posexplode("own").alias("pos", "issn"))
    first = rows.where("pos = 0").select("id", F.col("issn").alias("a"))
    by_hand = rows.where("manual").join(first, "id").select("a", F.col("issn").alias("b")).unionByName(hand.join(first, "id").join(first.select(F.col("id").alias("head"), F.col("a").alias("b")), "head").select("a", "b"))
    pairs = good.select(F.element_at("issns", 1).alias("a"), F.explode("issns").alias("b"))
    group, _ = stored(components(pairs.unionByName(rows.select(F.col("issn").alias("a"), F.col("issn").alias("b"))).unionByName(by_hand)).withColumnRenamed("node", "issn"), "issn-groups")

    mine, _ = stored(rows.join(group, "issn").select("id", "title", "manual", "pos", "root"), "row-groups")
    catalogued = mine.select("root").distinct()
    told = good.select(F.element_at("issns", 1).alias("issn"), "title", "country").join(group, "issn").select("root", "title", "country")
    # Groups that a row's ISSNs bind together.
    several = mine.where("NOT manual").groupBy("id", "title").agg(F.array_sort(F.collect_set("root")).alias("roots")).where(F.size("roots") > 1)  # at most a row's ISSNs
    bound = components(several.select(F.element_at("roots", 1).alias("a"), F.explode("roots").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("bundle"))
    facts = told.join(bound, "root").groupBy("bundle", "root").agg(F.collect_set("title").alias("texts"), F.collect_set("country").alias("marks"))
    groups = bound.join(facts, ["bundle", "root"], "left").select("bundle", F.lit("group").alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("title"), "root", F.coalesce("texts", F.array()).alias("texts"), F.coalesce("marks", F.array()).alias("marks"))
    binding = several.withColumn("root", F.element_at("roots", 1)).join(bound, "root").select("bundle", F.lit("row").alias("kind"), F.col("id").cast("long").alias("id"), "title", "root", F.col("roots").alias("texts"), F.array().cast("array<string>").alias("marks"))
    decided, _ = stored(groups.unionByName(binding).groupBy("bundle").applyInPandas(_joined_in_order, "kind string, id long, root string, top string, reason string, score double, tie boolean"), "joined-groups")
    tops = decided.where("kind = 'group'").select("root", "top")
    clash = decided.where("kind = 'row'").select("id", F.col("top").alias("destination"), "reason", "score", "tie")

    final = lambda df: df.join(tops, "root", "left").withColumn("top", F.coalesce("top", "root"))
    alone = F.concat(F.lit("-"), F.col("id").cast("string"))
    placed = final(mine.where("pos = 0").select("id", "root")).join(clash, "id", "left").select("id", F.when(F.col("reason").isNull(), F.col("top")).otherwise(F.coalesce("destination", alone)).alias("top"), (F.col("reason").isNotNull() & F.col("destination").isNull()).alias("lone"))
    # Rows without ISSN, by title: the groups of rows of that title, and those of records whose groups have rows.
    named = j.select("id", "name").where("name <> ''")
    by_rows = placed.join(named, "id").select("name", "top")
    by_records = final(good.where("title IS NOT NULL").select(F.element_at("issns", 1).alias("issn"), normalized(F.col("title")).alias("name")).join(group, "issn").join(catalogued, "root", "left_semi").select("root", "name")).join(placed.select("top").distinct(), "top", "left_semi").select("name", "top")
    only = by_rows.unionByName(by_records).distinct().groupBy("name").agg(F.min("top").alias("top"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "top")
    bare = j.where(F.size("own") == 0).join(fixed, "id", "left_anti").select("id", "name")
    attached = bare.join(only, "name").select("id", "top", F.lit(False).alias("lone"))

    n = articles.select("id", "n") if articles is not None else journals.select("id").where("false").withColumn("n", F.lit(0))
    members = placed.withColumn("how", F.lit("issn")).unionByName(attached.withColumn("how", F.lit("title"))).join(n, "id", "left").join(j.select("id", F.size("own").alias("issns")), "id").join(clash.select("id", "reason", "score", "tie"), "id", "left")
    members = members.join(hand, "id", "left").join(heads.withColumn("is_head", F.lit(True)), "id", "left")
    rank = F.struct(F.col("reason").isNotNull().alias("c"), (-F.coalesce("n", F.lit(0))).alias("n"), (-F.col("issns")).alias("i"), "id")
    at_hand = members.where("head IS NOT NULL OR is_head").select("top", F.coalesce("head", "id").alias("id")).distinct().join(members.select("id", "reason", "n", "issns"), "id").groupBy("top").agg(F.min(rank).alias("h"))
    canonical = members.groupBy("top").agg(F.min(rank).alias("r")).join(at_hand, "top", "left").select("top", F.coalesce("h.id", "r.id").alias("family"))
    assigned = members.join(canonical, "top").select("id", "family", "how", "lone", "reason", "score", "tie")
    kept_as = j.select("id", F.when(F.col("canonical").isNotNull(), F.col("canonical")).alias("canonical")).join(there, "canonical", "left").select("id", F.when(F.col("known"), F.col("canonical")).alias("was"))
    out = j.select("id").join(fixed, "id", "left").join(hand, "id", "left").join(assigned, "id", "left").join(kept_as, "id", "left")
    family = F.when(F.col("fixed"), F.coalesce("head", "was", "id")).otherwise(F.coalesce("family", "id"))
    method = F.when(F.col("head").isNotNull(), "manual").when(F.col("how").isNull() | F.col("lone"), "alone").otherwise(F.col("how"))
    return out.select("id", family.alias("family"), method.alias("method"), F.col("reason").isNotNull().alias("conflict"), "reason", "score", F.coalesce("tie", F.lit(False)).alias("tie"))


def evidence(records: DataFrame, journals: DataFrame) -> DataFrame:
    """Labels of records on journal rows: all rows that share a valid ISSN, else rows without any whose title is the same; label weights add up to 1."""
    j = journals.select("id", resolver_key(F.col("title")).alias("key"), F.filter(issns(F.col("issn")), issn_valid).alias("own"))
    r = records.where(F.size("labels") > 0).select("src", "rec", "labels", F.filter("issns", issn_valid).alias("issns"), resolver_key(F.coalesce("title", F.lit(""))).alias("key"))
    by_issn = r.select("src", "rec", F.explode("issns").alias("issn")).join(j.select("id", F.explode("own").alias("issn")), "issn").select("src", "rec", "id").distinct()
    rest = r.join(by_issn.select("src", "rec").distinct(), ["src", "rec"], "left_anti").where("key <> ''")
    by_title = rest.join(j.where(F.size("own") == 0).select("id", "key"), "key").select("src", "rec", "id").distinct()
    labels = r.select("src", "rec", F.size("labels").alias("n"), F.posexplode("labels").alias("i", "label"))
    return by_issn.unionByName(by_title).join(labels, ["src", "rec"]).select("id", "src", "rec", "label", weight_units(F.col("n"), F.col("i")).alias("weight"))


def learned_names(items: DataFrame, least: int = 2) -> DataFrame:
    """Folded journal names that two or more linked articles confirm: variant if all lead to one family, else conflict. items: journal_name, fid."""
    a = items.where("fid IS NOT NULL AND journal_name IS NOT NULL").groupBy(resolver_key(F.col("journal_name")).alias("name_key")).agg(F.count(F.lit(1)).alias("articles"), F.min("fid").alias("a"), F.max("fid").alias("b"), F.min("journal_name").alias("name"))
    return a.where((F.col("articles") >= least) & (F.col("name_key") != "")).select("name_key", "name", "articles", F.when(F.col("a") == F.col("b"), F.col("a")).alias("fid"), F.when(F.col("a") == F.col("b"), "variant").otherwise("conflict").alias("outcome"))


def enriched_issns(journals: DataFrame, records: DataFrame) -> DataFrame:
    """ISSNs for rows without one whose title only one record has, and only one row."""
    j = journals.where("issn IS NULL OR issn = ''").select("id", resolver_key(F.col("title")).alias("key"))
    one_row = j.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    r = records.where(F.size("issns") > 0).groupBy(resolver_key(F.col("title")).alias("key")).agg(F.first("issns").alias("issns"), F.count(F.lit(1)).alias("m")).where("m = 1")
    return one_row.join(r, "key").select("id", F.element_at("issns", 1).alias("issn"))


def indexed(items: DataFrame, resolved: DataFrame, strata: DataFrame, links: DataFrame) -> DataFrame:
    """Articles get journal, stratum and databases of their distinct (name, issn); other types lose their links."""
    bases = links.groupBy("journal_id").agg(F.array_sort(F.collect_set("database_id")).alias("databases"))
    r = resolved.select(F.col("name").alias("journal_name"), F.col("issn").alias("__issn"), "journal_id")
    j = items.join(r, (items["journal_name"] == r["journal_name"]) & items["issn"].eqNullSafe(r["__issn"]) & (items["item_type"] == "ARTIGO"), "left").drop(r["journal_name"]).drop("__issn")
    return j.join(strata.select(F.col("id").alias("journal_id"), "qualis"), "journal_id", "left").join(bases, "journal_id", "left")


def partners(experiences: DataFrame, institutions: DataFrame, foreign: bool, own: str, first: int, limit: int = 10) -> DataFrame:
    """The most frequent raw names first, then resolved, sorted into national and foreign, summed again.

    institutions: name_key (resolver key), shown, iso. Unresolved names count as national unless a word marks them as foreign.
    """
    raw = experiences.where("institution_name IS NOT NULL AND trim(institution_name) <> ''").where(~F.contains(fold(F.col("institution_name")), F.lit(own)))
    top = raw.groupBy("institution_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "institution_name").limit(first)
    x = top.withColumn("name_key", resolver_key(F.col("institution_name"))).join(institutions, "name_key", "left")
    word = F.lit(False)
    for w in FOREIGN:
        word = word | F.contains(F.lower("institution_name"), F.lit(w))
    abroad = F.coalesce(F.col("iso") != "BR", F.lit(False)) | word if foreign else ~F.coalesce(F.col("iso") != "BR", F.lit(False))
    return x.where(abroad).groupBy(F.coalesce("shown", "institution_name").alias("name")).agg(F.sum("n").cast("bigint").alias("total")).orderBy(F.desc("total"), "name").limit(limit)


def catalogue_export(journals: DataFrame, links: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """One row a journal: databases and variants joined, sorted."""
    b = links.groupBy(F.col("journal_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("database_id")), ";").alias("databases"))
    out = journals.select("id", "title", "issn", "qualis").join(b, "id", "left")
    if variants is not None:
        v = variants.groupBy(F.col("journal_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("variants"))
        out = out.join(v, "id", "left")
    return out


def thesaurus_export(journals: DataFrame) -> DataFrame:
    """One row a family: the canonical title as header and all other names of it, distinct by key, sorted."""
    j = journals.withColumn("fid", F.coalesce("canonical_journal_id", "id"))
    head = j.groupBy("fid").agg(F.min_by("title", F.struct((F.col("id") != F.col("fid")).alias("x"), "id")).alias("header"))
    names = j.groupBy("fid", resolver_key(F.col("title")).alias("key")).agg(F.min("title").alias("name"))
    n = names.join(head, "fid").where(F.col("key") != resolver_key(F.col("header"))).groupBy("fid").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("variants"))
    return head.join(n, "fid", "left").select("fid", "header", F.coalesce("variants", F.lit("")).alias("variants"))


def database_counts(links: DataFrame, databases: DataFrame) -> DataFrame:
    """Databases with the number of their journals, those without any too."""
    n = links.groupBy(F.col("database_id").alias("id")).agg(F.countDistinct("journal_id").alias("journals"))
    return databases.join(n, "id", "left").select("id", "name", F.coalesce("journals", F.lit(0)).alias("journals"))


def catalogue_page(journals: DataFrame, q: str, qualis: str | None, page: int, size: int = 50) -> DataFrame:
    """Text in title or ISSN, a stratum or EMPTY, a page by title and id."""
    out = journals
    if q:
        out = out.where(F.contains(fold(F.col("title")), F.lit(q)) | F.contains(F.coalesce("issn", F.lit("")), F.lit(q)))
    if qualis == "EMPTY":
        out = out.where("qualis IS NULL OR qualis = ''")
    elif qualis:
        out = out.where(F.col("qualis") == qualis)
    return out.orderBy("title", "id").offset((page - 1) * size).limit(size)


def forward_filled(df: DataFrame, column: str, order: str, by: str) -> DataFrame:
    """The last value that isn't null, within each group."""
    return df.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
