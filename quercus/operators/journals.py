"""Journals: families, coverage by database, resolution (inventory A46-A50, A54, A57, A59, A64, B5, B7, B8, B18, R1, R2, T8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import compact_key, fold, issns, resolver_key, without_parentheses


def with_family(journals: DataFrame) -> DataFrame:
    """The family of each row: its canonical row or itself."""
    return journals.withColumn("fid", F.coalesce("canonical_journal_id", "id"))


def family_links(journals: DataFrame, links: DataFrame) -> DataFrame:
    """The database links of any row hold for every row of its family."""
    j = with_family(journals).select("id", "fid")
    bases = j.join(links.withColumnRenamed("journal_id", "id"), "id").select("fid", "database_id").distinct()
    return j.join(bases, "fid").select(F.col("id").alias("journal_id"), "database_id")


def by_database(items: DataFrame, journals: DataFrame, links: DataFrame, database_id: int) -> DataFrame:
    """Of each family in a database the distinct articles (by K3), researchers and years."""
    j = with_family(journals).select(F.col("id").alias("qualis_journal_id"), "fid")
    inside = with_family(journals).select("id", "fid").join(links.where(F.col("database_id") == database_id).select(F.col("journal_id").alias("id")), "id", "left_semi").select("fid").distinct()
    a = items.where("item_type = 'ARTIGO'").select("qualis_journal_id", "researcher_id", "year", keys.article_key().alias("article"))
    # Distinct rows first, then one count of each: no row is expanded for several distinct counts.
    d = a.join(j, "qualis_journal_id").join(inside, "fid", "left_semi").groupBy("fid", "article", "researcher_id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    n = d.groupBy("fid", "article").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy("fid").agg(F.count("article").alias("articles"), F.min("a").alias("first_year"), F.max("b").alias("last_year"))
    who = d.select("fid", "researcher_id").distinct().groupBy("fid").agg(F.count("researcher_id").alias("researchers"))
    return n.join(who, "fid")


def database_totals(items: DataFrame, journals: DataFrame, links: DataFrame) -> DataFrame:
    """Of each database the families, distinct articles and distinct researchers; an article of several rows counts once.

    Articles are made distinct by family before they meet the databases, which then repeat short rows, not articles.
    """
    j = with_family(journals).select("id", "fid")
    bases = j.join(links.withColumnRenamed("journal_id", "id"), "id").select("fid", "database_id").distinct()
    a = items.where("item_type = 'ARTIGO'").select(F.col("qualis_journal_id").alias("id"), "researcher_id", keys.article_key().alias("article"))
    d = a.join(j, "id").select("fid", "article", "researcher_id").distinct()
    count = lambda c: d.select("fid", c).distinct().join(bases, "fid").select("database_id", c).distinct().groupBy("database_id").agg(F.count(c).alias(f"{c}s"))
    families = d.select("fid").distinct().join(bases, "fid").groupBy("database_id").agg(F.count(F.lit(1)).alias("families"))
    return families.join(count("article"), "database_id").join(count("researcher_id").withColumnRenamed("researcher_ids", "researchers"), "database_id")


def bars(totals: DataFrame) -> DataFrame:
    """A bar of at least 1 percent of the longest."""
    top = totals.agg(F.max("articles").alias("most"))
    return totals.crossJoin(top).select("database_id", "articles", F.greatest(F.lit(1.0), F.round((F.lit(100) * F.col("articles") / F.col("most")).cast("decimal(28,10)"), 1).cast("double")).alias("bar"))


def family_stratum(items: DataFrame, journals: DataFrame) -> DataFrame:
    """The stratum of most distinct articles of a family; ties by the smaller."""
    j = with_family(journals).select(F.col("id").alias("qualis_journal_id"), "fid")
    a = items.where((F.col("item_type") == "ARTIGO") & keys.has_qualis()).select("qualis_journal_id", "qualis", keys.article_key().alias("article")).join(j, "qualis_journal_id")
    n = a.groupBy("fid", "qualis").agg(F.countDistinct("article").alias("n"))
    return n.groupBy("fid").agg(F.min(F.struct((-F.col("n")).alias("n"), "qualis")).alias("x")).select("fid", F.col("x.qualis").alias("qualis"), (-F.col("x.n")).alias("articles"))


def family_bases(journals: DataFrame, links: DataFrame) -> DataFrame:
    """The databases of each family, sorted."""
    j = with_family(journals).select("id", "fid").join(links.withColumnRenamed("journal_id", "id"), "id")
    return j.groupBy("fid").agg(F.array_join(F.array_sort(F.collect_set("database_id")), ",").alias("databases"))


def canonical_rows(items: DataFrame, journals: DataFrame) -> DataFrame:
    """The head of each family: most articles, then more ISSNs, then the lowest id."""
    n = items.where("item_type = 'ARTIGO'").groupBy(F.col("qualis_journal_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    j = with_family(journals).join(n, "id", "left")
    order = F.struct((-F.coalesce("n", F.lit(0))).alias("a"), (-F.size(issns(F.col("issn")))).alias("b"), F.col("id").alias("c"))
    return j.groupBy("fid").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("rows")).select("fid", F.col("x.c").alias("canonical"), "rows")


def shown_stratum(journals: DataFrame) -> DataFrame:
    """R2: a row without stratum takes its canonical row's, else that of the lowest id of the family that has one."""
    j = with_family(journals)
    have = j.where("qualis IS NOT NULL AND qualis <> ''")
    first = have.groupBy("fid").agg(F.min_by("qualis", F.struct((F.col("id") != F.col("fid")).alias("a"), F.col("id").alias("b"))).alias("of_family"))
    return j.join(first, "fid", "left").select("id", F.coalesce(F.nullif("qualis", F.lit("")), "of_family").alias("qualis"))


def key_table(journals: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """All keys by stage (1 ISSN, 2 names, 4 compact): id if all rows of the key are of one family, else ambiguous."""
    j = with_family(journals)
    names = [j.select(resolver_key(F.col("title")).alias("key"), "id", "fid"), j.select(resolver_key(without_parentheses(F.col("title"))).alias("key"), "id", "fid")]
    if variants is not None:
        names.append(variants.select(resolver_key(F.col("name")).alias("key"), F.col("journal_id").alias("id")).join(j.select("id", "fid"), "id").select("key", "id", "fid"))
    by_name = names[0]
    for x in names[1:]:
        by_name = by_name.unionByName(x)
    rows = (
        j.select(F.lit(1).alias("stage"), F.explode(issns(F.col("issn"))).alias("key"), "id", "fid")
        .unionByName(by_name.select(F.lit(2).alias("stage"), "key", "id", "fid"))
        .unionByName(j.select(F.lit(4).alias("stage"), compact_key(F.col("title")).alias("key"), "id", "fid"))
        .where("key IS NOT NULL AND key <> ''")
    )
    n = rows.groupBy("stage", "key").agg(F.min("id").alias("id"), (F.min("fid") != F.max("fid")).alias("many"))
    return n.select("stage", "key", "id", F.when(F.col("stage") == 1, False).otherwise(F.col("many")).alias("ambiguous"))


def resolve(names: DataFrame, journals: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """For distinct (name, issn) pairs the journal, the stage that decided, and matched, ambiguous or none.

    Stages: ISSNs in order, exact name, name without parentheses, compact name. The first with a hit decides; a hit on several families ends it without a match.
    """
    pairs = names.select("name", "issn").distinct()
    tries = pairs.select(
        "name", "issn",
        F.filter(
            F.concat(
                F.transform(issns(F.col("issn")), lambda x, i: F.struct(F.lit(1).alias("stage"), F.lit(1).alias("step"), i.alias("pos"), x.alias("key"))),
                F.array(
                    F.struct(F.lit(2).alias("stage"), F.lit(2).alias("step"), F.lit(0).alias("pos"), resolver_key(F.col("name")).alias("key")),
                    F.struct(F.lit(2).alias("stage"), F.lit(3).alias("step"), F.lit(0).alias("pos"), resolver_key(without_parentheses(F.col("name"))).alias("key")),
                    F.struct(F.lit(4).alias("stage"), F.lit(4).alias("step"), F.lit(0).alias("pos"), compact_key(F.col("name")).alias("key")),
                ),
            ),
            lambda x: x["key"].isNotNull() & (x["key"] != ""),
        ).alias("tries"),
    )
    rows = tries.select("name", "issn", F.explode_outer("tries").alias("t")).select("name", "issn", "t.*").join(key_table(journals, variants), ["stage", "key"], "left")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("step", "pos", "id", "ambiguous"))).alias("hit")
    out = rows.groupBy("name", "issn").agg(first)
    status = F.when(F.col("hit").isNull(), "none").when(F.col("hit.ambiguous"), "ambiguous").otherwise("matched")
    return out.select("name", "issn", status.alias("status"), F.col("hit.step").alias("step"), F.when(status == "matched", F.col("hit.id")).alias("journal_id"))


def name_queue(items: DataFrame) -> DataFrame:
    """Unlinked articles by folded journal name: the most frequent spelling and ISSN (ties: smallest), articles, researchers and the three latest distinct titles (by year, then id)."""
    a = items.where("item_type = 'ARTIGO' AND qualis_journal_id IS NULL AND journal_name IS NOT NULL").where(F.col("journal_name").rlike(r"\p{Alnum}"))
    issn = F.nullif(F.trim("issn"), F.lit("")) if "issn" in items.columns else F.lit(None).cast("string")
    a = a.select(fold(F.col("journal_name")).alias("name_key"), "journal_name", issn.alias("issn"), "researcher_id", "title", F.coalesce("year", F.lit(-1)).alias("year"), "id")
    modal = lambda c: a.where(F.col(c).isNotNull()).groupBy("name_key", c).agg(F.count(F.lit(1)).alias("n")).groupBy("name_key").agg(F.min(F.struct((-F.col("n")).alias("o"), c)).alias("x"), F.sum("n").alias("n"))
    spelling = modal("journal_name").select("name_key", F.col("x.journal_name").alias("spelling"), F.col("n").alias("articles"))
    number = modal("issn").select("name_key", F.col("x.issn").alias("issn"))
    who = a.select("name_key", "researcher_id").distinct().groupBy("name_key").agg(F.count(F.lit(1)).alias("researchers"))
    w = Window.partitionBy("name_key").orderBy(F.desc("year"), F.desc("id"), "title")
    latest = a.groupBy("name_key", "title").agg(F.max(F.struct("year", "id")).alias("x")).select("name_key", "title", "x.year", "x.id").withColumn("place", F.row_number().over(w)).where("place <= 3")
    titles = latest.groupBy("name_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]).alias("titles"))
    return spelling.join(number, "name_key", "left").join(who, "name_key").join(titles, "name_key", "left")


def name_states(queue: DataFrame, resolved: DataFrame, suggested: DataFrame) -> DataFrame:
    """The queue with its state (ambiguous if the name leads to several families) and suggestion. resolved: name, status; suggested: name, suggested_journal_id."""
    r = resolved.select(F.col("name").alias("spelling"), (F.col("status") == "ambiguous").alias("amb")).groupBy("spelling").agg(F.max("amb").alias("amb"))
    s = suggested.select(F.col("name").alias("spelling"), "suggested_journal_id").distinct()
    return queue.join(r, "spelling", "left").join(s, "spelling", "left").withColumns({"status": F.when(F.coalesce("amb", F.lit(False)), "ambiguous").otherwise("pending"), "method": F.when(F.col("suggested_journal_id").isNotNull(), "keywords").otherwise("none")}).drop("amb")


def stale_names(candidates: DataFrame, queue: DataFrame) -> DataFrame:
    """Open candidates whose name no unlinked article has any more; those suggested by ISSN stay. candidates: name_key, status, method."""
    is_open = F.col("status").isin("pending", "ambiguous") & ~F.coalesce(F.col("method") == "issn", F.lit(False))
    return candidates.where(is_open).join(queue.select("name_key"), "name_key", "left_anti")


def area_chips(journals: DataFrame, areas: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The areas of each family's canonical row: the primary first, then by score and the taxonomy's order. areas: journal_id, area, is_primary, score; taxonomy: slug, name, sort_order."""
    j = with_family(journals).where("fid = id").select(F.col("id").alias("journal_id"), "fid")
    a = areas.join(j, "journal_id").join(taxonomy.select(F.col("slug").alias("area"), "name", "sort_order"), "area")
    order = F.struct((-F.coalesce("is_primary", F.lit(0))).alias("p"), (-F.col("score")).alias("s"), "sort_order", "name")
    return a.groupBy("fid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["name"]), ", ").alias("areas"))  # at most the taxonomy


def articles_by_base(items: DataFrame, journals: DataFrame, links: DataFrame) -> DataFrame:
    """Of each database the families and distinct article rows of its linked journal rows; a family's other rows don't count."""
    j = with_family(journals).select(F.col("id").alias("qualis_journal_id"), "fid")
    rows = items.where("item_type = 'ARTIGO'").select("id", "qualis_journal_id").distinct().join(links.select(F.col("journal_id").alias("qualis_journal_id"), "database_id").distinct(), "qualis_journal_id").join(j, "qualis_journal_id")
    a = rows.select("database_id", "id").distinct().groupBy("database_id").agg(F.count(F.lit(1)).alias("articles"))
    f = rows.select("database_id", "fid").distinct().groupBy("database_id").agg(F.count(F.lit(1)).alias("families"))
    return a.join(f, "database_id")


def confidence_report(items: DataFrame, journals: DataFrame, areas: DataFrame) -> DataFrame:
    """Visible families (with articles) by the confidence of their primary area, a manual one first; `none` for those without. areas: journal_id, area, is_primary, confidence, method."""
    j = with_family(journals).select("id", "fid")
    visible = items.where("item_type = 'ARTIGO'").select(F.col("qualis_journal_id").alias("id")).distinct().join(j, "id").select("fid").distinct()
    p = areas.where("is_primary = 1").groupBy(F.col("journal_id").alias("fid")).agg(F.min(F.struct((F.col("method") != "manual").alias("m"), "area", "confidence")).alias("x"))
    return visible.join(p, "fid", "left").groupBy(F.coalesce("x.confidence", F.lit("none")).alias("confidence")).agg(F.count(F.lit(1)).alias("families"))


def report(journals: DataFrame, items: DataFrame) -> DataFrame:
    """Rows, families, rows without ISSN, ISSNs on several rows, linked articles."""
    j = with_family(journals)
    a = j.groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("issn").isNull(), 1).otherwise(0)).alias("bare")).agg(F.sum("n").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("families"), F.sum("bare").cast("bigint").alias("without_issn"))
    d = j.where("issn IS NOT NULL").groupBy("issn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_issns"))
    b = items.agg(F.count("qualis_journal_id").alias("linked_items"))
    return a.crossJoin(d).crossJoin(b)


def full_report(journals: DataFrame, items: DataFrame, links: DataFrame, evidence: DataFrame, variants: DataFrame, queue: DataFrame) -> DataFrame:
    """One report as part, key, value: rows, families (all, with articles, without evidence), missing and repeated ISSNs, linked and unlinked articles, and by key the families of each base and
    each source of evidence, the variants by kind and the open names by status. evidence: journal_id, source; variants: journal_id, kind; queue: status.

    Each part is a count of its own, added up before it moves; the result has a row for each part and key.
    """
    j = with_family(journals)
    fid = j.select(F.col("id").alias("journal_id"), "fid")
    a = items.where("item_type = 'ARTIGO'").groupBy(F.col("qualis_journal_id").alias("journal_id")).agg(F.count(F.lit(1)).alias("n")).join(fid, "journal_id", "left").select("fid", "n")
    proven = evidence.select("journal_id", "source").distinct().join(fid, "journal_id").select("source", "fid").distinct()
    families = j.select("fid").distinct()
    count = lambda df, part, key=None: df.groupBy((F.lit("") if key is None else F.col(key).cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(part).alias("part"), "key", "value")
    whole = lambda df, part, c=None: df.agg(F.coalesce(F.sum(c) if c else F.count(F.lit(1)), F.lit(0)).cast("bigint").alias("value")).select(F.lit(part).alias("part"), F.lit("").alias("key"), "value")
    parts = [
        whole(j, "rows"), whole(families, "families"), whole(a.where("fid IS NOT NULL").select("fid").distinct(), "families_with_articles"), whole(j.where("coalesce(issn, '') = ''"), "without_issn"),
        whole(j.where("coalesce(issn, '') <> ''").groupBy("issn").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_issns"), whole(a.where("fid IS NOT NULL"), "linked_articles", "n"), whole(a.where("fid IS NULL"), "unlinked_articles", "n"),
        count(links.select("journal_id", "database_id").distinct().join(fid, "journal_id").select("database_id", "fid").distinct(), "base_families", "database_id"), count(proven, "evidence_families", "source"),
        whole(families.join(proven.select("fid").distinct(), "fid", "left_anti"), "families_without_evidence"), count(variants, "variants", "kind"), count(queue, "queue", "status"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def name_search(journals: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Families by relevance: exact 0, prefix 1, contained 2; canonical row first, then id."""
    from ..plans.filters import fold_text

    t, needle = fold(F.col("title")), fold_text(q)
    rows = with_family(journals).where(F.contains(t, F.lit(needle))).withColumn("score", F.when(t == needle, 0).when(F.startswith(t, F.lit(needle)), 1).otherwise(2))
    return rows.groupBy("fid").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("rows")).orderBy("score", "fid").limit(limit)


def most_articles(items: DataFrame, limit: int = 10) -> DataFrame:
    """Journals of a set of works: by family if linked, else by folded name; best stratum and most frequent spelling."""
    name = F.coalesce("journal_name", F.lit(""))
    key = F.coalesce(F.concat(F.lit("f"), F.col("qualis_journal_id").cast("string")), F.concat(F.lit("n"), fold(name)))
    a = items.where("item_type = 'ARTIGO'").select(key.alias("journal"), name.alias("spelling"), F.nullif(F.col("qualis"), F.lit("")).alias("qualis"), keys.article_key().alias("article"))
    n = a.groupBy("journal").agg(F.countDistinct("article").alias("articles"), F.min("qualis").alias("qualis"))
    s = a.groupBy("journal", "spelling").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("journal").orderBy(F.desc("n"), "spelling")
    s = s.withColumn("place", F.row_number().over(w)).where("place = 1").select("journal", "spelling")
    return n.join(s, "journal").orderBy(F.desc("articles"), "journal").limit(limit)
