"""Search, panorama and profiles (inventory A30-A36, A40-A43, T1-T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..plans.filters import ResearchFilter, apply_filter, fold_text, major_area_code, relevance
from ..functions.text import fold, normalized
from .summaries import count_if


def experts(items: DataFrame, researchers: DataFrame, f: ResearchFilter, areas: DataFrame | None = None, order: str = "relevancia") -> DataFrame:
    """Researchers by their best work's score, then works, then folded name; with the ids of their two best items (W3): by score, year and id, largest first.

    order: relevancia, recentes, publicacoes or nome. items: plain or `filters.prepared`.
    """
    hits = apply_filter(items, f, researchers, areas).select("researcher_id", "work", "id", relevance(f).alias("score"), F.coalesce("year", F.lit(0)).alias("year"))
    w = Window.partitionBy("researcher_id").orderBy(F.desc("score"), F.desc("year"), F.desc("id"))  # cut to two before the shuffle
    best = hits.withColumn("place", F.row_number().over(w)).where("place <= 2").groupBy("researcher_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",").alias("best_works"))
    works = hits.groupBy("researcher_id", "work").agg(F.max("score").alias("score"), F.max("year").alias("year"))
    n = works.groupBy("researcher_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("works"), F.nullif(F.max("year"), F.lit(0)).alias("last_year"))
    rows = n.join(best, "researcher_id").join(researchers.select(F.col("id").alias("researcher_id"), "full_name"), "researcher_id")
    sort = {"recentes": [F.desc_nulls_last("last_year"), F.desc("score"), F.desc("works")], "publicacoes": [F.desc("works"), F.desc("score")], "nome": []}.get(order, [F.desc("score"), F.desc("works")])
    return rows.orderBy(*sort, fold(F.col("full_name")), "researcher_id")


def publications(items: DataFrame, f: ResearchFilter, researchers: DataFrame | None = None, areas: DataFrame | None = None, order: str = "relevancia", family_rows: DataFrame | None = None) -> DataFrame:
    """Works with their score, last year, representative row, smallest title and owners, in one of four orders: relevancia, recentes, antigas, titulo.

    A work without year comes last but for titles; ties by the representative row. family_rows: as in `apply_filter`.
    """
    hits = apply_filter(items, f, researchers, areas, True, family_rows)
    hits = hits.select("work", "researcher_id", "id", "year", F.lower(F.trim("title")).alias("title"), relevance(f, True).alias("score"))
    # First by work and owner, so that owners are counted without a second row for each.
    part = hits.groupBy("work", "researcher_id").agg(F.max("score").alias("score"), F.max("year").alias("year"), F.min("id").alias("item"), F.min("title").alias("title"))
    rows = part.groupBy("work").agg(F.max("score").alias("score"), F.max("year").alias("year"), F.min("item").alias("item"), F.min("title").alias("title"), F.count("researcher_id").alias("owners"))
    late, last = F.desc_nulls_last("year"), F.desc("item")
    sort = {"recentes": [late, F.desc("score"), last], "antigas": [F.asc_nulls_last("year"), F.desc("score"), F.asc("item")], "titulo": [F.asc("title"), F.asc("item")]}.get(order, [F.desc("score"), late, last])
    return rows.orderBy(*sort)


def page(df: DataFrame, number: int, size: int, total: int | None = None) -> DataFrame:
    """T4: the page, clamped to those there are; df must be ordered by a unique key. Without a total the rows are counted."""
    last = max(1, -(-(df.count() if total is None else total) // size))
    return df.offset((min(max(1, number), last) - 1) * size).limit(size)


def name_search(researchers: DataFrame, counts: DataFrame, q: str) -> DataFrame:
    """Researchers whose folded name contains q, active ones first."""
    r = researchers.where(F.contains(fold(F.col("full_name")), F.lit(fold_text(q))))
    return r.select("id", "full_name", "status").join(counts, "id", "left").orderBy(F.desc("status"), fold(F.col("full_name")), "id")


def panorama_totals(items: DataFrame) -> DataFrame:
    """A30."""
    work = F.col("work") if "work" in items.columns else keys.work_key()
    works = items.groupBy(work.alias("work")).agg(F.max("year").alias("y")).agg(F.count(F.lit(1)).alias("works"), F.max("y").alias("last_year"))
    return works.crossJoin(items.select("researcher_id").distinct().agg(F.count("researcher_id").alias("researchers")))  # one row each


def works_per_year(items: DataFrame, as_of_year: int, first: int = 1950) -> DataFrame:
    """Distinct works by year, gaps between the first and last observed year filled with 0."""
    n = items.where(F.col("year").between(first, as_of_year)).select("year", keys.work_key().alias("work")).distinct().groupBy("year").agg(F.count(F.lit(1)).alias("works"))
    ends = n.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
    years = ends.select(F.explode(F.sequence("a", "b")).alias("year"))
    return years.join(n, "year", "left").select("year", F.coalesce("works", F.lit(0)).alias("works"))


def works_by_type(items: DataFrame) -> DataFrame:
    """A32."""
    return items.select("item_type", keys.work_key().alias("work")).distinct().groupBy("item_type").agg(F.count(F.lit(1)).alias("works"))


def major_area_catalogue(areas: DataFrame, items: DataFrame) -> DataFrame:
    """Researchers and distinct works by major area, both spellings together."""
    a = areas.select("researcher_id", major_area_code(F.col("major_area")).alias("code")).where("code IS NOT NULL").distinct()
    works = items.select("researcher_id", keys.work_key().alias("work")).distinct()
    return _catalogue(a, works, "code", [])


def area_catalogue(areas: DataFrame, items: DataFrame) -> DataFrame:
    """By area the smallest spelling of its major area, researchers and works."""
    a = areas.where("area IS NOT NULL AND area <> ''").select("researcher_id", "area", "major_area").distinct()
    works = items.select("researcher_id", keys.work_key().alias("work")).distinct()
    return _catalogue(a, works, "area", [F.min("major_area").alias("major_area")])


def _catalogue(areas: DataFrame, works: DataFrame, key: str, more: list) -> DataFrame:
    """Researchers and distinct works by area, each counted from its own distinct pairs, so that no row is expanded for two distinct counts."""
    people = areas.groupBy(key, "researcher_id").agg(*more) if more else areas.select(key, "researcher_id").distinct()
    first = people.groupBy(key).agg(F.count(F.lit(1)).alias("researchers"), *(F.min("major_area").alias("major_area") for _ in more))
    made = people.select(key, "researcher_id").join(works, "researcher_id").select(key, "work").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("works"))
    return first.join(made, key, "left").withColumn("works", F.coalesce("works", F.lit(0)))


def primary_major_area(areas: DataFrame) -> DataFrame:
    """The most frequent raw spelling of each researcher; ties by the smaller one."""
    n = areas.where("major_area IS NOT NULL AND major_area <> ''").groupBy("researcher_id", "major_area").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("researcher_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("major_area").alias("m"))).alias("x")).select("researcher_id", F.col("x.m").alias("major_area"))


def profile_kpis(items: DataFrame) -> DataFrame:
    """Counts, share with a DOI, first and last year, average per active year, of every researcher."""
    has_doi = F.trim(F.coalesce("doi", F.lit(""))) != ""
    n = items.groupBy("researcher_id").agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("item_type") == "ARTIGO").alias("articles"), count_if(F.col("item_type").isin("LIVRO", "CAPITULO")).alias("books"),
        count_if(has_doi).alias("with_doi"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("year").alias("active_years"), F.count("year").alias("dated"),
    )
    one = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round((a / b).cast("decimal(28,10)"), 1).cast("double"))
    return n.withColumns({"doi_percent": one(F.lit(100) * F.col("with_doi"), F.col("total")), "per_active_year": one(F.col("dated"), F.col("active_years"))}).drop("dated")


def orientation_counters(orientations: DataFrame) -> DataFrame:
    """Of every researcher the concluded and ongoing orientations by level."""
    done = keys.concluded()
    levels = ("MESTRADO", "DOUTORADO", "POS_DOUTORADO", "INICIACAO_CIENTIFICA", "TCC_GRADUACAO", "ESPECIALIZACAO", "OUTRA")
    cells = [count_if((F.col("orientation_type") == x) & (done if end == "done" else ~done)).alias(f"{x.lower()}_{end}") for x in levels for end in ("done", "open")]
    return orientations.groupBy("researcher_id").agg(*cells)


# The groups of the profile's production timeline, other types being "others".
GROUPS = {"articles": ["ARTIGO"], "books": ["LIVRO", "CAPITULO"], "newspapers": ["TEXTO_JORNAL"], "events": ["EVENTO"], "technical": ["TRABALHO_TECNICO", "OUTRA_TECNICA", "SOFTWARE", "PATENTE", "MARCA"]}
LEVELS = {"doctorates": "DOUTORADO", "masters": "MESTRADO", "postdocs": "POS_DOUTORADO", "undergraduate": "TCC_GRADUACAO", "initiation": "INICIACAO_CIENTIFICA", "specialisation": "ESPECIALIZACAO"}


def profile_timeline(items: DataFrame, orientations: DataFrame, researcher_id: int, as_of_year: int) -> DataFrame:
    """One researcher's productions in six groups and concluded orientations in seven, by year, from max(1980, first) to max(now, last), zero-filled.

    First and last year are over productions and all orientations; without any year only this year is there.
    """
    mine = items.where(F.col("researcher_id") == researcher_id)
    theirs = orientations.where(F.col("researcher_id") == researcher_id)
    kind, level = F.col("item_type"), F.col("orientation_type")
    groups = {**{g: kind.isin(types) for g, types in GROUPS.items()}, "others": ~kind.isin([t for types in GROUPS.values() for t in types])}
    levels = {**{g: level == t for g, t in LEVELS.items()}, "other_levels": ~level.isin(list(LEVELS.values()))}
    p = mine.where("year IS NOT NULL").groupBy("year").agg(*(count_if(c).alias(g) for g, c in groups.items()))
    o = theirs.where(F.col("year").isNotNull() & keys.concluded()).groupBy("year").agg(*(count_if(c).alias(g) for g, c in levels.items()))
    years = mine.select("year").unionByName(theirs.select("year")).agg(F.min("year").alias("a"), F.max("year").alias("b"))
    now = F.lit(as_of_year)
    ends = years.select(F.greatest(F.lit(1980), F.coalesce("a", now)).alias("a"), F.greatest(now, F.coalesce("b", now)).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("year")).join(p, "year", "left").join(o, "year", "left").fillna(0)


def collaborators(authors: DataFrame, works: DataFrame, limit: int = 12) -> DataFrame:
    """Who stands beside a researcher on their works, once for each work: matched researcher, else identity, else normalised name.

    With the number of works, first and last year, the counts of types (most first, then by name) and up to two titles, in the order of the
    works. authors: work, author_name, matched_researcher_id, author_identity_id; works: id, year, item_type, title. Names under three
    characters don't count; ties by person.
    """
    key = F.coalesce(F.concat(F.lit("r"), F.col("matched_researcher_id").cast("string")), F.concat(F.lit("i"), F.col("author_identity_id").cast("string")), F.concat(F.lit("n"), normalized(F.col("author_name"), upper=True)))
    named = authors.where(F.col("matched_researcher_id").isNotNull() | F.col("author_identity_id").isNotNull() | (F.length(F.trim("author_name")) >= 3))
    a = named.select("work", key.alias("person")).distinct().join(works.withColumnRenamed("id", "work"), "work")
    top = a.groupBy("person").agg(F.count(F.lit(1)).alias("works"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).orderBy(F.desc("works"), "person").limit(limit)
    near = a.join(F.broadcast(top.select("person")), "person")  # `limit` rows
    types = near.where("item_type <> ''").groupBy("person", "item_type").agg(F.count(F.lit(1)).alias("n")).groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "item_type", "n"))), lambda x: F.concat_ws(":", x["item_type"], x["n"].cast("string"))), ",").alias("types"))
    w = Window.partitionBy("person").orderBy("work")
    samples = near.withColumn("place", F.row_number().over(w)).where("place <= 2").groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), " | ").alias("samples"))
    return top.join(types, "person", "left").join(samples, "person", "left")
