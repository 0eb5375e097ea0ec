"""Global summary, home page and per-group counts (inventory A1-A9, A15, A17, A18, A58, A59, A66)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import fold

# A department code that is shown under another.
DEPARTMENT_ALIAS = {"DCSo": "CS"}


def count_if(cond) -> F.Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _alias(c):
    for old, new in DEPARTMENT_ALIAS.items():
        c = F.when(c == old, new).otherwise(c)
    return c


def global_summary(researchers: DataFrame, items: DataFrame, orientations: DataFrame) -> DataFrame:
    """A1: one row of thirteen figures: raw counts by type, distinct works by three different keys, concluded orientations. Empty tables count 0."""
    r = researchers.agg(F.count(F.lit(1)).alias("researchers"), F.coalesce(count_if(F.col("status") == 1), F.lit(0)).alias("active"))
    kind = F.col("item_type")
    book = kind.isin("LIVRO", "CAPITULO")
    # One distinct aggregate each in its own pass: pre-aggregated by key, so no row is expanded.
    n = lambda cond, name: F.coalesce(count_if(cond), F.lit(0)).alias(name)
    raw = items.agg(F.count(F.lit(1)).alias("productions"), n(kind == "ARTIGO", "articles"), n((kind == "ARTIGO") & keys.has_qualis(), "qualis_articles"), n(kind == "LIVRO", "books"), n(kind == "CAPITULO", "chapters"), n(book, "books_and_chapters"), n(kind == "EVENTO", "event_works"))
    u2 = items.select(keys.production_key().alias("k")).distinct().agg(F.count("k").alias("unique_productions"))
    u3 = items.where((kind == "ARTIGO") & keys.has_qualis()).select(keys.article_key().alias("k")).distinct().agg(F.count("k").alias("unique_qualis_articles"))
    u4 = items.where(book).select(keys.book_key().alias("k")).distinct().agg(F.count("k").alias("unique_books"))
    o = orientations.where(keys.concluded()).agg(F.count(F.lit(1)).alias("concluded_orientations"))
    out = r
    for x in (raw, u2, u3, u4, o):  # one row each
        out = out.crossJoin(x)
    return out


def top_departments(researchers: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """A2: active researchers and production rows by department; ties by name. Counts are made before the join."""
    per = items.groupBy("researcher_id").agg(F.count(F.lit(1)).alias("n"))
    dept = _alias(F.coalesce(F.nullif(F.col("department_code"), F.lit("")), F.nullif(F.col("department"), F.lit(""))))
    r = researchers.where("status = 1").select(F.col("id").alias("researcher_id"), dept.alias("department"))
    rows = r.join(per, "researcher_id", "left").groupBy("department").agg(F.count(F.lit(1)).alias("faculty"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("productions"))
    return rows.where("department IS NOT NULL").orderBy(F.desc("faculty"), F.desc("productions"), "department").limit(limit)


def featured_researchers(researchers: DataFrame, items: DataFrame, limit: int = 6) -> DataFrame:
    """A3: most A1 articles, then most productions, then id."""
    per = items.groupBy("researcher_id").agg(count_if((F.col("item_type") == "ARTIGO") & (F.col("qualis") == "A1")).alias("a1"), F.count(F.lit(1)).alias("total"))
    r = researchers.where("status = 1").select(F.col("id").alias("researcher_id"), "full_name")
    return per.join(r, "researcher_id").orderBy(F.desc("a1"), F.desc("total"), "researcher_id").limit(limit)


def per_year(items: DataFrame, first: int, last: int) -> DataFrame:
    """A4: production rows by year in a range; years without rows are absent."""
    return items.where(F.col("year").between(first, last)).groupBy("year").agg(F.count(F.lit(1)).alias("total"))


def by_type(items: DataFrame) -> DataFrame:
    """A5: production rows by type."""
    return items.groupBy("item_type").agg(F.count(F.lit(1)).alias("total"))


def qualis_distribution(items: DataFrame) -> DataFrame:
    """Articles by stratum; without one they are 'Sem Qualis'."""
    stratum = F.coalesce(F.nullif(F.col("qualis"), F.lit("")), F.lit("Sem Qualis"))
    return items.where("item_type = 'ARTIGO'").groupBy(stratum.alias("qualis")).agg(F.count(F.lit(1)).alias("total"))


def per_researcher(items: DataFrame) -> DataFrame:
    """Production rows by researcher."""
    return items.groupBy("researcher_id").agg(F.count(F.lit(1)).alias("total"))


def department_faculty(researchers: DataFrame) -> DataFrame:
    """Active researchers by department name, collated: names that fold alike are one, under the smallest spelling."""
    r = researchers.where("status = 1 AND department IS NOT NULL AND department <> ''")
    return r.groupBy(fold(F.col("department")).alias("folded")).agg(F.min("department").alias("department"), F.countDistinct("id").alias("faculty")).drop("folded")


def researcher_counts(researchers: DataFrame, items: DataFrame, orientations: DataFrame) -> DataFrame:
    """Production and orientation counts of every researcher; both sides are aggregated before they are joined."""
    p = items.groupBy(F.col("researcher_id").alias("id")).agg(F.count(F.lit(1)).alias("productions"))
    o = orientations.groupBy(F.col("researcher_id").alias("id")).agg(F.count(F.lit(1)).alias("orientations"))
    out = researchers.select("id", "full_name").join(p, "id", "left").join(o, "id", "left")
    return out.select("id", "full_name", F.coalesce("productions", F.lit(0)).alias("productions"), F.coalesce("orientations", F.lit(0)).alias("orientations"))


def orientation_evolution(orientations: DataFrame, as_of_year: int) -> DataFrame:
    """Year, type and effective nature, 1970 to next year."""
    nature = F.when(keys.concluded(), "CONCLUIDA").otherwise("EM_ANDAMENTO")
    rows = orientations.where(F.col("year").between(1970, as_of_year + 1))
    return rows.groupBy("year", "orientation_type", nature.alias("effective_nature")).agg(F.count(F.lit(1)).alias("total"))


def birth_states(researchers: DataFrame, limit: int = 15) -> DataFrame:
    """A15."""
    r = researchers.where("status = 1 AND birth_state IS NOT NULL AND birth_state <> ''")
    return r.groupBy("birth_state").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "birth_state").limit(limit)


def contract_types(experiences: DataFrame, limit: int = 8) -> DataFrame:
    """Ties by name."""
    e = experiences.where("contract_type IS NOT NULL AND contract_type <> ''")
    return e.groupBy("contract_type").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "contract_type").limit(limit)


def level_pyramid(orientations: DataFrame) -> DataFrame:
    """One row of counts over all natures, concluded or not."""
    levels = ("INICIACAO_CIENTIFICA", "TCC_GRADUACAO", "ESPECIALIZACAO", "MESTRADO", "DOUTORADO", "POS_DOUTORADO")
    return orientations.agg(*(F.coalesce(count_if(F.col("orientation_type") == x), F.lit(0)).alias(x.lower()) for x in levels))


def indexing_overview(researchers: DataFrame, items: DataFrame, authors: DataFrame, as_of_year: int) -> DataFrame:
    """One row: researchers (all, indexed, pending, active, retired), productions, articles (all, with stratum, journal, databases), authors (all, indexed, of the house),
    and the percentage of indexed researchers to one place. Retired is everyone who isn't active."""
    n = lambda cond, name: F.coalesce(count_if(cond), F.lit(0)).alias(name)
    there = lambda c: F.col(c).isNotNull()
    stays = F.coalesce(F.col("leave_year") >= as_of_year, F.lit(True))
    r = researchers.agg(
        F.count(F.lit(1)).alias("researchers"), n(there("last_indexed_at"), "indexed"), n(~there("last_indexed_at"), "pending"), n((F.col("status") == 1) & stays, "active"), n((F.col("status") == 0) | ~stays, "retired")
    )
    article = F.col("item_type") == "ARTIGO"
    i = items.agg(
        F.count(F.lit(1)).alias("productions"), n(article, "articles"), n(article & there("qualis"), "with_qualis"), n(article & there("qualis_journal_id"), "with_journal"), n(article & there("indexed_databases"), "with_databases")
    )
    a = authors.agg(F.count(F.lit(1)).alias("authors"), n(F.col("is_indexed"), "indexed_authors"), n(F.col("is_own_researcher"), "matched_authors"))
    percent = F.when(F.col("researchers") == 0, 0.0).otherwise(F.round((F.lit(100) * F.col("indexed") / F.col("researchers")).cast("decimal(18,6)"), 1).cast("double"))
    return r.crossJoin(i).crossJoin(a).withColumn("percentage", percent)  # one row each
