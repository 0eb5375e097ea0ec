"""The six keys of a unique work and the domain's predicates (inventory K1-K6, N25, B26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, normalized


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _has_doi() -> Column:
    return F.trim(_text("doi")) != ""


def work_key() -> Column:
    """K1: MD5, accents count."""
    other = F.concat(F.lit("T:"), F.col("item_type"), F.lit(":"), _text("year"), F.lit(":"), F.lower(F.trim(F.col("title"))))
    return F.md5(F.when(_has_doi(), F.concat(F.lit("DOI:"), F.lower(F.trim("doi")))).otherwise(other))


def production_key() -> Column:
    """K2: type, year and title, by collation."""
    other = F.concat(F.lit("TITLE:"), F.col("item_type"), F.lit(":"), _text("year"), F.lit(":"), fold(F.col("title")))
    return F.when(_has_doi(), F.concat(F.lit("DOI:"), fold(F.col("doi")))).otherwise(other)


def article_key() -> Column:
    """K3: without the type."""
    other = F.concat(F.lit("TITLE:"), _text("year"), F.lit(":"), fold(F.col("title")))
    return F.when(_has_doi(), F.concat(F.lit("DOI:"), fold(F.col("doi")))).otherwise(other)


def book_key() -> Column:
    """K4: ISBN first."""
    isbn = F.trim(_text("isbn"))
    first = F.concat(F.lit("ISBN:"), F.col("item_type"), F.lit(":"), isbn, F.lit(":"), fold(F.col("title")))
    return F.when(isbn != "", first).otherwise(F.concat(F.lit("TITLE:"), F.col("item_type"), F.lit(":"), _text("year"), F.lit(":"), fold(F.col("title"))))


def coauthor_key() -> Column:
    """K5: without the year."""
    other = F.concat(F.lit("TITLE:"), F.col("item_type"), F.lit(":"), fold(F.col("title")))
    return F.when(_has_doi(), F.concat(F.lit("DOI:"), fold(F.col("doi")))).otherwise(other)


def family_article_key() -> Column:
    """K6: year and explicitly folded title."""
    return F.when(_has_doi(), F.concat(F.lit("DOI:"), F.lower(F.trim("doi")))).otherwise(F.concat(F.lit("TITLE:"), _text("year"), F.lit(":"), normalized(F.col("title"))))


def project_key(name: str = "name", year: str = "start_year") -> Column:
    """Null for an untitled project."""
    n = normalized(F.col(name))
    return F.when(n != "", F.sha1(F.concat(n, F.lit("|"), _text(year))))


def has_qualis() -> Column:
    """Whether a stratum is given."""
    return F.coalesce(F.col("qualis") != "", F.lit(False))


def concluded() -> Column:
    """Whether an orientation counts as concluded."""
    return F.coalesce(F.col("nature") == "CONCLUIDA", F.lit(False)) | F.col("handle").isNotNull()


def venue() -> Column:
    """The first of journal, event and publisher that isn't empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("journal_name", "event_name", "publisher")))
