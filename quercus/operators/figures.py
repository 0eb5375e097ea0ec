"""Indicator figures (inventory A10-A16, A19-A25, A28, A29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import normalized, rule_chain
from .summaries import _alias, count_if

# Strata in their order.
STRATA = ["A1", "A2", "A3", "A4", "B1", "B2", "B3", "B4", "C"]
# Production types of the heat map, in their order.
HEAT_TYPES = ["ARTIGO", "LIVRO", "CAPITULO", "EVENTO", "TEXTO_JORNAL", "TRABALHO_TECNICO", "OUTRA_TECNICA", "SOFTWARE", "PRODUCAO_ARTISTICA", "OUTRA"]
# Substrings of a normalised course name and the major area they lead to; the first rule that fits wins.
COURSE_AREAS = [
    ("Ciências da Saúde", ["educacao fisica", "fonoaudiologia", "enfermagem", "medicina", "odontologia", "fisioterapia", "terapia ocupacional", "nutricao", "farmacia", "saude"]),
    ("Engenharias", ["engenharia", "mecanica", "eletrica", "materiais", "metalurgica", "mecatronica", "producao"]),
    ("Linguística, Letras e Artes", ["letras", "linguistica", "musica", "artes", "desenho", "cinema", "audiovisual", "teatro", "danca"]),
    ("Ciências Sociais Aplicadas", ["direito", "juridica", "biblioteconomia", "comunicacao", "jornalismo", "administracao", "economia", "economica", "relacoes publicas", "publicidade", "arquitetura", "servico social"]),
    ("Ciências Humanas", ["pedagogia", "ciencias sociais", "sociologia", "filosofia", "psicologia", "historia", "educacao especial", "educacao escolar", "educacao", "antropologia", "ciencia politica", "geografia", "teologia"]),
    ("Ciências Exatas e da Terra", ["fisica", "matematica", "quimica", "computacao", "dados", "geologia", "estatistica", "informatica"]),
    ("Ciências Biológicas", ["biolog", "biomedicina", "ecologia", "genetica", "botanica", "zoologia"]),
    ("Ciências Agrárias", ["agraria", "agronomia", "veterinaria", "zootecnia", "florestal", "pesca"]),
]
# Categories of trajectory institutions.
PAULISTAS = ["PUC-SP", "PUC-Campinas", "UNIFESP", "Mackenzie", "UNIMEP", "UEL", "UEM", "USF", "UNISO", "FADISC", "FESPSP", "UNIVESP"]
NO_GRADUATION, NO_MASTER, NO_DOCTORATE, DIRECT = "Graduação Não Inf.", "Mestrado Não Inf.", "Doutorado Não Inf.", "Doutorado Direto"


def calendar(df: DataFrame, first: int, last: int, column: str = "year") -> DataFrame:
    """D3: all years from first to last."""
    return df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(column))


def share(a: Column, b: Column, places: int = 1) -> Column:
    """A percentage, half away from zero; 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.round((F.lit(100) * a / b).cast("decimal(28,10)"), places).cast("double"))


def faculty_by_department(researchers: DataFrame) -> DataFrame:
    """A10: active faculty by department code; an empty one is 'Outros'."""
    code = F.coalesce(F.nullif(_alias(F.col("department_code")), F.lit("")), F.lit("Outros"))
    return researchers.where("status = 1").groupBy(code.alias("department")).agg(F.count(F.lit(1)).alias("faculty"))


def major_area_of_course(c: Column) -> Column:
    """N6, of a normalised course name."""
    return rule_chain(c, COURSE_AREAS, F.lit("Outras"))


def degrees(educations: DataFrame, per_area: int = 3) -> DataFrame:
    """Degrees by course within their major area; the limit holds in each area, ties by folded name."""
    rows = educations.where("level = 'GRADUACAO' AND course_name IS NOT NULL AND course_name <> ''").groupBy("course_name").agg(F.count(F.lit(1)).alias("total"))
    # The normalised name is a column of its own: the rules look at it many times.
    rows = rows.withColumn("__name", normalized(F.col("course_name"))).withColumn("area", major_area_of_course(F.col("__name"))).drop("__name")
    w = Window.partitionBy("area").orderBy(F.desc("total"), F.lower("course_name"), "course_name")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_area).select("area", "course_name", "total", "place")


def top_doctorates(educations: DataFrame, limit: int = 12) -> DataFrame:
    """A12."""
    e = educations.where("level = 'DOUTORADO' AND institution_name IS NOT NULL")
    return e.groupBy("institution_name").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "institution_name").limit(limit)


def knowledge_areas(areas: DataFrame) -> DataFrame:
    """Rows by area, not researchers."""
    return areas.where("area IS NOT NULL AND area <> ''").groupBy("area").agg(F.count(F.lit(1)).alias("total"))


def advisee_courses(orientations: DataFrame) -> DataFrame:
    """Course, else the repository's programme."""
    course = F.coalesce(F.nullif(F.trim("course_name"), F.lit("")), F.col("program"))
    return orientations.groupBy(course.alias("course")).agg(F.count(F.lit(1)).alias("total")).where("course IS NOT NULL")


def concluded_by_year(orientations: DataFrame, as_of_year: int, first: int = 2010) -> DataFrame:
    """Concluded orientations of four types by year; years without any are 0."""
    types = ["INICIACAO_CIENTIFICA", "MESTRADO", "DOUTORADO", "POS_DOUTORADO"]
    rows = orientations.where(keys.concluded() & F.col("year").between(first, as_of_year))
    n = rows.groupBy("year").agg(*(count_if(F.col("orientation_type") == t).alias(t.lower()) for t in types))
    return calendar(orientations, first, as_of_year).join(n, "year", "left").fillna(0)


def heat_map(items: DataFrame) -> DataFrame:
    """Year by ten types with row totals; PATENTE and MARCA count as SOFTWARE, other types drop; year null is the grand total."""
    kind = F.when(F.col("item_type").isin("PATENTE", "MARCA"), "SOFTWARE").otherwise(F.col("item_type"))
    rows = items.where("year IS NOT NULL").select("year", kind.alias("kind")).where(F.col("kind").isin(HEAT_TYPES))
    cells = [count_if(F.col("kind") == t).alias(t.lower()) for t in HEAT_TYPES]
    return rows.rollup("year").agg(*cells, F.count(F.lit(1)).alias("total"))


def with_qualis_by_year(items: DataFrame, first: int, last: int) -> DataFrame:
    """Articles with and without a stratum, zero-filled."""
    rows = items.where((F.col("item_type") == "ARTIGO") & F.col("year").between(first, last))
    n = rows.groupBy("year").agg(count_if(keys.has_qualis()).alias("with_qualis"), count_if(~keys.has_qualis()).alias("without_qualis"))
    return calendar(items, first, last).join(n, "year", "left").fillna(0)


def strata_by_year(items: DataFrame) -> DataFrame:
    """Nine strata by year with totals; others drop; year null is the grand total."""
    rows = items.where(F.col("qualis").isin(STRATA) & (F.col("item_type") == "ARTIGO") & F.col("year").isNotNull())
    return rows.rollup("year").agg(*(count_if(F.col("qualis") == s).alias(s.lower()) for s in STRATA), F.count(F.lit(1)).alias("total"))


def researcher_strata(items: DataFrame, links: DataFrame) -> DataFrame:
    """Per researcher the articles of A1 to A4 and the databases that index them, sorted."""
    a = items.where((F.col("item_type") == "ARTIGO") & F.col("qualis").isin("A1", "A2", "A3", "A4"))
    counts = a.groupBy("researcher_id").agg(*(count_if(F.col("qualis") == s).alias(s.lower()) for s in STRATA[:4]), F.count(F.lit(1)).alias("total"))
    bases = a.select("researcher_id", F.col("qualis_journal_id").alias("journal_id")).distinct().join(links, "journal_id").groupBy("researcher_id").agg(F.array_join(F.array_sort(F.collect_set("database_id")), ",").alias("databases"))
    return counts.join(bases, "researcher_id", "left").withColumn("databases", F.coalesce("databases", F.lit("")))


def database_figure(items: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct articles by database, their share of all and of indexed articles."""
    a = items.where("item_type = 'ARTIGO'").select("id", F.col("qualis_journal_id").alias("journal_id"))
    hits = a.join(links, "journal_id").select("id", "database_id").distinct()
    n = hits.groupBy("database_id").agg(F.count(F.lit(1)).alias("articles"))
    total = a.agg(F.count(F.lit(1)).alias("every"))
    indexed = hits.select("id").distinct().agg(F.count(F.lit(1)).alias("indexed"))
    out = n.crossJoin(total).crossJoin(indexed)  # one row each
    return out.select("database_id", "articles", share(F.col("articles"), F.col("every")).alias("of_all"), share(F.col("articles"), F.col("indexed")).alias("of_indexed"))


def category(c: Column) -> Column:
    """The prefix test minds case."""
    return (
        F.when(c.isNull() | (c == "") | c.isin(NO_GRADUATION, NO_MASTER, NO_DOCTORATE), "Outras").when(c.isin("USP", "UFSCar", "UNICAMP", "UNESP"), c).when(c.isin(PAULISTAS), "Paulistas")
        .when(F.startswith(c, F.lit("Exterior")), "Exterior").when(c.rlike("^(UF|IF|UNB|UTFPR)"), "Federais").otherwise("Outras")
    )


def trajectories(educations: DataFrame) -> DataFrame:
    """Paths of graduation, master's and doctorate institutions with their counts; the first of each level by year (null first), then id."""
    order = F.struct(F.col("start_year").isNotNull().alias("a"), F.coalesce("start_year", F.lit(0)).alias("b"), F.col("id").alias("c"))
    pick = lambda level: F.min_by(F.when(F.col("level") == level, F.col("institution_name")), F.when(F.col("level") == level, order))
    per = educations.groupBy("researcher_id").agg(pick("GRADUACAO").alias("g"), pick("MESTRADO").alias("m"), pick("DOUTORADO").alias("d"))
    master = F.coalesce("m", F.when(F.col("d").isNotNull(), DIRECT).otherwise(NO_MASTER))
    paths = per.select(F.coalesce("g", F.lit(NO_GRADUATION)).alias("graduation"), master.alias("master"), F.coalesce("d", F.lit(NO_DOCTORATE)).alias("doctorate"))
    return paths.groupBy("graduation", "master", "doctorate", category(F.col("doctorate")).alias("category")).agg(F.count(F.lit(1)).alias("total"))


def exit_destinations(researchers: DataFrame, experiences: DataFrame, as_of_year: int, own: str) -> DataFrame:
    """Best destination of each exited researcher by points: current 50, start after leaving 30, end after leaving 20, contract 15.

    Own and editorial institutions are left out; of equal scores the first by current, end and start, descending, wins; a missing leave year is 2020.
    """
    exited = researchers.where(f"status = 0 OR (leave_year IS NOT NULL AND leave_year < {as_of_year})").select(F.col("id").alias("researcher_id"), F.coalesce("leave_year", F.lit(2020)).alias("leave"))
    e = experiences.where((F.col("institution_name") != own) & ~F.startswith(F.col("institution_name"), F.lit("Revista"))).join(exited, "researcher_id")
    points = (
        F.when(F.col("is_current"), 50).otherwise(0) + F.when(F.col("start_year") >= F.col("leave"), 30).otherwise(0) + F.when(F.coalesce("end_year", F.lit(0)) >= F.col("leave"), 20).otherwise(0)
        + F.when(F.contains(F.lower(F.coalesce("contract_type", F.lit(""))), F.lit("servidor")) | F.contains(F.lower(F.coalesce("contract_type", F.lit(""))), F.lit("professor")), 15).otherwise(0)
    )
    w = Window.partitionBy("researcher_id").orderBy(F.desc("score"), F.desc("is_current"), F.desc_nulls_last("end_year"), F.desc("start_year"), "id")
    best = e.withColumn("score", points).where("score > 0").withColumn("place", F.row_number().over(w)).where("place = 1")
    return best.groupBy(F.col("institution_name").alias("destination")).agg(F.count(F.lit(1)).alias("researchers"), F.sum("score").cast("bigint").alias("points"))
