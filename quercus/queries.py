"""The registered queries of the engine over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, rules, text
from .operators import areas, authority, curation, entities, families as fam, figures, graph, journals, projects, research, summaries, topics
from .plans.bindings import load, once, prepared_items, with_sql
from .plans.filters import MAJOR_AREAS, ResearchFilter, apply_filter, fold_text
from .streaming import events as streaming_events

YEAR = 2026  # D4: the year that the queries are asked in

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *tables: str):
    """Register f(load, spark, sf_dir) under name; sql follows the WITH clause of the tables it names."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: load(spark, sf_dir, t), spark, sf_dir)
        if sql is not None:
            SQL[name] = (with_sql(*tables) + "\n" if tables else "") + sql
        return f

    return add


# SQL twins of the shared expressions.
def f_(x: str) -> str:
    return f"strip_accents(lower(trim({x})))"


_Y, _HASDOI = "coalesce(CAST(year AS VARCHAR), '')", "trim(coalesce(doi, '')) <> ''"
K1 = f"md5(CASE WHEN {_HASDOI} THEN 'DOI:' || lower(trim(doi)) ELSE 'T:' || item_type || ':' || {_Y} || ':' || lower(trim(title)) END)"
K2 = f"CASE WHEN {_HASDOI} THEN 'DOI:' || {f_('doi')} ELSE 'TITLE:' || item_type || ':' || {_Y} || ':' || {f_('title')} END"
K3 = f"CASE WHEN {_HASDOI} THEN 'DOI:' || {f_('doi')} ELSE 'TITLE:' || {_Y} || ':' || {f_('title')} END"
K4 = f"CASE WHEN trim(coalesce(isbn, '')) <> '' THEN 'ISBN:' || item_type || ':' || trim(isbn) || ':' || {f_('title')} ELSE 'TITLE:' || item_type || ':' || {_Y} || ':' || {f_('title')} END"
K5 = f"CASE WHEN {_HASDOI} THEN 'DOI:' || {f_('doi')} ELSE 'TITLE:' || item_type || ':' || {f_('title')} END"
N1 = lambda x: f"trim(regexp_replace(regexp_replace({f_(x)}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
TOPIC = lambda x: f"regexp_replace(trim(regexp_replace(translate(lower(trim({x})), '{text.TOPIC_ACCENTS}', '{text.TOPIC_PLAIN}'), '[^a-z0-9\\s]', ' ', 'g')), '\\s+', ' ', 'g')"
DONE = "(nature = 'CONCLUIDA' OR handle IS NOT NULL)"
HASQ = "coalesce(qualis <> '', false)"
ALIAS = "CASE WHEN {0} = 'DCSo' THEN 'CS' ELSE {0} END"
I, R, O, A, J, L, KA, P, E, X = "production_items", "researchers", "orientations", "production_authors", "journals", "journal_databases", "knowledge_areas", "projects", "educations", "experiences"

# --- keys -------------------------------------------------------------------------------------------------------------
for _n, (_f, _k) in {"k1_work_key": (keys.work_key, K1), "k2_production_key": (keys.production_key, K2), "k3_article_key": (keys.article_key, K3), "k4_book_key": (keys.book_key, K4), "k5_coauthor_key": (keys.coauthor_key, K5)}.items():
    query(_n, f"SELECT id, {_k} AS key FROM {I}", I)(lambda t, s, d, _f=_f: t(I).select("id", _f().alias("key")))


@query("k6_family_article_key", f"SELECT id, CASE WHEN {_HASDOI} THEN 'DOI:' || lower(trim(doi)) ELSE 'TITLE:' || {_Y} || ':' || {N1('title')} END AS key FROM {I}", I)
def _(t, s, d):
    return t(I).select("id", keys.family_article_key().alias("key"))


# --- summaries --------------------------------------------------------------------------------------------------------
_c = lambda cond, name: f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS {name}"


@query("a1_global_summary", f"""SELECT (SELECT count(*) FROM {R}) AS researchers, (SELECT count(*) FROM {R} WHERE status = 1) AS active,
 count(*) AS productions, {_c("item_type = 'ARTIGO'", 'articles')}, {_c(f"item_type = 'ARTIGO' AND {HASQ}", 'qualis_articles')}, {_c("item_type = 'LIVRO'", 'books')}, {_c("item_type = 'CAPITULO'", 'chapters')}, {_c("item_type IN ('LIVRO', 'CAPITULO')", 'books_and_chapters')}, {_c("item_type = 'EVENTO'", 'event_works')},
 count(DISTINCT {K2}) AS unique_productions, count(DISTINCT {K3}) FILTER (WHERE item_type = 'ARTIGO' AND {HASQ}) AS unique_qualis_articles,
 count(DISTINCT {K4}) FILTER (WHERE item_type IN ('LIVRO', 'CAPITULO')) AS unique_books, (SELECT count(*) FROM {O} WHERE {DONE}) AS concluded_orientations FROM {I}""", R, I, O)
def _(t, s, d):
    return summaries.global_summary(t(R), t(I), t(O))


_DEPT = ALIAS.format("coalesce(nullif(department_code, ''), nullif(department, ''))")


@query("a2_top_departments", f"""SELECT department, count(*) AS faculty, CAST(coalesce(sum(n), 0) AS BIGINT) AS productions FROM (SELECT id, {_DEPT} AS department FROM {R} WHERE status = 1) r
 LEFT JOIN (SELECT researcher_id, count(*) AS n FROM {I} GROUP BY 1) p ON p.researcher_id = r.id WHERE department IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""", R, I)
def _(t, s, d):
    return summaries.top_departments(t(R), t(I))


@query("a3_featured_researchers", f"""SELECT researcher_id, full_name, {_c("item_type = 'ARTIGO' AND qualis = 'A1'", 'a1')}, count(*) AS total FROM {I} JOIN {R} r ON r.id = researcher_id WHERE r.status = 1
 GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1 LIMIT 6""", R, I)
def _(t, s, d):
    return summaries.featured_researchers(t(R), t(I))


@query("a4_per_year", f"SELECT year, count(*) AS total FROM {I} WHERE year BETWEEN 2000 AND 2015 GROUP BY 1", I)
def _(t, s, d):
    return summaries.per_year(t(I), 2000, 2015)


@query("a5_by_type", f"SELECT item_type, count(*) AS total FROM {I} GROUP BY 1", I)
def _(t, s, d):
    return summaries.by_type(t(I))


@query("a5_qualis_distribution", f"SELECT coalesce(nullif(qualis, ''), 'Sem Qualis') AS qualis, count(*) AS total FROM {I} WHERE item_type = 'ARTIGO' GROUP BY 1", I)
def _(t, s, d):
    return summaries.qualis_distribution(t(I))


@query("a6_per_researcher", f"SELECT researcher_id, count(*) AS total FROM {I} GROUP BY 1", I)
def _(t, s, d):
    return summaries.per_researcher(t(I))


@query("a7_department_faculty", f"SELECT min(department) AS department, count(DISTINCT id) AS faculty FROM {R} WHERE status = 1 AND department <> '' GROUP BY {f_('department')}", R)
def _(t, s, d):
    return summaries.department_faculty(t(R))


@query("a8_researcher_counts", f"""SELECT id, full_name, coalesce(p.n, 0) AS productions, coalesce(o.n, 0) AS orientations FROM {R}
 LEFT JOIN (SELECT researcher_id, count(*) AS n FROM {I} GROUP BY 1) p ON p.researcher_id = id LEFT JOIN (SELECT researcher_id, count(*) AS n FROM {O} GROUP BY 1) o ON o.researcher_id = id""", R, I, O)
def _(t, s, d):
    return summaries.researcher_counts(t(R), t(I), t(O))


@query("a9_orientation_evolution", f"SELECT year, orientation_type, CASE WHEN {DONE} THEN 'CONCLUIDA' ELSE 'EM_ANDAMENTO' END AS effective_nature, count(*) AS total FROM {O} WHERE year BETWEEN 1970 AND {YEAR + 1} GROUP BY 1, 2, 3", O)
def _(t, s, d):
    return summaries.orientation_evolution(t(O), YEAR)


@query("a15_birth_states", f"SELECT birth_state, count(*) AS total FROM {R} WHERE status = 1 AND birth_state <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", R)
def _(t, s, d):
    return summaries.birth_states(t(R))


@query("a17_contract_types", f"SELECT contract_type, count(*) AS total FROM {X} WHERE contract_type <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", X)
def _(t, s, d):
    return summaries.contract_types(t(X))


_LV = ("INICIACAO_CIENTIFICA", "TCC_GRADUACAO", "ESPECIALIZACAO", "MESTRADO", "DOUTORADO", "POS_DOUTORADO")
_q = lambda c, v: f"{c} = '{v}'"


@query("a18_level_pyramid", "SELECT " + ", ".join(_c(_q("orientation_type", x), x.lower()) for x in _LV) + f" FROM {O}", O)
def _(t, s, d):
    return summaries.level_pyramid(t(O))


@query("a58_indexing_overview", f"""SELECT r.*, i.*, a.*, CASE WHEN researchers = 0 THEN 0.0 ELSE CAST(round(CAST(100.0 * indexed / researchers AS DECIMAL(18, 6)), 1) AS DOUBLE) END AS percentage FROM
 (SELECT count(*) AS researchers, count(last_indexed_at) AS indexed, count(*) - count(last_indexed_at) AS pending, {_c(f'status = 1 AND (leave_year IS NULL OR leave_year >= {YEAR})', 'active')}, {_c(f'status = 0 OR leave_year < {YEAR}', 'retired')} FROM {R}) r,
 (SELECT count(*) AS productions, {_c("item_type = 'ARTIGO'", 'articles')}, {_c("item_type = 'ARTIGO' AND qualis IS NOT NULL", 'with_qualis')}, {_c("item_type = 'ARTIGO' AND qualis_journal_id IS NOT NULL", 'with_journal')}, {_c("item_type = 'ARTIGO' AND indexed_databases IS NOT NULL", 'with_databases')} FROM {I}) i,
 (SELECT count(*) AS authors, {_c('is_indexed', 'indexed_authors')}, {_c('is_own_researcher', 'matched_authors')} FROM {A}) a""", R, I, A)
def _(t, s, d):
    return summaries.indexing_overview(t(R), t(I), t(A), YEAR)


# --- figures ----------------------------------------------------------------------------------------------------------
@query("a10_faculty_by_department", f"SELECT coalesce(nullif({ALIAS.format('department_code')}, ''), 'Outros') AS department, count(*) AS faculty FROM {R} WHERE status = 1 GROUP BY 1", R)
def _(t, s, d):
    return figures.faculty_by_department(t(R))


_AREA = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({N1('course_name')}, '{n}')" for n in needles) + f" THEN '{a}'" for a, needles in figures.COURSE_AREAS) + " ELSE 'Outras' END"


@query("a11_degrees", f"""SELECT area, course_name, total, place FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY total DESC, lower(course_name), course_name) AS place FROM
 (SELECT {_AREA} AS area, course_name, count(*) AS total FROM {E} WHERE level = 'GRADUACAO' AND course_name <> '' GROUP BY 1, 2)) WHERE place <= 3""", E)
def _(t, s, d):
    return figures.degrees(t(E))


@query("a12_top_doctorates", f"SELECT institution_name, count(*) AS total FROM {E} WHERE level = 'DOUTORADO' AND institution_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", E)
def _(t, s, d):
    return figures.top_doctorates(t(E))


@query("a13_knowledge_areas", f"SELECT area, count(*) AS total FROM {KA} WHERE area <> '' GROUP BY 1", KA)
def _(t, s, d):
    return figures.knowledge_areas(t(KA))


@query("a14_advisee_courses", f"SELECT coalesce(nullif(trim(course_name), ''), program) AS course, count(*) AS total FROM {O} GROUP BY 1 HAVING course IS NOT NULL", O)
def _(t, s, d):
    return figures.advisee_courses(t(O))


_CT = ("INICIACAO_CIENTIFICA", "MESTRADO", "DOUTORADO", "POS_DOUTORADO")


@query("a16_concluded_by_year", f"SELECT CAST(y AS INT) AS year, " + ", ".join(_c(_q("orientation_type", x), x.lower()) for x in _CT) + f" FROM range(2010, {YEAR + 1}) c(y) LEFT JOIN {O} ON year = y AND {DONE} GROUP BY 1", O)
def _(t, s, d):
    return figures.concluded_by_year(t(O), YEAR)


_HEAT = "(SELECT year, CASE WHEN item_type IN ('PATENTE', 'MARCA') THEN 'SOFTWARE' ELSE item_type END AS kind FROM " + I + " WHERE year IS NOT NULL)"


@query("a19_heat_map", "SELECT year, " + ", ".join(_c(_q("kind", x), x.lower()) for x in figures.HEAT_TYPES) + f", count(*) AS total FROM {_HEAT} WHERE kind IN (" + ", ".join(f"'{x}'" for x in figures.HEAT_TYPES) + ") GROUP BY ROLLUP (year)", I)
def _(t, s, d):
    return figures.heat_map(t(I))


@query("a20_with_qualis_by_year", f"SELECT CAST(y AS INT) AS year, {_c(f'id IS NOT NULL AND {HASQ}', 'with_qualis')}, {_c(f'id IS NOT NULL AND NOT {HASQ}', 'without_qualis')} FROM range(1985, {YEAR + 1}) c(y) LEFT JOIN {I} ON year = y AND item_type = 'ARTIGO' GROUP BY 1", I)
def _(t, s, d):
    return figures.with_qualis_by_year(t(I), 1985, YEAR)


@query("a21_strata_by_year", "SELECT year, " + ", ".join(_c(_q("qualis", x), x.lower()) for x in figures.STRATA) + f", count(*) AS total FROM {I} WHERE item_type = 'ARTIGO' AND year IS NOT NULL AND qualis IN (" + ", ".join(f"'{x}'" for x in figures.STRATA) + ") GROUP BY ROLLUP (year)", I)
def _(t, s, d):
    return figures.strata_by_year(t(I))


@query("a22_researcher_strata", f""", a AS (SELECT * FROM {I} WHERE item_type = 'ARTIGO' AND qualis IN ('A1', 'A2', 'A3', 'A4')),
 b AS (SELECT researcher_id, string_agg(CAST(database_id AS VARCHAR), ',' ORDER BY database_id) AS databases FROM (SELECT DISTINCT researcher_id, database_id FROM a JOIN {L} ON journal_id = qualis_journal_id) GROUP BY 1)
 SELECT c.*, coalesce(databases, '') AS databases FROM (SELECT researcher_id, """ + ", ".join(_c(_q("qualis", x), x.lower()) for x in figures.STRATA[:4]) + """, count(*) AS total FROM a GROUP BY 1) c LEFT JOIN b USING (researcher_id)""", I, L)
def _(t, s, d):
    return figures.researcher_strata(t(I), t(L))


_PCT = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST(round(CAST(100.0 * {a} / {b} AS DECIMAL(28, 10)), 1) AS DOUBLE) END"


@query("a23_database_figure", f""", h AS (SELECT DISTINCT id, database_id FROM {I} JOIN {L} ON journal_id = qualis_journal_id WHERE item_type = 'ARTIGO'),
 n AS (SELECT (SELECT count(*) FROM {I} WHERE item_type = 'ARTIGO') AS every, (SELECT count(DISTINCT id) FROM h) AS indexed)
 SELECT database_id, articles, {_PCT('articles', 'every')} AS of_all, {_PCT('articles', 'indexed')} AS of_indexed FROM (SELECT database_id, count(*) AS articles FROM h GROUP BY 1), n""", I, L)
def _(t, s, d):
    return figures.database_figure(t(I), t(L))


@query("a28_trajectories", f""", f AS (SELECT researcher_id, level, first(institution_name ORDER BY start_year ASC NULLS FIRST, id) AS i FROM {E} GROUP BY 1, 2),
 p AS (SELECT researcher_id, max(i) FILTER (WHERE level = 'GRADUACAO') AS g, max(i) FILTER (WHERE level = 'MESTRADO') AS m, max(i) FILTER (WHERE level = 'DOUTORADO') AS dd FROM f GROUP BY 1)
 SELECT coalesce(g, 'Graduação Não Inf.') AS graduation, coalesce(m, CASE WHEN dd IS NOT NULL THEN 'Doutorado Direto' ELSE 'Mestrado Não Inf.' END) AS master, coalesce(dd, 'Doutorado Não Inf.') AS doctorate,
 CASE WHEN dd IS NULL THEN 'Outras' WHEN dd IN ('USP', 'UFSCar', 'UNICAMP', 'UNESP') THEN dd WHEN dd IN ('UEL', 'UEM') THEN 'Paulistas' WHEN starts_with(dd, 'Exterior') THEN 'Exterior' WHEN starts_with(dd, 'UF') THEN 'Federais' ELSE 'Outras' END AS category, count(*) AS total FROM p GROUP BY ALL""", E)
def _(t, s, d):
    return figures.trajectories(t(E))


@query("a29_exit_destinations", f""", x AS (SELECT id AS rid, coalesce(leave_year, 2020) AS leave FROM {R} WHERE status = 0 OR leave_year < {YEAR}),
 e AS (SELECT *, CASE WHEN is_current THEN 50 ELSE 0 END + CASE WHEN start_year >= leave THEN 30 ELSE 0 END + CASE WHEN coalesce(end_year, 0) >= leave THEN 20 ELSE 0 END
 + CASE WHEN contains(lower(coalesce(contract_type, '')), 'servidor') OR contains(lower(coalesce(contract_type, '')), 'professor') THEN 15 ELSE 0 END AS score
 FROM {X} JOIN x ON rid = researcher_id WHERE institution_name <> 'Universidade Sede' AND NOT starts_with(institution_name, 'Revista')),
 b AS (SELECT *, row_number() OVER (PARTITION BY researcher_id ORDER BY score DESC, is_current DESC, end_year DESC NULLS LAST, start_year DESC, id) AS place FROM e WHERE score > 0)
 SELECT institution_name AS destination, count(*) AS researchers, CAST(sum(score) AS BIGINT) AS points FROM b WHERE place = 1 GROUP BY 1""", R, X)
def _(t, s, d):
    return figures.exit_destinations(t(R), t(X), YEAR, "Universidade Sede")


# --- research ---------------------------------------------------------------------------------------------------------
@query("a30_panorama_totals", f"SELECT count(DISTINCT {K1}) AS works, count(DISTINCT researcher_id) AS researchers, max(year) AS last_year FROM {I}", I)
def _(t, s, d):
    return research.panorama_totals(t(I))


@query("a31_works_per_year", f""", n AS (SELECT year, count(DISTINCT {K1}) AS works FROM {I} WHERE year BETWEEN 1950 AND {YEAR} GROUP BY 1)
 SELECT CAST(y AS INT) AS year, coalesce(works, 0) AS works FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM n) LEFT JOIN n ON year = y""", I)
def works_per_year(t, s, d):
    return research.works_per_year(t(I), YEAR)


@query("a31_works_per_year_of_one", f""", n AS (SELECT year, count(DISTINCT {K1}) AS works FROM {I} WHERE researcher_id = 7 AND item_type = 'SOFTWARE' AND year BETWEEN 1950 AND {YEAR} GROUP BY 1)
 SELECT CAST(y AS INT) AS year, coalesce(works, 0) AS works FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM n) LEFT JOIN n ON year = y""", I)
def _(t, s, d):
    return research.works_per_year(t(I).where("researcher_id = 7 AND item_type = 'SOFTWARE'"), YEAR)


@query("a32_works_by_type", f"SELECT item_type, count(DISTINCT {K1}) AS works FROM {I} GROUP BY 1", I)
def _(t, s, d):
    return research.works_by_type(t(I))


_MA = "CASE " + " ".join(f"WHEN {f_('major_area')} IN ('{fold_text(c)}', '{fold_text(v)}', '{fold_text(c).replace('_', ' ')}') THEN '{c}'" for c, v in MAJOR_AREAS.items()) + " END"


@query("a34_major_area_catalogue", f"""SELECT code, count(DISTINCT a.researcher_id) AS researchers, count(DISTINCT k) AS works FROM (SELECT DISTINCT researcher_id, {_MA} AS code FROM {KA}) a
 LEFT JOIN (SELECT researcher_id, {K1} AS k FROM {I}) w ON w.researcher_id = a.researcher_id WHERE code IS NOT NULL GROUP BY 1""", KA, I)
def _(t, s, d):
    return research.major_area_catalogue(t(KA), t(I))


@query("a35_area_catalogue", f"""SELECT area, min(major_area) AS major_area, count(DISTINCT a.researcher_id) AS researchers, count(DISTINCT k) AS works FROM (SELECT DISTINCT researcher_id, area, major_area FROM {KA} WHERE area <> '') a
 LEFT JOIN (SELECT DISTINCT researcher_id, {K1} AS k FROM {I}) w ON w.researcher_id = a.researcher_id GROUP BY 1""", KA, I)
def _(t, s, d):
    return research.area_catalogue(t(KA), t(I))


@query("a40_primary_major_area", f"""SELECT researcher_id, major_area FROM (SELECT researcher_id, major_area, row_number() OVER (PARTITION BY researcher_id ORDER BY count(*) DESC, major_area) AS p FROM {KA} WHERE major_area <> '' GROUP BY 1, 2) WHERE p = 1""", KA)
def _(t, s, d):
    return research.primary_major_area(t(KA))


_ONE = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST(round(CAST({a} * 1.0 / {b} AS DECIMAL(28, 10)), 1) AS DOUBLE) END"


@query("a41_profile_kpis", f"""SELECT researcher_id, count(*) AS total, {_c("item_type = 'ARTIGO'", 'articles')}, {_c("item_type IN ('LIVRO', 'CAPITULO')", 'books')}, {_c(_HASDOI, 'with_doi')}, min(year) AS first_year, max(year) AS last_year,
 count(DISTINCT year) AS active_years, {_ONE(f'100 * count(*) FILTER (WHERE {_HASDOI})', 'count(*)')} AS doi_percent, {_ONE('count(year)', 'count(DISTINCT year)')} AS per_active_year FROM {I} GROUP BY 1""", I)
def _(t, s, d):
    return research.profile_kpis(t(I))


_ALL = ("MESTRADO", "DOUTORADO", "POS_DOUTORADO", "INICIACAO_CIENTIFICA", "TCC_GRADUACAO", "ESPECIALIZACAO", "OUTRA")


@query("a42_orientation_counters", "SELECT researcher_id, " + ", ".join(_c(f"orientation_type = '{x}' AND {n}{DONE}", f"{x.lower()}_{e}") for x in _ALL for n, e in (("", "done"), ("NOT ", "open"))) + f" FROM {O} GROUP BY 1", O)
def _(t, s, d):
    return research.orientation_counters(t(O))


_GR = {"articles": "item_type = 'ARTIGO'", "books": "item_type IN ('LIVRO', 'CAPITULO')", "newspapers": "item_type = 'TEXTO_JORNAL'", "events": "item_type = 'EVENTO'", "technical": "item_type IN ('TRABALHO_TECNICO', 'OUTRA_TECNICA', 'SOFTWARE', 'PATENTE', 'MARCA')", "others": "item_type IN ('PRODUCAO_ARTISTICA', 'OUTRA')"}
_GO = {**{k: f"orientation_type = '{v}'" for k, v in research.LEVELS.items()}, "other_levels": "orientation_type = 'OUTRA'"}


@query("a43_profile_timeline", f""", p AS (SELECT year, {', '.join(_c(v, k) for k, v in _GR.items())} FROM {I} WHERE researcher_id = 3 AND year IS NOT NULL GROUP BY 1), o AS (SELECT year, {', '.join(_c(v, k) for k, v in _GO.items())} FROM {O} WHERE researcher_id = 3 AND year IS NOT NULL AND {DONE} GROUP BY 1),
 e AS (SELECT min(year) AS a, max(year) AS b FROM (SELECT year FROM {I} WHERE researcher_id = 3 UNION ALL SELECT year FROM {O} WHERE researcher_id = 3))
 SELECT CAST(y AS INT) AS year, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*_GR, *_GO])} FROM (SELECT unnest(range(greatest(1980, coalesce(a, {YEAR})), greatest({YEAR}, coalesce(b, {YEAR})) + 1)) AS y FROM e) LEFT JOIN p ON p.year = y LEFT JOIN o ON o.year = y""", I, O)
def _(t, s, d):
    return research.profile_timeline(t(I), t(O), 3, YEAR)


@query("a45_collaborators", f""", w AS (SELECT l.id, l.item_type, l.year, l.title FROM (SELECT id, any_value(item_type) AS item_type, any_value(year) AS year, any_value(title) AS title FROM {I} GROUP BY 1) l WHERE l.id IN (SELECT production_item_id FROM {A} WHERE matched_researcher_id = 5)),
 a AS (SELECT DISTINCT production_item_id AS work, coalesce('r' || CAST(matched_researcher_id AS VARCHAR), 'i' || CAST(author_identity_id AS VARCHAR), 'n' || upper({N1('author_name')})) AS person FROM {A} WHERE matched_researcher_id IS NULL OR matched_researcher_id <> 5),
 j AS (SELECT * FROM a JOIN w ON w.id = work), tp AS (SELECT person, string_agg(item_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, item_type) AS types FROM (SELECT person, item_type, count(*) AS n FROM j GROUP BY 1, 2) GROUP BY 1),
 sm AS (SELECT person, string_agg(title, ' | ' ORDER BY work) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY work) AS p FROM j) WHERE p <= 2 GROUP BY 1)
 SELECT j.person, count(*) AS works, min(year) AS first_year, max(year) AS last_year, any_value(types) AS types, any_value(samples) AS samples FROM j JOIN tp ON tp.person = j.person JOIN sm ON sm.person = j.person GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""", A, I)
def _(t, s, d):
    a = t(A).withColumnRenamed("production_item_id", "work")
    mine = a.where("matched_researcher_id = 5").select(F.col("work").alias("id")).distinct()
    works = t(I).groupBy("id").agg(*(F.first(c).alias(c) for c in ("item_type", "year", "title"))).join(mine, "id", "left_semi")
    return research.collaborators(a.where("NOT matched_researcher_id <=> 5"), works)


# --- search -----------------------------------------------------------------------------------------------------------
_has = lambda c, w: f"coalesce(contains({f_(c)}, '{w}'), false)"
_i = lambda b: f"CAST({b} AS INT)"
_SEARCH = ResearchFilter.of(YEAR, q="Educação Básica", first_year=1995, last_year=2015)
_T = ("educacao", "basica")
_PRED = " AND ".join(f"({_has('title', w)} OR {_has('keywords_text', w)})" for w in _T)
_SCORE = " + ".join(f"{_i(_has('title', w))} * 3 + {_i(_has('keywords_text', w))}" for w in _T) + f" + {_i(_has('title', 'educacao basica'))} * 5"


@query("t1_experts", f""", h AS (SELECT researcher_id, id, {K1} AS work, {_SCORE} AS score, coalesce(year, 0) AS year FROM {I} WHERE year BETWEEN 1995 AND 2015 AND {_PRED}),
 p AS (SELECT *, row_number() OVER (PARTITION BY researcher_id ORDER BY score DESC, year DESC, id DESC) AS place FROM h)
 SELECT researcher_id, max(score) AS score, count(DISTINCT work) AS works, nullif(max(year), 0) AS last_year, string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place <= 2) AS best_works, full_name FROM p JOIN {R} r ON r.id = researcher_id GROUP BY researcher_id, full_name""", I, R)
def experts(t, s, d):
    return research.experts(prepared_items(s, d), t(R), _SEARCH)


_V = " OR ".join(_has(c, "educacao basica") for c in ("journal_name", "event_name", "doi"))
_PUBS = f""", g AS (SELECT {K1} AS work, max({_SCORE} + {_i(f'({_V})')}) AS score, max(year) AS year, min(id) AS item, min(lower(trim(title))) AS title, count(DISTINCT researcher_id) AS owners FROM {I} WHERE year BETWEEN 1995 AND 2015 AND (({_PRED}) OR {_V}) GROUP BY 1)"""


@query("t2_publications", f"{_PUBS} SELECT * FROM g", I)
def publications(t, s, d):
    return research.publications(prepared_items(s, d), _SEARCH)


for _order, _by in {"relevancia": "score DESC, year DESC NULLS LAST, item DESC", "recentes": "year DESC NULLS LAST, score DESC, item DESC", "antigas": "year ASC NULLS LAST, score DESC, item", "titulo": "title, item"}.items():
    query(f"t2_page_{_order}", f"{_PUBS} SELECT * FROM g ORDER BY {_by} LIMIT 15 OFFSET 15", I)(lambda t, s, d, _order=_order: research.page(research.publications(prepared_items(s, d), _SEARCH, order=_order), 2, 15))
for _order, _by in {"relevancia": "score DESC, works DESC", "recentes": "last_year DESC NULLS LAST, score DESC, works DESC", "publicacoes": "works DESC, score DESC", "nome": "1"}.items():
    _by = "" if _by == "1" else f"{_by}, "
    query(f"t1_page_{_order}", f"""SELECT researcher_id, max({_SCORE}) AS score, count(DISTINCT {K1}) AS works, max(year) AS last_year, full_name FROM {I} JOIN {R} r ON r.id = researcher_id WHERE year BETWEEN 1995 AND 2015 AND {_PRED} GROUP BY researcher_id, full_name
 ORDER BY {_by}{f_('full_name')}, researcher_id LIMIT 4 OFFSET 4""", I, R)(lambda t, s, d, _order=_order: research.page(research.experts(prepared_items(s, d), t(R), _SEARCH, order=_order), 2, 4).drop("best_works"))


@query("f5_venue_family", f"""SELECT {K1} AS work, min(id) AS item FROM {I} WHERE contains({f_("coalesce(journal_name, '')")}, 'revista 7') OR contains({f_("coalesce(event_name, '')")}, 'revista 7') OR contains({f_("coalesce(doi, '')")}, 'revista 7')
 OR contains({f_("coalesce(title, '')")}, 'revista 7') OR contains({f_("coalesce(keywords_text, '')")}, 'revista 7') OR (item_type = 'ARTIGO' AND qualis_journal_id IN (SELECT id FROM {J} WHERE id < 20)) GROUP BY 1""", I, J)
def _(t, s, d):
    return research.publications(prepared_items(s, d), ResearchFilter.of(YEAR, q="revista 7", exact=True), family_rows=t(J).where("id < 20")).select("work", "item")


@query("t3_name_search", f"SELECT r.id, full_name, status, productions FROM {R} r LEFT JOIN (SELECT researcher_id, count(*) AS productions FROM {I} GROUP BY 1) p ON researcher_id = r.id WHERE contains({f_('full_name')}, '1')", R, I)
def _(t, s, d):
    return research.name_search(t(R), t(I).groupBy(F.col("researcher_id").alias("id")).agg(F.count(F.lit(1)).alias("productions")), "1")


@query("t4_page", f"SELECT id, title FROM {J} ORDER BY id LIMIT 50 OFFSET 50", J)
def _(t, s, d):
    return research.page(t(J).select("id", "title").orderBy("id"), 2, 50)


@query("t4_page_clamped", f"SELECT id, title FROM (SELECT id, title, row_number() OVER (ORDER BY id) AS p FROM {J}) WHERE p > ((SELECT count(*) FROM {J}) - 1) // 50 * 50", J)
def _(t, s, d):
    return research.page(t(J).select("id", "title").orderBy("id"), 10**6, 50)


@query("f1_filter", f"""SELECT id FROM {I} WHERE item_type = 'ARTIGO' AND year >= 2000 AND ({_has('title', 'genero')} OR {_has('keywords_text', 'genero')})
 AND researcher_id IN (SELECT id FROM {R} WHERE status = 1 AND (department_code IN ('CS', 'DCSo') OR department IN ('CS', 'DCSo'))) AND researcher_id IN (SELECT researcher_id FROM {KA} WHERE major_area IN ('ENGENHARIAS', 'Engenharias'))""", I, R, KA)
def _(t, s, d):
    f = ResearchFilter.of(YEAR, q="o gênero", item_type="artigo", first_year=2000, affiliation="vigente", department="CS", major_area="ENGENHARIAS", aliases={"CS": ["DCSo"]})
    return apply_filter(prepared_items(s, d), f, t(R), t(KA)).select("id")


@query("f11_orientation_filter", f"SELECT id FROM {O} WHERE year BETWEEN 1990 AND 2020 AND contains({f_('''concat_ws(' ', title, student_name, keywords)''')}, 'genero')", O)
def _(t, s, d):
    return t(O).where(F.col("year").between(1990, 2020) & F.contains(text.fold(F.concat_ws(" ", "title", "student_name", "keywords")), F.lit("genero"))).select("id")


# --- graph ------------------------------------------------------------------------------------------------------------
_AU = f"a AS (SELECT DISTINCT production_item_id AS work, matched_researcher_id AS r FROM {A} WHERE matched_researcher_id IS NOT NULL), e AS (SELECT x.r AS a, y.r AS b, count(*) AS weight FROM a x JOIN a y ON x.work = y.work AND x.r < y.r GROUP BY 1, 2)"


def _authors(t):
    return t(A).withColumnRenamed("production_item_id", "work")


@query("j1_edges", f", {_AU} SELECT * FROM e", A)
def coauthor_edges(t, s, d):
    return graph.edges(_authors(t))


@query("t9_strongest_edges", f", {_AU} SELECT * FROM e ORDER BY weight DESC, a, b LIMIT 120", A)
def _(t, s, d):
    return graph.strongest(graph.edges(_authors(t)))


@query("a37_shared_works", f", {_AU} SELECT count(*) AS shared_works FROM (SELECT work FROM a GROUP BY 1 HAVING count(*) > 1)", A)
def _(t, s, d):
    return graph.shared_works(_authors(t))


@query("a38_network_stats", f", {_AU} SELECT x.r AS researcher, count(DISTINCT y.r) AS coauthors, count(DISTINCT x.work) AS shared_works FROM a x JOIN a y ON x.work = y.work AND x.r <> y.r GROUP BY 1", A)
def _(t, s, d):
    return graph.network_stats(_authors(t))


@query("t9_nodes", f", {_AU} SELECT id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM (SELECT a AS id, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY 1", A)
def _(t, s, d):
    return graph.nodes(graph.edges(_authors(t)))


@query("t9_ego", f", {_AU}, h AS (SELECT * FROM e ORDER BY weight DESC, a, b LIMIT 200), n AS (SELECT a AS id FROM h WHERE b = (SELECT min(a) FROM h) UNION SELECT b FROM h WHERE a = 8 UNION SELECT a FROM h WHERE b = 8 UNION SELECT 8) SELECT a, b, weight FROM h WHERE a IN (SELECT b FROM h WHERE a = 8 UNION SELECT a FROM h WHERE b = 8 UNION SELECT 8) AND b IN (SELECT b FROM h WHERE a = 8 UNION SELECT a FROM h WHERE b = 8 UNION SELECT 8)", A)
def _(t, s, d):
    return graph.ego(graph.strongest(graph.edges(_authors(t)), 200), 8)


@query("j2_neighbours", f", {_AU} SELECT r AS researcher, count(*) AS works FROM a WHERE work IN (SELECT work FROM a WHERE r = 7) AND r <> 7 GROUP BY 1", A)
def _(t, s, d):
    return graph.neighbours(_authors(t), 7)


@query("a25_matrix_nodes", f", {_AU} SELECT id, full_name, row_number() OVER (ORDER BY {f_('full_name')}, id) AS place FROM {R} WHERE id IN (SELECT a FROM e UNION SELECT b FROM e)", A, R)
def _(t, s, d):
    return graph.matrix_nodes(graph.edges(_authors(t)), t(R))


@query("t10_pair_page", f", {_AU}, p AS (SELECT work, max(year) AS year FROM a JOIN {I} i ON i.id = work WHERE r = 2 AND work IN (SELECT work FROM a WHERE r = 9) GROUP BY 1) SELECT work, year, (SELECT count(*) FROM p) AS total FROM p ORDER BY year DESC NULLS LAST, work LIMIT 2", A, I)
def _(t, s, d):
    years = t(I).groupBy(F.col("id").alias("work")).agg(F.max("year").alias("year"))
    return graph.pair_page(graph.pair_works(_authors(t), 2, 9).join(years, "work"), 2)


@query("a25_matrix", f", {_AU} SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e", A)
def _(t, s, d):
    return graph.matrix(graph.edges(_authors(t)))


@query("a39_bridges", f""", {_AU}, g AS (SELECT id, {_DEPT} AS grp FROM {R}), x AS (SELECT ga.grp AS ga, gb.grp AS gb FROM e JOIN g ga ON ga.id = a JOIN g gb ON gb.id = b WHERE ga.grp IS NOT NULL AND gb.grp IS NOT NULL)
 SELECT ga, gb, count(*) AS pairs FROM (SELECT ga, gb FROM x UNION ALL SELECT gb, ga FROM x WHERE ga <> gb) GROUP BY 1, 2""", A, R)
def _(t, s, d):
    dept = summaries._alias(F.coalesce(F.nullif(F.col("department_code"), F.lit("")), F.nullif(F.col("department"), F.lit(""))))
    return graph.bridges(graph.edges(_authors(t)), t(R).select("id", dept.alias("grp")))


@query("j6_pair_works", f", {_AU} SELECT work FROM a WHERE r = 2 AND work IN (SELECT work FROM a WHERE r = 9)", A)
def _(t, s, d):
    return graph.pair_works(_authors(t), 2, 9)


@query("a24_pairs", f""", w AS (SELECT DISTINCT {K5} AS k, researcher_id AS r FROM {I}), e AS (SELECT x.r AS a, y.r AS b, count(*) AS weight FROM w x JOIN w y ON x.k = y.k AND x.r < y.r GROUP BY 1, 2)
 SELECT e.*, p.full_name AS name_a, q.full_name AS name_b FROM e JOIN {R} p ON p.id = a JOIN {R} q ON q.id = b ORDER BY weight DESC, a, b LIMIT 100""", I, R)
def _(t, s, d):
    works = t(I).select(keys.coauthor_key().alias("work"), F.col("researcher_id").alias("matched_researcher_id"))
    e = graph.strongest_pairs(works, t(R).select(F.col("id").alias("researcher")), 100)
    name = lambda c: t(R).select(F.col("id").alias(c), F.col("full_name").alias(f"name_{c}"))
    return e.join(name("a"), "a").join(name("b"), "b")


# --- journals ---------------------------------------------------------------------------------------------------------
_FAM = "fam AS (SELECT id, coalesce(canonical_journal_id, id) AS fid FROM journals)"


@query("a46_journals_by_database", f""", {_FAM} SELECT fid, count(DISTINCT k) AS articles, count(DISTINCT researcher_id) AS researchers, min(year) AS first_year, max(year) AS last_year
 FROM (SELECT *, {K3} AS k FROM {I} WHERE item_type = 'ARTIGO') i JOIN fam ON fam.id = qualis_journal_id WHERE fid IN (SELECT fid FROM fam JOIN {L} ON journal_id = id WHERE database_id = 2) GROUP BY 1""", I, J, L)
def journals_by_database(t, s, d):
    return journals.by_database(t(I), t(J), t(L), 2)


@query("b7_family_links", f", {_FAM} SELECT DISTINCT f.id AS journal_id, database_id FROM fam f JOIN fam g ON g.fid = f.fid JOIN {L} ON {L}.journal_id = g.id", J, L)
def _(t, s, d):
    return journals.family_links(t(J), t(L))


_TOT = f"""{_FAM}, fl AS (SELECT DISTINCT f.id AS jid, f.fid, database_id FROM fam f JOIN fam g ON g.fid = f.fid JOIN {L} ON {L}.journal_id = g.id),
 tot AS (SELECT database_id, count(DISTINCT fid) AS families, count(DISTINCT {K3}) AS articles, count(DISTINCT researcher_id) AS researchers FROM {I} JOIN fl ON jid = qualis_journal_id WHERE item_type = 'ARTIGO' GROUP BY 1)"""


@query("a47_database_totals", f", {_TOT} SELECT * FROM tot", I, J, L)
def _(t, s, d):
    return journals.database_totals(t(I), t(J), t(L))


@query("a50_bars", f", {_TOT} SELECT database_id, articles, greatest(1.0, CAST(round(CAST(100.0 * articles / (SELECT max(articles) FROM tot) AS DECIMAL(28, 10)), 1) AS DOUBLE)) AS bar FROM tot", I, J, L)
def _(t, s, d):
    return journals.bars(journals.database_totals(t(I), t(J), t(L)))


@query("a48_family_stratum", f""", {_FAM} SELECT fid, qualis, n AS articles FROM (SELECT fid, qualis, count(DISTINCT {K3}) AS n, row_number() OVER (PARTITION BY fid ORDER BY count(DISTINCT {K3}) DESC, qualis) AS p FROM {I} JOIN fam ON fam.id = qualis_journal_id
 WHERE item_type = 'ARTIGO' AND {HASQ} GROUP BY 1, 2) WHERE p = 1""", I, J)
def _(t, s, d):
    return journals.family_stratum(t(I), t(J))


@query("a49_family_bases", f", {_FAM} SELECT fid, string_agg(CAST(database_id AS VARCHAR), ',' ORDER BY database_id) AS databases FROM (SELECT DISTINCT fid, database_id FROM fam JOIN {L} ON journal_id = id) GROUP BY 1", J, L)
def _(t, s, d):
    return journals.family_bases(t(J), t(L))


@query("a54_most_articles", f""", a AS (SELECT coalesce('f' || CAST(qualis_journal_id AS VARCHAR), 'n' || {f_("coalesce(journal_name, '')")}) AS journal, coalesce(journal_name, '') AS spelling, nullif(qualis, '') AS q, {K3} AS k FROM {I} WHERE item_type = 'ARTIGO'),
 sp AS (SELECT journal, spelling FROM (SELECT journal, spelling, row_number() OVER (PARTITION BY journal ORDER BY count(*) DESC, spelling) AS p FROM a GROUP BY 1, 2) WHERE p = 1)
 SELECT journal, count(DISTINCT k) AS articles, min(q) AS qualis, any_value(sp.spelling) AS spelling FROM a JOIN sp USING (journal) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", I)
def _(t, s, d):
    return journals.most_articles(t(I))


@query("a57_report", f""", {_FAM} SELECT (SELECT count(*) FROM {J}) AS rows, (SELECT count(DISTINCT fid) FROM fam) AS families, (SELECT count(*) FROM {J} WHERE issn IS NULL) AS without_issn,
 (SELECT count(*) FROM (SELECT issn FROM {J} WHERE issn IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_issns, (SELECT count(qualis_journal_id) FROM {I}) AS linked_items""", I, J)
def _(t, s, d):
    return journals.report(t(J), t(I))


@query("b5_canonical_rows", f""", {_FAM}, n AS (SELECT qualis_journal_id AS id, count(*) AS n FROM {I} WHERE item_type = 'ARTIGO' GROUP BY 1)
 SELECT fid, first(f.id ORDER BY coalesce(n, 0) DESC, CASE WHEN issn IS NULL THEN 0 ELSE 1 END DESC, f.id) AS canonical, count(*) AS rows FROM fam f JOIN {J} j ON j.id = f.id LEFT JOIN n ON n.id = f.id GROUP BY 1""", I, J)
def _(t, s, d):
    return journals.canonical_rows(t(I), t(J))


@query("r2_shown_stratum", f""", {_FAM}, h AS (SELECT fid, first(qualis ORDER BY CAST(j.id <> fid AS INT), j.id) AS q FROM fam JOIN {J} j ON j.id = fam.id WHERE qualis <> '' GROUP BY 1)
 SELECT j.id, coalesce(nullif(qualis, ''), q) AS qualis FROM {J} j JOIN fam ON fam.id = j.id LEFT JOIN h ON h.fid = fam.fid""", J)
def _(t, s, d):
    return journals.shown_stratum(t(J))


_KEY = lambda x: f"trim(regexp_replace({N1(x)}, '[^a-z0-9]+', ' ', 'g'))"
_ALL_NAMES = "names AS (SELECT DISTINCT upper(title) AS name, CASE WHEN id % 2 = 0 THEN issn END AS issn FROM journals)"


@query("r1_resolve_journals", f""", {_FAM}, {_ALL_NAMES},
 k AS (SELECT 1 AS stage, issn AS key, min(j.id) AS id, false AS amb FROM {J} j JOIN fam ON fam.id = j.id WHERE issn IS NOT NULL GROUP BY 2
  UNION ALL SELECT 2, {_KEY('title')}, min(j.id), min(fid) <> max(fid) FROM {J} j JOIN fam ON fam.id = j.id GROUP BY 2)
 SELECT name, n.issn, CASE WHEN a.id IS NOT NULL THEN 'matched' WHEN b.id IS NULL THEN 'none' WHEN b.amb THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 END AS step,
 CASE WHEN a.id IS NOT NULL THEN a.id WHEN NOT b.amb THEN b.id END AS journal_id FROM names n LEFT JOIN k a ON a.stage = 1 AND a.key = n.issn LEFT JOIN k b ON b.stage = 2 AND b.key = {_KEY('name')}""", J)
def _(t, s, d):
    names = t(J).select(F.upper("title").alias("name"), F.when(F.col("id") % 2 == 0, F.col("issn")).alias("issn"))
    return journals.resolve(names, t(J))


_QUEUE = f"""a AS (SELECT {f_('journal_name')} AS name_key, journal_name, researcher_id, title, coalesce(year, -1) AS year, id FROM {I} WHERE item_type = 'ARTIGO' AND qualis_journal_id IS NULL AND journal_name IS NOT NULL),
 tt AS (SELECT name_key, string_agg(title, ' | ' ORDER BY p) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY year DESC, id DESC, title) AS p FROM (SELECT name_key, title, max(struct_pack(y := year, i := id)).y AS year, max(struct_pack(y := year, i := id)).i AS id FROM a GROUP BY 1, 2)) WHERE p <= 3 GROUP BY 1),
 q AS (SELECT name_key, first(journal_name ORDER BY n DESC, journal_name) AS spelling, CAST(sum(n) AS BIGINT) AS articles FROM (SELECT name_key, journal_name, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY 1)"""


@query("b18_name_queue", f", {_QUEUE} SELECT name_key, spelling, articles, (SELECT count(DISTINCT researcher_id) FROM a WHERE a.name_key = q.name_key) AS researchers, titles FROM q JOIN tt USING (name_key)", I)
def _(t, s, d):
    return journals.name_queue(t(I)).drop("issn").withColumn("titles", F.array_join("titles", " | "))


@query("t8_journal_search", f""", {_FAM} SELECT fid, min(CASE WHEN {f_('title')} = 'revista large' THEN 0 WHEN starts_with({f_('title')}, 'revista large') THEN 1 ELSE 2 END) AS score, count(*) AS rows FROM fam JOIN {J} j ON j.id = fam.id WHERE contains({f_('title')}, 'revista large') GROUP BY 1 ORDER BY 2, 1 LIMIT 20""", J)
def _(t, s, d):
    return journals.name_search(t(J), "Revista Large")


# --- topics -----------------------------------------------------------------------------------------------------------
#: The words of three letters or more that the original's index takes for no terms (shorter tokens never are any).
INDEX_STOPS = (
    "about above abstract after aluno alunos amparo anais analise analysis and análise aos apreciação apresentação aquela aquelas aquele aqueles aquilo artigo aspectos até avaliador base before below "
    "between brasil brasileira brasileiro brazil caderno campus capes capitulo capítulo carlos chave clínicas cnpq com comissão comitê como concedida conclusão congresso considerações consultor "
    "consultoria contexto coordenador coordenadora das data dela delas dele deles departamento depois docente docentes dos during edição ela elas ele eles encaminhado encontro entre era eram escola essa "
    "essas esse esses esta estado estamos estas estava estavam este esteja estejam estejamos estes esteve estive estivemos estiver estivera estiveram estiverem estivermos estivesse estivessem estivéramos "
    "estivéssemos estou estudo estudos está estávamos estão faculdade fapesp foi fomos for fora foram forem formos fosse fossem from fui fundação fôramos fôssemos guia haja hajam hajamos havemos havia hei "
    "hoc hospital houve houvemos houver houvera houveram houverei houverem houveremos houveria houveriam houvermos houverá houverão houveríamos houvesse houvessem houvéramos houvéssemos hão instituto "
    "internacional into introdução isso isto jornada journal keywords lhe lhes livro mais mas membro mesmo meu meus minha minhas muito nacional nas nem nos nossa nossas nosso nossos num numa não nós "
    "palavras paper para parecer parecerista parte partir paulo pela pelas pelo pelos periódico perspectiva perspectivas pesquisa por preto processo processos progresso projeto proposta qual quando que "
    "quem relatorio relatório resumo reunião review revista ribeirão seja sejam sejamos sem seminário ser serei seremos seria seriam será serão seríamos seu seus simpósio sobre social sociedade somos sou "
    "study sua suas submetida submetido submetidos são também tem temos tenha tenham tenhamos tenho ter terei teremos teria teriam terá terão teríamos teu teus teve the through tinha tinham tive tivemos "
    "tiver tivera tiveram tiverem tivermos tivesse tivessem tivéramos tivéssemos trabalho trabalhos tua tuas tém têm tínhamos ufscar uma unesp unicamp universidade using uso usp você vocês volume vos with "
    "year éramos ética"
).split()
#: A shorter list, which the queries but x4_five_branches and x5_links give; an installation has one of its own (`lists.words`).
TOPIC_STOPS = (
    "que para com não uma por mais dos como mas foi das tem seu sua ser quando muito nos está também pelo pela até isso entre era sem aos ter seus nas num suas numa pelos foram pelas este esta estes estas esse essa esses essas são "
    "sobre estudo estudos pesquisa análise analise contexto processo processos perspectiva perspectivas proposta aspectos artigo relatório projeto trabalho trabalhos volume anais revista caderno livro capítulo resumo edição parte partir base uso "
    "introdução conclusão apresentação considerações universidade faculdade instituto departamento escola nacional internacional brasil brazil congresso encontro seminário simpósio palavras chave "
    "the and for with from about study analysis using between into through during before after above below year data journal paper review abstract keywords"
).split()
_STOP, _INDEX_STOP = (", ".join(f"'{w}'" for w in x) for x in (TOPIC_STOPS, INDEX_STOPS))
_CONN = ", ".join(f"'{w}'" for w in topics.CONNECTORS)
_ok = lambda w, stop: f"(length({w}) >= 3 AND {w} NOT IN ({stop}) AND NOT regexp_full_match({w}, '[0-9]+(e[0-9]+)?|[ivxlcdm]+'))"


def _mined(titles: str, stop: str = _STOP) -> str:
    """CTEs that end in m (id, term, n, place)."""
    return f"""tk AS (SELECT id, regexp_extract_all(lower(title), '[a-záàâãéèêíïóôõöúçñ0-9]+') AS t FROM ({titles})),
 v AS (SELECT id, i, t[i] AS w1, t[i + 1] AS w2, t[i + 2] AS w3 FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM tk) WHERE {_ok('t[i]', stop)}),
 c AS (SELECT id, w1 || ' ' || w2 AS term, 2 * (i - 1) AS p FROM v WHERE coalesce({_ok('w2', stop)}, false) UNION ALL SELECT id, w1 || ' ' || w2 || ' ' || w3, 2 * (i - 1) + 1 FROM v WHERE w2 IN ({_CONN}) AND coalesce({_ok('w3', stop)}, false)),
 cc AS (SELECT id, term, count(*) AS n, min(p) AS place FROM c GROUP BY 1, 2), sg AS (SELECT id, w1 AS term, count(*) AS n, min(i - 1) + 1000000 AS place FROM v GROUP BY 1, 2),
 ab AS (SELECT id, word, sum(n) AS n FROM (SELECT id, unnest(string_split(term, ' ')) AS word, n FROM cc) GROUP BY 1, 2),
 m AS (SELECT id, term, n, place FROM cc UNION ALL SELECT sg.id, sg.term, CAST(sg.n - coalesce(ab.n, 0) AS BIGINT), place FROM sg LEFT JOIN ab ON ab.id = sg.id AND ab.word = sg.term WHERE sg.n - coalesce(ab.n, 0) > 0 AND length(sg.term) >= 4)"""


_TEXTS = "SELECT doc_id AS id, text AS title FROM documents"
_CANON = lambda x: f"list_reduce(list_transform(string_split(lower(trim({x})), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ({_CONN}) THEN w ELSE upper(left(w, 1)) || substr(w, 2) END), lambda p, q: p || ' ' || q)"


def _indexed(mentions: str, stop: str = _STOP) -> str:
    """CTEs from a CTE of mentions (researcher_id, term, n, source, sample, seen) to lk (links) and ix (terms)."""
    return f"""k AS (SELECT *, {TOPIC('term')} AS key FROM {mentions} WHERE term IS NOT NULL),
 lk AS (SELECT key, researcher_id, CAST(sum(n) AS BIGINT) AS occurrences, min(struct_pack(s := seen, t := term, o := source)) AS f, max(CAST(source = 'keyword' AS INT)) AS kw, coalesce(struct_extract(min(struct_pack(s := seen, t := sample)) FILTER (WHERE sample <> ''), 't'), '') AS sample
  FROM k WHERE length(key) >= 3 AND key NOT IN ({stop}) AND NOT regexp_full_match(key, '[0-9]+') GROUP BY 1, 2),
 ix AS (SELECT key, {_CANON('min(f).t')} AS term, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) AS researchers, CASE WHEN min(f).o = 'mined' AND max(kw) = 1 THEN 'hybrid' ELSE min(f).o END AS source, min(f).s AS seen FROM lk GROUP BY 1 HAVING sum(occurrences) >= 2)"""


def _texts(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))


@query("x1_mined_terms", f"WITH {_mined(_TEXTS)} SELECT * FROM m")
def mined_terms(t, s, d):
    return topics.mined(_texts(s, d), TOPIC_STOPS)


def _spelled_texts(s, d):
    m = topics.mined(_texts(s, d), TOPIC_STOPS)
    return topics.spellings(m.select((F.col("id") % 50).alias("researcher_id"), "term", "n", topics.seen(0, F.col("id"), 1, F.col("place")).alias("seen"), F.lit(False).alias("titled")))


@query("x5_topic_index", f"WITH {_mined(_TEXTS)}, me AS (SELECT id % 50 AS researcher_id, term, n, 'mined' AS source, '' AS sample, id * 10000000 + place AS seen FROM m), {_indexed('me')} SELECT key, term, occurrences, researchers, source FROM ix")
def topic_index(t, s, d):
    return topics.index(_spelled_texts(s, d), TOPIC_STOPS).drop("seen")


# Five branches; a title's id tells its table, row and phase.
_BRANCHES = "SELECT tid AS id, sample AS title FROM own"
_MARKS = "' ' || chr(9) || chr(10) || chr(13) || '.,;:-/()[]{}' || chr(34) || chr(39)"
_CLEAN = lambda x: f"CASE WHEN length(trim(trim({x}), {_MARKS})) >= 3 THEN trim(trim({x}), {_MARKS}) END"


def _mentions(stop: str) -> str:
    """CTEs from the domain tables to those of `_indexed`."""
    return f""", own AS MATERIALIZED (SELECT row_number() OVER () AS tid, * FROM (SELECT id AS row, researcher_id, title AS sample, 1 AS weight, 0 AS stage, 1 AS phase FROM {I} WHERE title <> '' UNION ALL SELECT id, researcher_id, title, 2, 1, 1 FROM {O} WHERE title <> ''
  UNION ALL SELECT id, researcher_id, alternative_title, 1, 1, 2 FROM {O} WHERE alternative_title <> '' AND alternative_title <> coalesce(title, '') UNION ALL SELECT id, researcher_id, name, 2, 2, 1 FROM {P} WHERE name <> '')), {_mined(_BRANCHES, stop)},
 js AS (SELECT researcher_id, id, title, list_filter(CASE WHEN json_type(extra_data, '$.keywords') = 'ARRAY' THEN CAST(json_extract(extra_data, '$.keywords') AS JSON[]) ELSE [] END, lambda x: json_type(x) = 'VARCHAR') AS kw FROM {I} WHERE extra_data IS NOT NULL),
 os AS (SELECT researcher_id, id, coalesce(nullif(title, ''), alternative_title, '') AS title, string_split_regex(keywords, '[;,]') AS kw FROM {O} WHERE keywords IS NOT NULL),
 me AS (SELECT researcher_id, term, n * weight AS n, 'mined' AS source, sample, stage * 1000000000000000000 + row * 1000000000 + phase * 10000000 + place AS seen FROM m JOIN own ON tid = m.id
  UNION ALL SELECT researcher_id, {_CLEAN("json_extract_string(kw[i], '$')")}, 2, 'keyword', title, id * 1000000000 + i - 1 FROM (SELECT *, unnest(range(1, len(kw) + 1)) AS i FROM js)
  UNION ALL SELECT researcher_id, {_CLEAN('kw[i]')}, 2, 'keyword', title, 1000000000000000000 + id * 1000000000 + i - 1 FROM (SELECT *, unnest(range(1, len(kw) + 1)) AS i FROM os)), {_indexed('me', stop)}"""


_MENTIONS, _INDEX_MENTIONS = _mentions(_STOP), _mentions(_INDEX_STOP)


def _folder(t, s, d, name="topic-index", stops=TOPIC_STOPS):
    """The stored index of the domain tables, built once."""
    def make(path):
        topics.build_index(t(I), t(O), t(P), path, "1", stops)

    return once(s, d, name, make)


def _whole_folder(t, s, d):
    """The same with the original's list of words that are no terms."""
    return _folder(t, s, d, "topic-index-whole-list", INDEX_STOPS)


@query("x4_five_branches", f"{_INDEX_MENTIONS} SELECT key, term, occurrences, researchers, source FROM ix", I, O, P)
def _(t, s, d):
    return topics.stored_terms(s, _whole_folder(t, s, d)).select("key", "term", "occurrences", "researchers", "source")


@query("x6_slugs", f"""{_MENTIONS}, b AS (SELECT *, trim(regexp_replace({f_('term')}, '[^a-z0-9]+', '-', 'g'), '-') AS base FROM ix), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seen, key) AS place FROM b)
 SELECT key, term, occurrences, researchers, source, CASE WHEN place = 1 THEN base ELSE base || '-' || CAST(place AS VARCHAR) END AS slug FROM r""", I, O, P)
def _(t, s, d):
    return topics.stored_terms(s, _folder(t, s, d))


@query("x5_links", f"{_INDEX_MENTIONS} SELECT key, researcher_id, lk.occurrences, sample FROM lk JOIN ix USING (key)", I, O, P)
def _(t, s, d):
    return topics.stored_links(s, _whole_folder(t, s, d)).select("key", "researcher_id", "occurrences", F.coalesce(F.get("sample_titles", 0), F.lit("")).alias("sample"))


@query("a33_researcher_topics", f"{_MENTIONS} SELECT key, term, CAST(sum(lk.occurrences) AS BIGINT) AS total FROM lk JOIN ix USING (key) WHERE source <> 'mined' AND researchers >= 2 AND researcher_id BETWEEN 1 AND 20 AND term <> 'Gênero' GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 12", I, O, P)
def _(t, s, d):
    f = _folder(t, s, d)
    return topics.researcher_topics(topics.stored_terms(s, f), topics.stored_links(s, f).where("researcher_id BETWEEN 1 AND 20"), exclude="Gênero").drop("slug")


@query("a36_topic_catalogue", f"{_MENTIONS} SELECT key, term, occurrences, researchers FROM ix WHERE source <> 'mined' AND researchers >= 5 AND occurrences >= 40 ORDER BY occurrences DESC, term, key LIMIT 300", I, O, P)
def _(t, s, d):
    return topics.topic_catalogue(topics.stored_terms(s, _folder(t, s, d))).select("key", "term", "occurrences", "researchers")


_LATER = "CAST(NOT starts_with(key, 'ed') AS INT), "
_T6 = "CAST(round(100.0 * occurrences / first_value(occurrences) OVER (ORDER BY {0}occurrences DESC, researchers DESC, key)) AS INT) AS weight"


@query("t6_autocomplete", f"{_MENTIONS} SELECT key, term, occurrences, researchers, {_T6.format(_LATER)} FROM ix WHERE contains(key, 'ed') ORDER BY CAST(NOT starts_with(key, 'ed') AS INT), occurrences DESC, researchers DESC, key LIMIT 24", I, O, P)
def autocomplete(t, s, d):
    return topics.autocomplete(topics.stored_terms(s, _folder(t, s, d)), "Ed").drop("slug")


@query("t7_featured_terms", f"{_MENTIONS} SELECT key, term, occurrences, researchers, {_T6.format('')} FROM ix ORDER BY occurrences DESC, researchers DESC, key LIMIT 24", I, O, P)
def _(t, s, d):
    return topics.featured(topics.stored_terms(s, _folder(t, s, d))).select("key", "term", "occurrences", "researchers", "weight")


@query("a66_topic_stats", f"{_MENTIONS} SELECT count(*) AS terms, max(occurrences) AS most FROM ix", I, O, P)
def _(t, s, d):
    return topics.stored_terms(s, _folder(t, s, d)).agg(F.count(F.lit(1)).alias("terms"), F.max("occurrences").alias("most"))


@query("a55_topic_researchers", f"{_MENTIONS} SELECT researcher_id, lk.occurrences, full_name FROM lk JOIN ix USING (key) JOIN {R} r ON r.id = researcher_id WHERE key = 'genero' ORDER BY lk.occurrences DESC, {f_('full_name')}, researcher_id LIMIT 20 OFFSET 20", I, O, P, R)
def _(t, s, d):
    return topics.topic_researchers(topics.stored_links(s, _folder(t, s, d)), t(R), "genero", 2, 20).select("researcher_id", "occurrences", "full_name")


@query("a55_topic_departments", f"{_MENTIONS} SELECT department, count(DISTINCT r.id) AS total FROM lk JOIN ix USING (key) JOIN {R} r ON r.id = researcher_id WHERE key = 'genero' AND department <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", I, O, P, R)
def _(t, s, d):
    return topics.topic_departments(topics.stored_links(s, _folder(t, s, d)), t(R), "genero")


_PARTS = "SELECT id, trim(unnest(string_split_regex(keywords_text, '[;,]'))) AS term FROM production_items"


@query("m3_split_keywords", f"SELECT id, term FROM ({_PARTS}) WHERE length(term) >= 3", I)
def _(t, s, d):
    return topics.declared(t(I).select("id", F.col("keywords_text").alias("keywords")))


@query("m2_json_keywords", f"SELECT id, json_extract_string(x, '$') AS keyword FROM (SELECT id, unnest(CASE WHEN json_type(extra_data, '$.keywords') = 'ARRAY' THEN CAST(json_extract(extra_data, '$.keywords') AS JSON[]) ELSE [] END) AS x FROM {I} WHERE extra_data IS NOT NULL) WHERE json_type(x) = 'VARCHAR'", I)
def _(t, s, d):
    return t(I).select("id", F.explode(topics.json_keywords(F.col("extra_data"))).alias("keyword"))


@query("n18_canonical_terms", f"SELECT id, {_CANON('title')} AS value FROM {I}", I)
def _(t, s, d):
    return t(I).select("id", topics.canonical_term(F.col("title")).alias("value"))


@query("a51_timeline", f""", r AS (SELECT DISTINCT year, kind, lower(trim(title)) AS t FROM (SELECT year, title, 'p' AS kind, concat_ws(' ', title, keywords_text) AS x FROM {I} UNION ALL SELECT year, title, 'o', concat_ws(' ', title, keywords) FROM {O}) WHERE year <= {YEAR} AND contains({f_('x')}, 'genero')),
 n AS (SELECT year, count(*) FILTER (WHERE kind = 'p') AS productions, count(*) FILTER (WHERE kind = 'o') AS orientations, count(*) AS total FROM r GROUP BY 1), pk AS (SELECT year FROM n ORDER BY total DESC, year LIMIT 1)
 SELECT CAST(y AS INT) AS year, coalesce(productions, 0) AS productions, coalesce(orientations, 0) AS orientations, coalesce(total, 0) AS total, y = (SELECT year FROM pk) AS peak FROM (SELECT unnest(range(min(year), {YEAR + 1})) AS y FROM n) LEFT JOIN n ON n.year = y""", I, O)
def topic_timeline(t, s, d):
    return topics.timeline(t(I), t(O), "gênero", YEAR)


@query("a52_related", f""", k AS (SELECT id, {TOPIC('term')} AS key FROM (SELECT id, trim(unnest(string_split_regex(keywords_text, '[;,]'))) AS term FROM {I})) SELECT key, count(*) AS n FROM k WHERE id IN (SELECT id FROM k WHERE key = 'educacao') AND key <> 'educacao' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 14""", I)
def _(t, s, d):
    return topics.related(t(I).select("id", F.col("keywords_text").alias("keywords")), "educacao")


@query("a53_editorial", f"""SELECT coalesce(nullif(qualis, ''), 'Sem Qualis') AS qualis, count(*) AS total, (SELECT CAST(round(CAST(100.0 * count(*) FILTER (WHERE qualis IN ('A1', 'A2')) / count(*) FILTER (WHERE {HASQ}) AS DECIMAL(28, 10)), 1) AS DOUBLE) FROM {I} WHERE item_type = 'ARTIGO') AS a1_a2_percent FROM {I} WHERE item_type = 'ARTIGO' GROUP BY 1""", I)
def _(t, s, d):
    return topics.editorial(t(I))


# --- projects ---------------------------------------------------------------------------------------------------------
_PK = f"CASE WHEN {N1('name')} <> '' THEN sha1({N1('name')} || '|' || coalesce(CAST(start_year AS VARCHAR), '')) END"
_PG = f"coalesce({_PK}, '#' || CAST(id AS VARCHAR))"


@query("b26_project_key", f"SELECT id, {_PK} AS key FROM {P}", P)
def _(t, s, d):
    return t(P).select("id", keys.project_key().alias("key"))


_PW = f"(SELECT *, {_PG} AS grp, row_number() OVER (PARTITION BY {_PG} ORDER BY is_coordinator DESC, length(coalesce(description, '')) DESC, id) AS place, count(*) OVER (PARTITION BY {_PG}) AS records FROM {P})"


@query("w1_project_groups", f"SELECT id, grp, place, records FROM {_PW}", P)
def _(t, s, d):
    return projects.grouped(t(P)).select("id", "grp", "place", "records")


@query("b27_project_catalogue", f"SELECT id, name, status, records, declarers FROM {_PW} g JOIN (SELECT {_PG} AS grp, count(DISTINCT researcher_id) AS declarers FROM {P} GROUP BY 1) d USING (grp) WHERE place = 1", P)
def _(t, s, d):
    return projects.catalogue(t(P))


@query("a56_project_totals", f"SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS groups, count(*) FILTER (WHERE who > 1) AS shared_groups, CAST(sum(open) AS BIGINT) AS ongoing FROM (SELECT {_PG} AS grp, count(*) AS n, count(DISTINCT researcher_id) AS who, count(*) FILTER (WHERE status = 'EM_ANDAMENTO') AS open FROM {P} GROUP BY 1)", P)
def _(t, s, d):
    return projects.totals(t(P))


@query("f12_project_filter", f"SELECT id FROM {P} WHERE contains({f_('name')}, 'agua') AND nature = 'PESQUISA' AND start_year <= 2010 AND coalesce(end_year, CASE WHEN status = 'EM_ANDAMENTO' THEN {YEAR} ELSE start_year END) >= 2005", P)
def _(t, s, d):
    return projects.matching(t(P), YEAR, "Água", nature="PESQUISA", first=2005, last=2010).select("id")


# --- text functions ---------------------------------------------------------------------------------------------------
def _doc_fn(name: str, column, sql: str):
    @query(name, f"SELECT doc_id, {sql} AS value FROM documents")
    def _(t, s, d):
        return s.read.parquet(f"{d}/documents.parquet").select("doc_id", column(F.col("text")).alias("value"))


_doc_fn("n1_normalized", text.normalized, N1("text"))
_doc_fn("n3_topic_key", text.topic_key, TOPIC("text"))
_doc_fn("n10_slug", text.slug, f"CASE WHEN trim(regexp_replace({N1('text')}, '[^a-z0-9]+', '-', 'g'), '-') = '' THEN md5(text) ELSE trim(regexp_replace({N1('text')}, '[^a-z0-9]+', '-', 'g'), '-') END")


@query("n13_issns", "SELECT p_partkey AS id, regexp_matches(x, '^[0-9]{7}[0-9X]$') AND CASE WHEN c = 10 THEN 'X' ELSE CAST(c AS VARCHAR) END = x[8] AS valid FROM (SELECT *, (11 - list_sum(list_transform(range(1, 8), lambda i: (9 - i) * CAST(x[i] AS INT))) % 11) % 11 AS c FROM (SELECT p_partkey, CAST(10000000 + (p_partkey * 7919) % 89999999 AS VARCHAR) AS x FROM part))")
def _(t, s, d):
    x = F.expr("CAST(10000000 + (p_partkey * 7919) % 89999999 AS STRING)")
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.element_at(text.issns(x), 1).alias("issn"))
    return p.select("id", text.issn_valid(F.col("issn")).alias("valid"))


@query("n16_inverted_name", f"SELECT id, split_part(full_name, '#', 2) || ', ' || split_part(full_name, '#', 1) AS value FROM {R}", R)
def _(t, s, d):
    return t(R).select("id", text.inverted_name(F.replace("full_name", F.lit("#"), F.lit(" "))).alias("value"))


_CW = ", ".join(f"'{w}'" for w in text.COMPACT_STOPWORDS)
_PAIRED = f"SELECT id, CASE id % 5 WHEN 0 THEN title || ' (Campinas)' WHEN 1 THEN 'A ' || replace(title, ' ', ' de ') WHEN 2 THEN title || ' especial' WHEN 3 THEN '' ELSE title END AS t FROM {J}"


@query("n19_title_score", f""", tt AS (SELECT p.id AS a, q.id AS b, p.title AS x, q.t AS y FROM {J} p JOIN ({_PAIRED}) q ON q.id = p.id OR q.id = p.id + 1),
 sd AS (SELECT DISTINCT s, {N1('v')} AS k FROM (SELECT s, unnest([s, regexp_replace(s, '[(][^)]*[)]', ' ', 'g')]) AS v FROM (SELECT x AS s FROM tt UNION SELECT y FROM tt)) WHERE {N1('v')} <> ''),
 kc AS (SELECT s, k, list_filter(string_split(k, ' '), lambda w: w NOT IN ({_CW})) AS c FROM sd), kk AS (SELECT s, CASE WHEN len(c) >= 2 THEN c ELSE string_split(k, ' ') END AS w, len(c) >= 2 AS ok FROM kc),
 sc AS (SELECT a, b, CASE WHEN m.ok AND n.ok AND m.w = n.w THEN 1.0 WHEN m.ok AND n.ok AND (contains(' ' || array_to_string(m.w, ' ') || ' ', ' ' || array_to_string(n.w, ' ') || ' ') OR contains(' ' || array_to_string(n.w, ' ') || ' ', ' ' || array_to_string(m.w, ' ') || ' '))
   THEN greatest(0.9, len(list_intersect(list_distinct(m.w), list_distinct(n.w))) * 1.0 / len(list_distinct(list_concat(m.w, n.w)))) ELSE len(list_intersect(list_distinct(m.w), list_distinct(n.w))) * 1.0 / len(list_distinct(list_concat(m.w, n.w))) END AS s
  FROM tt LEFT JOIN kk m ON m.s = x LEFT JOIN kk n ON n.s = y)
 SELECT a, b, round(CAST(coalesce(max(s), 0.0) AS DOUBLE), 9) AS score FROM sc GROUP BY 1, 2""", J)
def _(t, s, d):
    p = t(J).select(F.col("id").alias("a"), F.col("title").alias("x"))
    q = t(J).selectExpr("id AS b", "CASE id % 5 WHEN 0 THEN concat(title, ' (Campinas)') WHEN 1 THEN concat('A ', replace(title, ' ', ' de ')) WHEN 2 THEN concat(title, ' especial') WHEN 3 THEN '' ELSE title END AS y")
    pairs = p.withColumn("b", F.explode(F.array("a", F.col("a") + 1))).join(q, "b")
    return pairs.select("a", "b", F.round(text.title_score(F.col("x"), F.col("y")), 9).alias("score"))


@query("n24_weight_units", f"SELECT id, CAST((floor(10000.0 / n) + CASE WHEN i < 10000 % n THEN 1 ELSE 0 END) / 10000 AS DOUBLE) AS weight FROM (SELECT id, 1 + id % 7 AS n, (id // 7) % (1 + id % 7) AS i FROM {J})", J)
def _(t, s, d):
    j = t(J).select("id", (F.lit(1) + F.col("id") % 7).alias("n"), F.expr("(id div 7) % (1 + id % 7)").alias("i"))
    return j.select("id", text.weight_units(F.col("n"), F.col("i")).cast("double").alias("weight"))


# --- entities ---------------------------------------------------------------------------------------------------------
@query("j10_deduplicated", f"SELECT item_type, title, year, min(id) AS id FROM {I} GROUP BY 1, 2, 3", I)
def _(t, s, d):
    return entities.deduplicated(t(I), ["item_type", "title", "year"])


@query("b22_merge", f"SELECT CASE WHEN researcher_id % 10 = 0 THEN researcher_id + 1 ELSE researcher_id END AS researcher_id, count(*) AS n FROM {I} GROUP BY 1", I)
def _(t, s, d):
    merges = t(R).where("id % 10 = 0").select(F.col("id").alias("old"), (F.col("id") + 1).alias("new"))
    return entities.remapped(t(I), "researcher_id", merges).groupBy("researcher_id").agg(F.count(F.lit(1)).alias("n"))


@query("b30_replaced", f"SELECT researcher_id, count(*) AS n FROM {O} WHERE researcher_id >= 20 OR handle IS NOT NULL OR id % 3 = 0 GROUP BY 1", O)
def _(t, s, d):
    o = t(O)
    new = o.where("researcher_id < 20 AND id % 3 = 0 AND handle IS NULL")
    return entities.replaced(o, new, "researcher_id", F.col("handle").isNotNull()).groupBy("researcher_id").agg(F.count(F.lit(1)).alias("n"))


# What differs between the sides are values; no row is left out.
@query("b29_new_items", f"SELECT id FROM (SELECT *, CASE WHEN id % 5 = 0 THEN title || ' nova' ELSE title END AS now FROM {I}) i WHERE NOT EXISTS (SELECT 1 FROM {I} b WHERE b.item_type = i.item_type AND b.title = i.now AND b.year IS NOT DISTINCT FROM i.year)", I)
def _(t, s, d):
    after = t(I).withColumn("title", F.when(F.col("id") % 5 == 0, F.concat("title", F.lit(" nova"))).otherwise(F.col("title")))
    return entities.new_items(t(I), after, ["item_type", "title", "year"]).select("id")


@query("s22_fill_empty", f"""SELECT coalesce(a.id, b.id) AS id, coalesce(nullif(a.qualis, ''), b.qualis) AS qualis, coalesce(nullif(a.display_title, ''), b.title) AS display_title FROM {J} a FULL OUTER JOIN (SELECT CASE WHEN id % 3 = 0 THEN -id ELSE id END AS id, 'N' AS qualis, title FROM {J}) b ON a.id = b.id""", J)
def _(t, s, d):
    new = t(J).select(F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id")).alias("id"), F.lit("N").alias("qualis"), F.col("title").alias("display_title"))
    return entities.fill_empty(t(J).select("id", "qualis", "display_title"), new, "id", ["qualis", "display_title"])


@query("a61_snapshot_diff", f""", b AS (SELECT id, qualis_journal_id AS j FROM {I}), a AS (SELECT CASE WHEN id % 11 = 0 THEN -id ELSE id END AS id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE qualis_journal_id END AS j FROM {I})
 SELECT CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'removed' WHEN a.j IS NOT DISTINCT FROM b.j THEN 'same' WHEN b.j IS NULL THEN 'gained' WHEN a.j IS NULL THEN 'lost' ELSE 'changed' END AS state, count(*) AS rows FROM b FULL OUTER JOIN a ON a.id = b.id GROUP BY 1""", I)
def _(t, s, d):
    after = t(I).selectExpr("CASE WHEN id % 11 = 0 THEN -id ELSE id END AS id", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE qualis_journal_id END AS journal_id")
    return entities.snapshot_diff(t(I).select("id", F.col("qualis_journal_id").alias("journal_id")), after)


@query("r5_match_authors", f"""SELECT n.name, max(r.id) AS researcher_id FROM (SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'Supplier, ' || x WHEN 1 THEN 'SUPPLIER  ' || x ELSE x || ' supplier.' END AS name, x FROM (SELECT o_custkey, lpad(CAST(o_custkey % 300 AS VARCHAR), 9, '0') AS x FROM orders)) n
 LEFT JOIN {R} r ON r.full_name = 'Supplier#' || n.x GROUP BY 1""", R)
def _(t, s, d):
    x = F.lpad((F.col("o_custkey") % 300).cast("string"), 9, "0")
    name = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Supplier, "), x)).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("SUPPLIER  "), x)).otherwise(F.concat(x, F.lit(" supplier.")))
    return entities.match_authors(s.read.parquet(f"{d}/orders.parquet").select(name.alias("name")), t(R).select("id", F.replace("full_name", F.lit("#"), F.lit(" ")).alias("name")))


# --- areas ------------------------------------------------------------------------------------------------------------
_EV = "ev AS (SELECT p_size % 200 AS fid, CASE p_partkey % 3 WHEN 0 THEN 'wos' WHEN 1 THEN 'scopus' ELSE 'doaj' END AS source, p_partkey AS record_key, p_type AS label, CAST(1 AS DOUBLE) / (1 + p_partkey % 4) AS weight FROM part)"


def _evidence(s, d):
    return s.read.parquet(f"{d}/part.parquet").selectExpr("p_size % 200 AS fid", "CASE p_partkey % 3 WHEN 0 THEN 'wos' WHEN 1 THEN 'scopus' ELSE 'doaj' END AS source", "p_partkey AS record_key", "p_type AS label", "CAST(1 AS DOUBLE) / (1 + p_partkey % 4) AS weight")


@query("a60_evidence_by_family", f"WITH {_EV} SELECT fid, source, label, round(sum(weight), 6) AS total, round(avg(weight), 6) AS mean FROM ev GROUP BY 1, 2, 3")
def _(t, s, d):
    return areas.evidence_by_family(_evidence(s, d)).withColumns({"total": F.round("total", 6), "mean": F.round("mean", 6)})


_EV2 = """ev AS (SELECT p_size % 200 AS fid, CASE p_partkey % 5 WHEN 0 THEN 'wos' WHEN 1 THEN 'scopus' WHEN 2 THEN 'doaj' WHEN 3 THEN 'openalex' ELSE 'ai' END AS source, CAST(p_partkey AS VARCHAR) AS record_key, CASE p_partkey % 5 WHEN 4 THEN CASE p_partkey % 3 WHEN 0 THEN 'a2' WHEN 1 THEN 'b' ELSE 'zz' END WHEN 1 THEN CASE p_partkey % 2 WHEN 0 THEN '1710' ELSE '3309' END ELSE p_type END AS label,
 CAST(1 AS DOUBLE) / (1 + p_partkey % 11) AS weight, p_partkey % 2000 AS works, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE CAST(p_partkey % 13 AS DOUBLE) / 10 END AS confidence, CASE p_partkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' END AS role FROM part)"""
_TAX = [("a", None), ("b", None), ("a1", "a"), ("a2", "a"), ("b1", "b"), (areas.SPREAD_SLUG, None), (areas.PAIR_SLUG, "b")]
_TAXSQL = "tax(slug, parent) AS (VALUES " + ", ".join(f"('{s}', {'NULL' if p is None else repr(p)})" for s, p in _TAX) + ")"
_CW = """cw AS (SELECT v AS vocabulary, label, CASE length(label) % 4 WHEN 0 THEN 'a1' WHEN 1 THEN 'a2' WHEN 2 THEN 'b1' ELSE 'b' END AS slug FROM (SELECT DISTINCT p_type AS label FROM part), (VALUES ('wos'), ('doaj'), ('asjc')) t(v) UNION ALL SELECT v, label, 'a' FROM (SELECT DISTINCT p_type AS label FROM part WHERE p_type > 'M'), (VALUES ('wos'), ('doaj')) t(v) UNION ALL VALUES ('asjc', '1710', 'a1'), ('asjc', '3309', 'b1'))"""
_SHARES = f"""WITH {_EV2}, {_TAXSQL}, {_CW}, u AS (SELECT * FROM ev WHERE source <> 'ai' AND weight > 0 AND (source <> 'openalex' OR weight + 1e-9 >= 0.1)),
 fa AS (SELECT fid, least(1.0, log10(greatest(coalesce(max(CASE WHEN source = 'openalex' THEN works END), 1), 1)) / 3) AS alex, bool_or(source = 'scopus' AND label = '1710') AND bool_or(source = 'scopus' AND label = '3309') AS pair FROM u GROUP BY 1),
 e AS (SELECT u.fid, source, record_key, u.label, weight, alex, CASE WHEN pair AND u.label = '1710' AND source = 'scopus' THEN '{areas.PAIR_SLUG}' ELSE slug END AS slug FROM u JOIN fa ON fa.fid = u.fid JOIN cw ON cw.label = u.label AND vocabulary = CASE source WHEN 'scopus' THEN 'asjc' WHEN 'openalex' THEN 'asjc' ELSE source END),
 s AS (SELECT fid, source, slug, sum(weight / n) AS s, any_value(alex) AS alex FROM (SELECT *, count(*) OVER (PARTITION BY fid, source, record_key, label) AS n FROM e) GROUP BY 1, 2, 3),
 x AS (SELECT fid, source, slug, CASE source WHEN 'openalex' THEN alex WHEN 'doaj' THEN 0.8 ELSE 1.0 END AS w, s / sum(s) OVER (PARTITION BY fid, source) AS f, false AS main, CAST(NULL AS DOUBLE) AS sure FROM s
  UNION ALL SELECT fid, source, label, CASE WHEN coalesce(role = 'primary', weight >= 0.75) THEN 0.9 ELSE 0.45 END * least(1.0, confidence), 1.0, coalesce(role = 'primary', weight >= 0.75), least(1.0, confidence) FROM ev WHERE source = 'ai' AND confidence > 0 AND label IN (SELECT slug FROM tax)),
 o AS (SELECT fid, source, CASE WHEN source = 'ai' THEN sum(w) ELSE max(w) END AS w, max(sure) FILTER (WHERE main) AS m, max(sure) AS a FROM x WHERE w > 0 GROUP BY 1, 2), t AS (SELECT fid, sum(w) AS weight, string_agg(source, ',' ORDER BY source) AS sources, max(coalesce(m, a)) AS ai FROM o GROUP BY 1),
 sh AS (SELECT x.fid, slug, sum(w * f) / any_value(weight) AS share, any_value(weight) AS weight, any_value(sources) AS sources, any_value(ai) AS ai FROM x JOIN t ON t.fid = x.fid WHERE w > 0 GROUP BY 1, 2)"""


def _area_tables(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    e = part.selectExpr(
        "p_size % 200 AS fid", "CASE p_partkey % 5 WHEN 0 THEN 'wos' WHEN 1 THEN 'scopus' WHEN 2 THEN 'doaj' WHEN 3 THEN 'openalex' ELSE 'ai' END AS source", "p_partkey AS record_key",
        "CASE p_partkey % 5 WHEN 4 THEN CASE p_partkey % 3 WHEN 0 THEN 'a2' WHEN 1 THEN 'b' ELSE 'zz' END WHEN 1 THEN CASE p_partkey % 2 WHEN 0 THEN '1710' ELSE '3309' END ELSE p_type END AS label", "CAST(1 AS DOUBLE) / (1 + p_partkey % 11) AS weight",
        "CAST(p_partkey % 2000 AS INT) AS works", "CASE WHEN p_partkey % 7 = 0 THEN 0.0D ELSE CAST(p_partkey % 13 AS DOUBLE) / 10 END AS confidence", "CASE p_partkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' END AS role",
    )
    labels = part.select(F.col("p_type").alias("label")).distinct()
    slug = F.element_at(F.array(*map(F.lit, ("a1", "a2", "b1", "b"))), F.length("label") % 4 + 1)
    spread = lambda df, vs, c: df.select(F.explode(F.array(*map(F.lit, vs))).alias("vocabulary"), "label", c.alias("slug"))
    codes = s.createDataFrame([("asjc", "1710", "a1"), ("asjc", "3309", "b1")], "vocabulary string, label string, slug string")
    cw = spread(labels, ("wos", "doaj", "asjc"), slug).unionByName(spread(labels.where("label > 'M'"), ("wos", "doaj"), F.lit("a"))).unionByName(codes)
    return e, cw, s.createDataFrame(_TAX, "slug string, parent string")


@query("b12_shares", f"{_SHARES} SELECT fid, slug, round(share, 6) AS share, round(weight, 6) AS weight, sources, round(ai, 6) AS ai_confidence FROM sh")
def _(t, s, d):
    c = areas.contributions(*_area_tables(s, d))
    return c.select("fid", "slug", F.round("share", 6).alias("share"), F.round("weight", 6).alias("weight"), F.array_join("sources", ",").alias("sources"), F.round("ai_confidence", 6).alias("ai_confidence"))


@query("b12_decisions", f"""{_SHARES}, r AS (SELECT sh.*, parent, coalesce(parent, sh.slug) AS top, row_number() OVER (PARTITION BY fid ORDER BY round(share, 9) DESC, sh.slug) AS p FROM sh JOIN tax ON tax.slug = sh.slug),
 g AS (SELECT fid, min(p) FILTER (WHERE parent IS NOT NULL AND share + 1e-9 >= 0.34) AS two, min(p) FILTER (WHERE parent IS NULL AND share + 1e-9 >= 0.34) AS one, count(DISTINCT top) FILTER (WHERE share + 1e-9 >= 0.15) AS spread FROM r GROUP BY 1),
 ch AS (SELECT r.fid, min(r.p) AS c FROM r JOIN g ON g.fid = r.fid JOIN r q ON q.fid = r.fid AND q.p = g.one AND r.parent = q.slug WHERE r.share + 1e-9 >= 0.2 GROUP BY 1),
 pr AS (SELECT g.fid, CASE WHEN two IS NOT NULL THEN two WHEN one IS NOT NULL THEN coalesce(c, one) WHEN spread >= 2 THEN -1 ELSE 1 END AS p, two IS NULL AND one IS NULL AS fall FROM g LEFT JOIN ch ON ch.fid = g.fid),
 d AS (SELECT pr.fid, pr.p, fall, coalesce(q.slug, '{areas.SPREAD_SLUG}') AS primary_area, coalesce(q.share, (SELECT share FROM r z WHERE z.fid = pr.fid AND z.slug = '{areas.SPREAD_SLUG}'), 0.0) AS share, x.weight, x.sources, x.ai, q.parent FROM pr LEFT JOIN r q ON q.fid = pr.fid AND q.p = pr.p JOIN r x ON x.fid = pr.fid AND x.p = 1),
 k AS (SELECT *, CASE WHEN fall THEN CASE WHEN p = -1 THEN 'medium' ELSE 'low' END WHEN share + 1e-9 >= 0.5 AND weight + 1e-9 >= 1 AND (contains(sources, ',') OR sources IN ('wos', 'scopus')) THEN 'high' WHEN share + 1e-9 >= 0.34 AND weight + 1e-9 >= 0.5 THEN 'medium' ELSE 'low' END AS plain FROM d),
 se AS (SELECT r.fid, r.slug, row_number() OVER (PARTITION BY r.fid ORDER BY CAST(r.parent IS NULL AS INT), r.p) AS n FROM r JOIN d ON d.fid = r.fid WHERE r.slug <> d.primary_area AND r.share + 1e-9 >= 0.25 AND (r.parent IS NOT NULL OR (NOT EXISTS (SELECT 1 FROM r q WHERE q.fid = r.fid AND q.parent = r.slug) AND coalesce(d.parent, '') <> r.slug)))
 SELECT k.fid, primary_area, round(share, 6) AS share, CASE WHEN sources = 'ai' THEN CASE WHEN ai + 1e-9 >= 0.8 AND plain <> 'low' THEN 'medium' ELSE 'low' END ELSE plain END AS confidence, coalesce((SELECT string_agg(slug, ',' ORDER BY n) FROM se WHERE se.fid = k.fid AND n <= 2), '') AS secondary_areas FROM k""")
def _(t, s, d):
    e, cw, tax = _area_tables(s, d)
    return areas.decide(areas.contributions(e, cw, tax), tax).drop("second")


@query("d6_openalex_weight", "SELECT p_partkey AS id, round(least(1.0, log10(greatest(p_partkey % 3000, 1)) / 3), 9) AS weight FROM part")
def _(t, s, d):
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.round(areas.openalex_weight((F.col("p_partkey") % 3000).cast("int")), 9).alias("weight"))


# --- events -----------------------------------------------------------------------------------------------------------
@query("m1_json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t, s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("stream_per_minute", "SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def _(t, s, d):
    return streaming_events.per_minute(s.read.parquet(f"{d}/events.parquet"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct works by year, gaps filled."""
    return QUERIES["a31_works_per_year"](spark, sf_dir)


# --- families, exports, catalogues --------------------------------------------------------------------------------------
_CC = lambda x, rs, other: "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{n}')" for n in ns) + f" THEN '{o}'" for o, ns in rs) + f" ELSE {other} END"


_POPULAR, _OTHER = "'Teatro Popular'", "'Privada / Comunitária / Outras'"


@query("n5_canonical_course", f"SELECT id, course_name, CASE WHEN coalesce(trim(course_name), '') = '' THEN '' ELSE {_CC(N1('course_name'), rules.COURSES, _POPULAR)} END AS course FROM {E}", E)
def _(t, s, d):
    e = t(E).select("id", "course_name", text.normalized(F.col("course_name")).alias("n"))
    return e.select("id", "course_name", rules.canonical_course(F.col("course_name"), F.col("n")).alias("course"))


@query("n9_institution_type", f"SELECT institution_name, {_CC('lower(institution_name)', rules.INSTITUTION_TYPES, _OTHER)} AS kind, count(*) AS n FROM {X} GROUP BY 1, 2", X)
def _(t, s, d):
    return t(X).groupBy("institution_name").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", rules.institution_type(F.lower("institution_name")))


@query("n27_type_labels", f"SELECT item_type, {'CASE item_type ' + ' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in rules.TYPE_LABELS.items()) + 'END'} AS label, count(*) AS n FROM {I} GROUP BY 1, 2", I)
def _(t, s, d):
    return t(I).groupBy("item_type").agg(F.count(F.lit(1)).alias("n")).withColumn("label", rules.type_label(F.col("item_type")))


@query("n20_name_score", None)
def _(t, s, d):
    a, b = (t(J).select(F.col("id").alias(x), text.resolver_key(F.col("title")).alias(f"t{x}")) for x in "ab")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(rules.name_score("ta", "tb"), 6).alias("score"))


@query("a26_national_partners", f"""SELECT institution_name AS name, CAST(sum(n) AS BIGINT) AS total FROM (SELECT institution_name, count(*) AS n FROM {X} WHERE trim(institution_name) <> '' AND NOT contains({f_('institution_name')}, 'sede') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)
 WHERE institution_name <> 'Empresa C' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", X)
def _(t, s, d):
    known = s.createDataFrame([("empresa c", "Company C", "US"), ("universidade a", "Universidade A", "BR")], "name_key string, shown string, iso string")
    return fam.partners(t(X), known, False, "sede", 100)


@query("b16_learned_names", f""", a AS (SELECT {_KEY('journal_name')} AS name_key, journal_name, coalesce(canonical_journal_id, j.id) AS fid FROM {I} i JOIN {J} j ON j.id = qualis_journal_id WHERE journal_name IS NOT NULL)
 SELECT name_key, min(journal_name) AS name, count(*) AS articles, CASE WHEN min(fid) = max(fid) THEN min(fid) END AS fid, CASE WHEN min(fid) = max(fid) THEN 'variant' ELSE 'conflict' END AS outcome FROM a GROUP BY 1 HAVING count(*) >= 2 AND name_key <> ''""", I, J)
def _(t, s, d):
    j = journals.with_family(t(J)).select(F.col("id").alias("qualis_journal_id"), "fid")
    return fam.learned_names(t(I).join(j, "qualis_journal_id").select("journal_name", "fid"))


@query("z5_catalogue_export", f"SELECT id, title, issn, qualis, databases FROM {J} LEFT JOIN (SELECT journal_id, string_agg(CAST(database_id AS VARCHAR), ';' ORDER BY database_id) AS databases FROM (SELECT DISTINCT * FROM {L}) GROUP BY 1) ON journal_id = id", J, L)
def _(t, s, d):
    return fam.catalogue_export(t(J), t(L))


@query("z6_thesaurus_export", f""", {_FAM}, h AS (SELECT fid, first(title ORDER BY CAST(j.id <> fid AS INT), j.id) AS header FROM {J} j JOIN fam ON fam.id = j.id GROUP BY 1),
 n AS (SELECT fid, {_KEY('title')} AS key, min(title) AS name FROM {J} j JOIN fam ON fam.id = j.id GROUP BY 1, 2)
 SELECT h.fid, header, coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE key <> {_KEY('header')}), '') AS variants FROM h JOIN n ON n.fid = h.fid GROUP BY 1, 2""", J)
def _(t, s, d):
    return fam.thesaurus_export(t(J))


@query("a64_database_counts", f"SELECT id, 'Base ' || CAST(id AS VARCHAR) AS name, coalesce(n, 0) AS journals FROM (SELECT CAST(unnest(range(1, 8)) AS INT) AS id) LEFT JOIN (SELECT database_id, count(DISTINCT journal_id) AS n FROM {L} GROUP BY 1) ON database_id = id", L)
def _(t, s, d):
    bases = s.range(1, 8).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("Base "), F.col("id").cast("string")).alias("name"))
    return fam.database_counts(t(L), bases)


@query("a65_catalogue_page", f"SELECT id, title, issn FROM {J} WHERE (contains({f_('title')}, 'brand') OR contains(coalesce(issn, ''), 'brand')) AND qualis = 'A1' ORDER BY title, id LIMIT 50 OFFSET 50", J)
def _(t, s, d):
    return fam.catalogue_page(t(J), "brand", "A1", 2).select("id", "title", "issn")


@query("a63_review_page", f""", q AS (SELECT {f_('journal_name')} AS name_key, count(*) AS articles FROM {I} WHERE item_type = 'ARTIGO' AND qualis_journal_id IS NULL AND journal_name IS NOT NULL GROUP BY 1)
 SELECT name_key, articles FROM q WHERE contains({N1('name_key')}, 'revista') ORDER BY articles DESC, name_key LIMIT 5""", I)
def _(t, s, d):
    return entities.review_page(journals.name_queue(t(I)), "revista", "name_key", "articles", "name_key", 1, 5).select("name_key", "articles")


@query("b1_family_components", f"SELECT id AS node, min(id) OVER (PARTITION BY title) AS root FROM {J} QUALIFY count(*) OVER (PARTITION BY title) > 1", J)
def _(t, s, d):
    first = t(J).groupBy("title").agg(F.min("id").alias("a"))
    return fam.components(t(J).join(first, "title").where("id <> a").select("a", F.col("id").alias("b")))


@query("b24_indexed", f""", {_FAM}, k AS (SELECT {_KEY('title')} AS key, min(j.id) AS id, min(fid) <> max(fid) AS amb FROM {J} j JOIN fam ON fam.id = j.id GROUP BY 1), it AS (SELECT i.id, item_type, j.title AS journal_name FROM {I} i LEFT JOIN {J} j ON j.id = qualis_journal_id),
 st AS (SELECT j.id, coalesce(nullif(qualis, ''), first(qualis) OVER (PARTITION BY fid ORDER BY CASE WHEN qualis <> '' THEN 0 ELSE 1 END, CAST(j.id <> fid AS INT), j.id)) AS qualis FROM {J} j JOIN fam ON fam.id = j.id)
 SELECT it.id, it.item_type, CASE WHEN NOT amb THEN k.id END AS journal_id, st.qualis FROM it LEFT JOIN k ON item_type = 'ARTIGO' AND key = {_KEY('journal_name')} LEFT JOIN st ON st.id = CASE WHEN NOT amb THEN k.id END""", I, J, L)
def _(t, s, d):
    names = t(J).select(F.col("id").alias("qualis_journal_id"), F.col("title").alias("journal_name"))
    it = t(I).select("id", "item_type", "qualis_journal_id").join(names, "qualis_journal_id", "left").withColumn("issn", F.lit(None).cast("string")).drop("qualis_journal_id")
    r = journals.resolve(names.select(F.col("journal_name").alias("name"), F.lit(None).cast("string").alias("issn")), t(J))
    return fam.indexed(it, r, journals.shown_stratum(t(J)), t(L)).select("id", "item_type", "journal_id", "qualis")


# --- curation -----------------------------------------------------------------------------------------------------------
_DB = f"r AS (SELECT researcher_id, id, year, json_extract_string(unnest(CAST(indexed_databases AS JSON[])), '$.acronym') AS acronym FROM {I} WHERE item_type = 'ARTIGO')"


@query("a44_database_profile", f""", {_DB}, n AS (SELECT researcher_id, acronym, count(*) AS items FROM r GROUP BY 1, 2)
 SELECT n.researcher_id, acronym, items, {_PCT('items', 'every')} AS percent, {_PCT('items', 'indexed')} AS indexed_percent FROM n JOIN (SELECT researcher_id, count(*) AS every, count(indexed_databases) AS indexed FROM {I} WHERE item_type = 'ARTIGO' GROUP BY 1) t ON t.researcher_id = n.researcher_id""", I)
def _(t, s, d):
    return curation.database_profile(t(I))


@query("a44_database_timeline", f""", {_DB}, m AS (SELECT * FROM r WHERE researcher_id = 4), y AS (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM {I} WHERE researcher_id = 4)
 SELECT CAST(y AS INT) AS year, c.acronym, count(m.id) AS items FROM y CROSS JOIN (SELECT DISTINCT acronym FROM m) c LEFT JOIN m ON m.year = y AND m.acronym = c.acronym GROUP BY 1, 2""", I)
def _(t, s, d):
    return curation.database_timeline(t(I), 4)


@query("a62_vocabulary_usage", f"SELECT trim(x) AS label, count(DISTINCT id) AS journals FROM (SELECT id, unnest(string_split_regex(replace(area, ' ', '|'), '[|;]')) AS x FROM {J}) WHERE trim(x) <> '' GROUP BY 1", J)
def _(t, s, d):
    return curation.vocabulary_usage(t(J).select("id", F.replace("area", F.lit(" "), F.lit("|")).alias("area")))


@query("b19_guarded", f""", {_FAM}, o AS (SELECT {_KEY('title')} AS key, min(fid) AS owner, max(fid) AS last FROM {J} j JOIN fam ON fam.id = j.id GROUP BY 1), p AS (SELECT CASE WHEN id % 5 = 0 THEN '<b>' || title WHEN id % 3 = 0 THEN title || ' nova' ELSE title END AS name, id AS fid FROM {J})
 SELECT name, fid, CASE WHEN starts_with(name, '<b>') THEN 'rejected' WHEN owner IS NULL THEN 'new' WHEN owner = fid AND last = fid THEN 'known' ELSE 'conflict' END AS state FROM p LEFT JOIN o ON o.key = {_KEY('name')}""", J)
def _(t, s, d):
    own = journals.with_family(t(J)).select(text.resolver_key(F.col("title")).alias("key"), "fid")
    return curation.guarded(t(J).selectExpr("CASE WHEN id % 5 = 0 THEN concat('<b>', title) WHEN id % 3 = 0 THEN concat(title, ' nova') ELSE title END AS name", "id AS fid"), own)


@query("j8_refreshed", f"SELECT id, department, n AS status, status IS DISTINCT FROM n AS changed FROM {R} LEFT JOIN (SELECT id AS i, CASE id % 3 WHEN 0 THEN status WHEN 1 THEN 1 - status END AS n FROM {R}) ON i = id", R)
def _(t, s, d):
    look = t(R).select("id", F.expr("CASE id % 3 WHEN 0 THEN status WHEN 1 THEN 1 - status END").alias("status"))
    return curation.refreshed(t(R).select("id", "department", "status"), look, "id", "status")[0]


@query("j11_prefix_match", None)  # SQL would compare all pairs
def _(t, s, d):
    """J11 over all names and all institutions."""
    return curation.prefix_match(t(J).select(F.lower("title").alias("name")), t(J).select("id", F.col("title").alias("name")))


_CSTOP, _CCONN = (", ".join(f"'{w}'" for w in x) for x in (topics.CLOUD_STOPWORDS, topics.CLOUD_CONNECTORS))
_cok = lambda w: f"(length({w}) >= 3 AND {w} NOT IN ({_CSTOP}) AND NOT regexp_full_match({w}, '[0-9]+(e[0-9]+)?|[ivxlcdm]+'))"


def _cloud_sql(titles: str) -> str:
    return f"""tk AS (SELECT researcher_id, weight, regexp_extract_all(lower(title), '[a-záàâãéèêíïóôõöúçñ0-9]+') AS t FROM ({titles})),
 v AS (SELECT researcher_id, weight, t[i] AS w1, t[i + 1] AS w2, t[i + 2] AS w3 FROM (SELECT researcher_id, weight, t, unnest(range(1, len(t) + 1)) AS i FROM tk) WHERE {_cok('t[i]')}),
 cc AS (SELECT researcher_id, term, sum(weight) AS n FROM (SELECT researcher_id, weight, w1 || ' ' || w2 AS term FROM v WHERE coalesce({_cok('w2')}, false) UNION ALL SELECT researcher_id, weight, w1 || ' ' || w2 || ' ' || w3 FROM v WHERE w2 IN ({_CCONN}) AND coalesce({_cok('w3')}, false)) GROUP BY 1, 2 HAVING sum(weight) >= 2),
 sg AS (SELECT researcher_id, w1 AS term, sum(weight) AS n FROM v GROUP BY 1, 2), ab AS (SELECT researcher_id, word, sum(n) AS n FROM (SELECT researcher_id, unnest(string_split(term, ' ')) AS word, n FROM cc) GROUP BY 1, 2),
 al AS (SELECT * FROM cc UNION ALL SELECT sg.researcher_id, sg.term, sg.n - coalesce(ab.n, 0) FROM sg LEFT JOIN ab ON ab.researcher_id = sg.researcher_id AND ab.word = sg.term WHERE sg.n - coalesce(ab.n, 0) >= 2)
 SELECT researcher_id, term, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY researcher_id ORDER BY n DESC, term) AS place FROM al) WHERE place <= 24"""


@query("x7_keyword_cloud", f", {_cloud_sql(f'SELECT researcher_id, title, 1 AS weight FROM {I} UNION ALL SELECT researcher_id, name, 2 FROM {P}')}", I, P)
def _(t, s, d):
    return topics.cloud(t(I).select("researcher_id", "title", F.lit(1).alias("weight")).unionByName(t(P).select("researcher_id", F.col("name").alias("title"), F.lit(2).alias("weight"))))


@query("x7_cloud_of_texts", f"WITH {_cloud_sql('SELECT doc_id % 50 AS researcher_id, text AS title, 1 AS weight FROM documents')}")
def _(t, s, d):
    return topics.cloud(_texts(s, d).select((F.col("id") % 50).alias("researcher_id"), "title", F.lit(1).alias("weight")))


@query("x7_author_keywords", f""", k AS (SELECT researcher_id, lower(trim(trim(json_extract_string(x, '$')), ' ' || chr(9) || chr(10) || chr(13) || '.,;:-')) AS k FROM (SELECT researcher_id, unnest(CASE WHEN json_type(extra_data, '$.keywords') = 'ARRAY' THEN CAST(json_extract(extra_data, '$.keywords') AS JSON[]) ELSE [] END) AS x FROM {I} WHERE extra_data IS NOT NULL) WHERE json_type(x) = 'VARCHAR'),
 n AS (SELECT researcher_id, k, count(*) AS n, row_number() OVER (PARTITION BY researcher_id ORDER BY count(*) DESC, k) AS p FROM k WHERE length(k) >= 2 GROUP BY 1, 2)
 SELECT researcher_id, list_reduce(list_transform(string_split(k, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), lambda a, b: a || ' ' || b) AS keyword, n FROM n WHERE p <= 24""", I)
def _(t, s, d):
    return topics.author_keywords(t(I).select("researcher_id", topics.json_keywords(F.col("extra_data")).alias("keywords")))


@query("x8_backfilled_keywords", f""", o AS (SELECT {TOPIC('title')} AS k, min(id) AS id FROM {I} GROUP BY 1 HAVING count(*) = 1), l AS (SELECT {TOPIC('title')} AS k, min(keywords) AS found FROM {O} GROUP BY 1 HAVING count(*) = 1)
 SELECT i.id, coalesce(nullif(keywords_text, ''), found) AS keywords FROM {I} i LEFT JOIN (SELECT id, found FROM o JOIN l USING (k)) f ON f.id = i.id""", I, O)
def _(t, s, d):
    return curation.backfilled_keywords(t(I).select("id", "title", F.col("keywords_text").alias("keywords")), t(O).select("title", "keywords")).select("id", "keywords")


@query("z11_ai_batches", f"SELECT CAST((row_number() OVER (ORDER BY id) - 1) // 100 + 1 AS BIGINT) AS batch, id AS fid FROM {J} WHERE qualis IS NULL OR qualis IN ('B1', 'C')", J)
def _(t, s, d):
    f = t(J).selectExpr("id AS fid", "title", "CASE WHEN qualis IN ('B1', 'C') THEN 'low' WHEN qualis IS NOT NULL THEN 'high' END AS confidence")
    return curation.ai_batches(f, 100).select("batch", "fid")


@query("b6_usual_spelling", f""", n AS (SELECT l_partkey % 300 AS fid, CASE l_orderkey % 3 WHEN 0 THEN 'Revista Educação' WHEN 1 THEN 'Revista Educacao' ELSE 'REVISTA DA CIDADE' END AS name FROM lineitem),
 g AS (SELECT fid, name, count(*) AS n, row_number() OVER (PARTITION BY fid ORDER BY count(*) DESC, length(regexp_replace(name, '[\\x00-\\x7F]', '', 'g')) DESC, name) AS p FROM n GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT fid, CASE WHEN name = 'REVISTA DA CIDADE' THEN 'Revista da Cidade' ELSE name END AS shown, n FROM g WHERE p = 1""", R)
def _(t, s, d):
    names = s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_partkey % 300 AS fid", "CASE l_orderkey % 3 WHEN 0 THEN 'Revista Educação' WHEN 1 THEN 'Revista Educacao' ELSE 'REVISTA DA CIDADE' END AS name")
    return authority.usual_spelling(names)


@query("b25_affiliations", f"""SELECT researcher_id, min(start_year) AS admission_year, CASE WHEN NOT bool_or(is_current OR coalesce(end_year >= {YEAR}, false)) THEN max(end_year) END AS leave_year, bool_or(is_current OR coalesce(end_year >= {YEAR}, false)) AS active
 FROM {X} WHERE institution_name = 'Universidade Sede' GROUP BY 1""", X)
def _(t, s, d):
    return authority.affiliations(t(X), "Universidade Sede", YEAR)


from . import queries_more, queries_upkeep  # noqa: E402, F401 (register the further queries)
