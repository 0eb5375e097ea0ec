"""Registered queries over the driver's tables of what keeps the stored tables in order: curricula from pages, identities, merges, upserts, countries, evidence, families.

Each has a twin in SQL that says from the rows' numbers what has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import rules, text
from .operators import areas, audit, countries, curation, entities, families as fam, figures, journal_pipeline, journals as jn, legacy, merges, normalisation, thesaurus, topics
from .plans.bindings import new_path
from .queries import I, J, L, R, X, YEAR, query
from .sources import curriculum, curriculum_html
from .sources.keyed import KeyedTable, PartedTable


def _rows(s, d: str, table: str, **columns: str) -> DataFrame:
    return s.read.parquet(f"{d}/{table}.parquet").selectExpr(*(f"{e} AS `{c}`" for c, e in columns.items()))


def tiled(ids: DataFrame, rows: list[tuple], schema: str, shifted: tuple[str, ...], span: int = 1000) -> DataFrame:
    """Given rows once for each n of ids, with numbers of their own: the shifted columns are n * span on (negative ones back)."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    each = F.explode(F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, fields))) for r in rows)))
    shift = lambda c: F.col(f"r.{c}") + F.when(F.col(f"r.{c}") < 0, -F.col("n")).otherwise(F.col("n")) * span
    return ids.select("n", each.alias("r")).select(*((shift(c) if c in shifted else F.col(f"r.{c}")).alias(c) for c, _ in fields))


# --- S9: every page holds the curriculum of a person of its own, before its own markup ---
def _curricula(s, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    lit = F.lit
    cell = lambda a, b: F.concat(lit('<div class="layout-cell layout-cell-3"><b>'), a, lit('</b></div><div class="layout-cell layout-cell-9"><div class="layout-cell-pad-5">'), b, lit("</div></div>"))
    section = lambda anchor, title, *cells: F.concat(lit(f'<div class="title-wrapper"><a name="{anchor}"></a><h1>{title}</h1></div><div class="layout-cell layout-cell-12 data-cell">'), *cells, lit("</div>"))
    item = lambda x: F.concat(lit('<div class="layout-cell layout-cell-1"><b>1. </b></div><div class="layout-cell layout-cell-11"><span class="transform">'), x, lit("</span></div>"))
    year = (F.lit(1990) + F.col("page_id") % 30).cast("string")
    page = F.concat(
        lit('<div class="infpessoa"><h2 class="nome">Pessoa '), n, lit("</h2></div><ul><li>Endereço para acessar este CV: http://lattes.cnpq.br/"), F.lpad(n, 16, "0"), lit("</li><li>Última atualização do currículo em 07/08/2024</li></ul>"),
        section("FormacaoAcademicaTitulacao", "Formação acadêmica/titulação", cell(F.concat(year, lit(" - 2021")), F.concat(lit("Doutorado em Área "), n, lit(".<br>Universidade Modelo "), n, lit(", UM, Brasil.<br>Orientador: Ana Prado."))), cell(lit("1980 - 1984"), lit("Graduação em Letras.<br>Faculdade Exemplo, FE, Brasil."))),
        section("AtuacaoProfissional", "Atuação Profissional", F.concat(lit('<div class="inst_back"><b>Instituto '), n, lit("</b></div>")), cell(F.concat(lit("03/"), year, lit(" - Atual")), lit("Vínculo: Servidor público, Enquadramento Funcional: Pesquisador, Carga horária: 40, Regime: Dedicação exclusiva."))),
        lit('<div class="cita-artigos"><b><a name="ArtigosCompletos"></a>Artigos completos publicados em periódicos</b></div><div class="artigo-completo">'), item(F.concat(lit("SILVA, A. ; <b>REIS, B.</b> . Um artigo da página "), n, lit(". REVISTA EXEMPLO, v. 3, n. 2, p. 1-10, "), year, lit("."))), lit("</div>"),
        lit('<div class="cita-artigos"><b><a name="CapitulosLivros"></a>Capítulos de livros publicados</b></div>'), item(F.concat(lit("REIS, B. . Um capítulo &amp; meio. In: Livro "), n, lit(". 1. ed. Santos: Casa Exemplo, 2001. p. 6-7."))),
        section("OrientacoesConcluidas", "Orientações e supervisões concluídas", item(F.concat(lit("Aluno "), n, lit(". <b>Tema "), n, lit("</b>. 2003. Dissertação (Mestrado em Letras) - Universidade Modelo.")))), F.coalesce("html", lit("")),
    )
    pages = s.read.parquet(f"{d}/pages.parquet").where("page_id IS NOT NULL").select(page.alias("content"))
    return curriculum_html.nodes(pages)


@query("s9_html_people", "SELECT lpad(CAST(page_id AS VARCHAR), 16, '0') AS curriculum_id, 'Pessoa ' || page_id AS full_name, DATE '2024-08-07' AS updated FROM pages")
def _(t, s, d):
    return curriculum.researchers(_curricula(s, d)).select("curriculum_id", "full_name", "updated")


@query(
    "s9_html_works",
    """SELECT lpad(CAST(page_id AS VARCHAR), 16, '0') AS curriculum_id, kind AS item_type, CASE kind WHEN 'ARTIGO' THEN 'Um artigo da página ' || page_id ELSE 'Um capítulo & meio' END AS title, CASE kind WHEN 'ARTIGO' THEN CAST(1990 + page_id % 30 AS INT) ELSE 2001 END AS year,
 CASE kind WHEN 'ARTIGO' THEN 'REVISTA EXEMPLO' ELSE 'Livro ' || page_id END AS journal_name, CASE kind WHEN 'ARTIGO' THEN '1-10' ELSE '6-7' END AS pages, CASE kind WHEN 'ARTIGO' THEN 'SILVA, A.|REIS, B' ELSE 'REIS, B' END AS authors
 FROM pages, (VALUES ('ARTIGO'), ('CAPITULO')) AS k(kind)""",
)
def _(t, s, d):
    p = curriculum.productions(_curricula(s, d))
    return p.select("curriculum_id", "item_type", "title", "year", "journal_name", "pages", F.array_join(F.transform("authors", lambda a: a["author_name"]), "|").alias("authors"))


@query(
    "s9_html_careers",
    """SELECT lpad(CAST(page_id AS VARCHAR), 16, '0') AS curriculum_id, kind, CASE kind WHEN 'DOUTORADO' THEN 'Área ' || page_id WHEN 'GRADUACAO' THEN 'Letras' WHEN 'MESTRADO' THEN 'Tema ' || page_id ELSE 'Pesquisador' END AS name,
 CASE kind WHEN 'DOUTORADO' THEN 'Universidade Modelo ' || page_id || ', UM, Brasil.' WHEN 'GRADUACAO' THEN 'Faculdade Exemplo, FE, Brasil.' WHEN 'MESTRADO' THEN 'Universidade Modelo' ELSE 'Instituto ' || page_id END AS institution,
 CAST(CASE kind WHEN 'GRADUACAO' THEN 1980 WHEN 'MESTRADO' THEN 2003 ELSE 1990 + page_id % 30 END AS INT) AS year FROM pages, (VALUES ('DOUTORADO'), ('GRADUACAO'), ('MESTRADO'), ('VINCULO')) AS k(kind)""",
)
def _(t, s, d):
    n = _curricula(s, d)
    e = curriculum.educations(n).select("curriculum_id", F.col("level").alias("kind"), F.col("course_name").alias("name"), F.col("institution_name").alias("institution"), F.col("start_year").alias("year"))
    x = curriculum.experiences(n, "2024-06").select("curriculum_id", F.lit("VINCULO"), "role_name", "institution_name", "start_year")
    o = curriculum.orientations(n).select("curriculum_id", "orientation_type", "title", "institution_name", "year")
    return e.union(x).union(o)


# --- R6 ---
_NAMES = "SELECT i, 'Pessoa ' || i AS name, 'PESSOA ' || i AS key FROM (SELECT CAST(s_suppkey AS BIGINT) AS i FROM supplier)"


def _synced(s, d: str):
    people = _rows(s, d, "supplier", i="CAST(s_suppkey AS BIGINT)")
    name, key = F.concat(F.lit("Pessoa "), F.col("i")), F.concat(F.lit("PESSOA "), F.col("i"))
    stored = people.where("i % 3 = 0").select((F.col("i") + 1).alias("id"), name.alias("preferred_name"), key.alias("normalized_name"))
    variants = people.where("i % 6 = 0").select(F.col("i").alias("id"), (F.col("i") + 1).alias("identity_id"), F.concat(F.lit("Outro "), F.col("i")).alias("name"), F.concat(F.lit("OUTRO "), F.col("i")).alias("normalized_name"), F.lit("manual").alias("source"))
    researchers = people.select(F.col("i").alias("id"), name.alias("full_name"), F.concat(F.lit("P., "), F.col("i"), F.lit(";P "), F.col("i"), F.lit(" bis")).alias("citation_names"), F.when(F.col("i") % 4 == 0, F.concat(F.lit("0000-"), F.col("i"))).alias("orcid"))
    none = stored.select(F.col("id").alias("identity_id"), F.lit("orcid").alias("provider"), F.lit("kept").alias("identifier")).where("identity_id % 5 = 1")
    authors = _rows(s, d, "customer", author_name="concat('Pessoa ', CAST(c_custkey AS STRING))", citation_name="concat('C., ', CAST(c_custkey AS STRING))").unionByName(_rows(s, d, "customer", author_name="''", citation_name="concat('C., ', CAST(c_custkey AS STRING))"))
    return thesaurus.synced(stored, variants, none, researchers, authors)


@query(
    "r6_synced_identities",
    f"""WITH p AS ({_NAMES}), old AS (SELECT i + 1 AS id, name, key, i FROM p WHERE i % 3 = 0), top AS (SELECT max(id) AS m FROM old), new AS (SELECT (SELECT m FROM top) + row_number() OVER (ORDER BY i) AS id, name, key, i FROM p WHERE i % 3 <> 0),
 k AS (SELECT * FROM old UNION ALL SELECT * FROM new), rest AS (SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY c_custkey || ' C') AS id, c_custkey AS i FROM customer WHERE CAST(c_custkey AS BIGINT) NOT IN (SELECT i FROM p))
 SELECT CAST(id AS BIGINT) AS id, name AS preferred_name, key AS normalized_name FROM k UNION ALL SELECT CAST(id AS BIGINT), i || ' C.', i || ' C' FROM rest""",
)
def _(t, s, d):
    return _synced(s, d)[0]


@query(
    "r6_synced_variants",
    f"""WITH p AS ({_NAMES}), n AS (SELECT count(*) AS people, count(*) FILTER (WHERE i % 6 = 0) AS stored FROM p), c AS (SELECT count(*) FILTER (WHERE CAST(c_custkey AS BIGINT) IN (SELECT i FROM p)) AS known, count(*) FILTER (WHERE CAST(c_custkey AS BIGINT) NOT IN (SELECT i FROM p)) AS other FROM customer)
 SELECT source, CAST(total AS BIGINT) AS variants FROM (SELECT 'manual' AS source, stored AS total FROM n UNION ALL SELECT 'lattes', people FROM n UNION ALL SELECT 'citation', 2 * people + known + other FROM n, c UNION ALL SELECT 'production', other FROM c) WHERE total > 0""",
)
def _(t, s, d):
    return _synced(s, d)[1].groupBy("source").agg(F.count(F.lit(1)).alias("variants"))


# --- B22 ---
@query("b22_merge_roots", "SELECT o_orderkey AS id, o_orderkey - o_orderkey % 50 AS root FROM orders WHERE o_orderkey % 50 <> 0")
def _(t, s, d):
    chain = _rows(s, d, "orders", old="o_orderkey", new="o_orderkey - 1").where("old % 50 <> 0")
    return merges.roots(chain).select(F.col("old").alias("id"), F.col("new").alias("root"))


def _institutions(s, d: str):
    i = _rows(s, d, "customer", id="CAST(c_custkey AS BIGINT)", official_name="c_name", short_name="concat('Curto ', CAST(c_custkey % 2 AS STRING))", acronym="CASE WHEN c_custkey % 3 = 0 THEN 'SIG' END", corporate_name="''", type="c_mktsegment")
    v = _rows(s, d, "customer", entity_id="CAST(c_custkey AS BIGINT)", name="concat('Variante-', CAST(c_custkey AS STRING))", key="concat('VARIANTE ', CAST(c_custkey AS STRING))", kind="'alternative'")
    m = i.where("id % 5 <> 0").select(F.col("id").alias("old"), (F.col("id") - 1).alias("new"))
    dependents = {"orders": (_rows(s, d, "orders", id="o_orderkey", institution_id="CAST(o_custkey AS BIGINT)"), "institution_id")}
    return merges.merged_institutions(i, v, m, dependents)


@query(
    "b22_merged_names",
    """WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey - c_custkey % 5 AS r, c_name FROM customer), g AS (SELECT r, count(*) AS n FROM c GROUP BY r)
 SELECT r AS entity_id, 'CUSTOMER ' || substr(c_name, 10) AS key, c_name AS name FROM c WHERE id <> r UNION ALL SELECT r, 'VARIANTE ' || id, 'Variante-' || id FROM c
 UNION ALL SELECT r, 'CURTO ' || (id % 2), 'Curto ' || (id % 2) FROM c GROUP BY 1, 2, 3 HAVING (SELECT n FROM g WHERE g.r = c.r) > 1 UNION ALL SELECT r, 'SIG', 'SIG' FROM c WHERE id % 3 = 0 GROUP BY r HAVING (SELECT n FROM g WHERE g.r = c.r) > 1""",
)
def _(t, s, d):
    return _institutions(s, d)[1].select("entity_id", "key", "name")


@query("b22_moved_references", "SELECT o_custkey - o_custkey % 5 AS institution_id, count(*) AS rows FROM orders GROUP BY 1")
def _(t, s, d):
    return _institutions(s, d)[2]["orders"].groupBy("institution_id").agg(F.count(F.lit(1)).alias("rows"))


# --- Z8 ---
@query(
    "z8_upserted",
    """WITH b AS (SELECT CAST(c_custkey * 3 AS BIGINT) AS k, 7 AS n, 'novo' AS name, 50000.0 AS top FROM customer WHERE c_custkey % 7 = 0)
 SELECT coalesce(o.o_orderkey, b.k) AS k, CAST(coalesce(o.o_orderkey % 10, 0) + coalesce(b.n, 0) AS BIGINT) AS n, CASE WHEN o.o_orderkey % 2 = 0 THEN o.o_orderpriority ELSE b.name END AS name, greatest(o.o_totalprice, b.top) AS top, o.o_orderstatus AS status
 FROM orders o FULL JOIN b ON b.k = o.o_orderkey""",
)
def _(t, s, d):
    base = _rows(s, d, "orders", k="CAST(o_orderkey AS BIGINT)", n="CAST(o_orderkey % 10 AS BIGINT)", name="CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END", top="o_totalprice", status="o_orderstatus")
    batch = _rows(s, d, "customer", k="CAST(c_custkey * 3 AS BIGINT)", n="CAST(7 AS BIGINT)", name="'novo'", top="CAST(50000 AS DOUBLE)").where("k % 7 = 0")
    table = KeyedTable.create(base, new_path(s, "keyed"), ["k"])
    table.upsert(batch, {"n": "add", "name": "fill", "top": "greatest"})
    return table.read().withColumn("name", F.nullif("name", F.lit("")))


# --- R8, N22 ---
_ALIASES = {"kosovo": "XK", "republica do kosovo": "XK", "o terceiro": "Q3"}
_COUNTRIES = {"id": "CAST(n_nationkey + 1 AS BIGINT)", "common_name": "n_name", "official_name": "concat('Reino de ', n_name)", "iso2": "concat('q', CAST(n_nationkey % 10 AS STRING))", "iso3": "concat('qq', CAST(n_nationkey AS STRING))"}
_ASKED = "CASE c_custkey % 9 WHEN 0 THEN lower(n) WHEN 1 THEN concat('  REINO de ', n, '!') WHEN 2 THEN concat('QQ', CAST(k AS STRING)) WHEN 3 THEN concat('Q', CAST(k % 10 AS STRING)) WHEN 4 THEN concat('no ', n, ' (exterior)') WHEN 5 THEN 'Kosovo' WHEN 6 THEN '???' WHEN 7 THEN concat('Variante ', CAST(k AS STRING)) ELSE 'zzz' END"


def _asked(s, d: str) -> DataFrame:
    c = _rows(s, d, "customer", id="CAST(c_custkey AS BIGINT)", c_custkey="c_custkey", k="c_nationkey")
    return c.join(_rows(s, d, "nation", k="n_nationkey", n="n_name"), "k").selectExpr("id", f"{_ASKED} AS raw")


def _keys(s, d: str) -> DataFrame:
    variants = _rows(s, d, "nation", id="CAST(n_nationkey AS BIGINT)", country_id="CAST(n_nationkey + 1 AS BIGINT)", name="concat('Variante ', CAST(n_nationkey AS STRING))")
    return countries.country_keys(_rows(s, d, "nation", **_COUNTRIES), variants, _ALIASES)


# Of two letters that several nations have the largest has them; "no NATION_12 (exterior)" is told by part: the first nation whose name the text contains.
_FOUND = """WITH a AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey % 9 AS w, c_nationkey AS k, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey),
 last AS (SELECT n_nationkey % 10 AS digit, max(n_nationkey) AS k FROM nation GROUP BY 1), part AS (SELECT a.n, min(b.n_nationkey) AS k FROM (SELECT DISTINCT n FROM a) a JOIN nation b ON contains(lower(a.n), lower(b.n_name)) GROUP BY 1),
 r AS (SELECT a.id, CASE WHEN w IN (0, 1, 2, 7) THEN a.k WHEN w = 3 THEN last.k WHEN w = 4 THEN part.k END AS k, w FROM a LEFT JOIN last ON last.digit = a.k % 10 LEFT JOIN part ON part.n = a.n)"""


@query("r8_countries", f"{_FOUND} SELECT id, CASE WHEN w = 5 THEN 0 ELSE CAST(k + 1 AS BIGINT) END AS country_id, CASE WHEN w = 5 THEN 'Kosovo' ELSE n_name END AS common_name, CASE WHEN w = 4 THEN 'part' WHEN w = 5 THEN 'alias' WHEN w = 0 THEN 'name' WHEN w = 1 THEN 'official' WHEN w = 2 THEN 'iso3' WHEN w = 3 THEN 'iso2' WHEN w = 7 THEN 'variant' END AS how FROM r LEFT JOIN nation ON n_nationkey = r.k")
def _(t, s, d):
    return countries.resolved(_asked(s, d), "raw", _keys(s, d)).select("id", "country_id", "common_name", "how")


@query("n22_country_codes", f"{_FOUND} SELECT id, CASE WHEN w = 5 THEN 'XK' WHEN k IS NOT NULL THEN 'Q' || (k % 10) END AS code FROM r")
def _(t, s, d):
    return countries.codes(_asked(s, d), "raw", _keys(s, d)).select("id", "code")


# --- B10 ---
_RAW = ["", "EDUCACAO", "Educação", "educação | saúde", "Conhecida", "educação   FÍSICA", None, "educacao"]
_AREA = ["Canônica / Educação", "Educação", "", "x", None]


@query(
    "b10_legacy_evidence",
    f"""WITH j AS (SELECT p_partkey AS id, {"CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(_RAW)) + " END"} AS raw, {"CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(_AREA)) + " END"} AS area FROM part)
 SELECT id AS journal_id, coalesce(nullif(raw, ''), area) AS label, '2' AS batch FROM j WHERE raw IN ('EDUCACAO', 'Educação', 'Conhecida', 'educação   FÍSICA') OR coalesce(raw, '') = '' AND area = 'Educação'""",
)
def _(t, s, d):
    pick = lambda x, values: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (x % len(values)).cast("int"))
    p = F.col("p_partkey")
    j = s.read.parquet(f"{d}/part.parquet").select(p.alias("id"), pick(p, _RAW).alias("area_raw"), pick(p, _AREA).alias("area"))
    names = s.createDataFrame([("Educação",), ("Educação Física",)], "name string")
    known, canonical = s.createDataFrame([("Conhecida",)], "value string"), s.createDataFrame([("Canônica / Educação",)], "value string")
    store = PartedTable(s, new_path(s, "evidence"))
    found = legacy.legacy_evidence(j, names, known, canonical)
    legacy.load_evidence(store, found.where("journal_id % 2 = 0"), "legacy", "1")
    legacy.load_evidence(store, found, "legacy", "2")
    return legacy.current_evidence(store).select("journal_id", "label", "batch")


# --- B1, B28, R5, R7, B15 ---
def _issn(n: str) -> str:
    """SQL of the ISSN whose first seven digits are n."""
    digit = lambda k: f"(CAST(floor(({n}) / {10**k}) AS BIGINT) % 10)"
    total = " + ".join(f"{k + 2} * {digit(k)}" for k in range(7))
    check = f"((11 - ({total}) % 11) % 11)"
    return f"concat(substr(CAST({n} AS STRING), 1, 4), '-', substr(CAST({n} AS STRING), 5, 3), CASE WHEN {check} = 10 THEN 'X' ELSE CAST({check} AS STRING) END)"


@query("b1_table_families", "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 IN (4, 5, 6, 7) THEN p_partkey - p_partkey % 10 + 4 ELSE p_partkey - p_partkey % 2 END AS family FROM part")
def _(t, s, d):
    p = "1000000 + p_partkey"
    j = _rows(s, d, "part", id="p_partkey", title="concat('Revista Modelo ', CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING))", issn=f"CASE WHEN p_partkey % 10 = 4 THEN concat({_issn(p)}, ' ', {_issn(p + ' + 2')}) ELSE {_issn(p)} END")
    r = s.read.parquet(f"{d}/part.parquet").where("p_partkey % 2 = 0").selectExpr("'wos' AS src", "CAST(p_partkey AS STRING) AS rec", "concat('Revista Modelo ', CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING)) AS title", f"array({_issn(p)}, {_issn(p + ' + 1')}) AS issns")
    return fam.families(j, r).select("id", "family")


_M, _D = "MESTRADO", "DOUTORADO"
_ORIENTED = [(10, 1, _M, "Zé", "x", "h1", None), (11, 1, _M, "Ana Lima", "y", None, None), (12, 1, _M, "Outro Nome", "Um título bem comprido", None, None), (13, 1, _M, "Bia Reis", "Outro título bastante comprido mesmo", None, None), (14, 1, _M, "Maria Silva Santos", "w", None, None), (15, 1, _D, "Leo", "v", None, None)]
_THESES = [(1, 1, _M, "Alguém", "q", "h1", "u1"), (2, 1, _M, "ANA LIMA", "q", "h2", "u2"), (3, 1, _M, "Sem Nome", "um titulo bem comprido", "h3", "u3"), (4, 1, _M, "Caio", "título bastante comprido", "h4", "u4"), (5, 1, _M, "Maria Silva", "r", "h5", "u5"), (6, 1, _M, "Leo", "s", None, None), (7, 1, _M, "LEO", "t", "h7", None), (8, 1, _M, "Ana Lima", "p", "h8", "u8")]


@query("b28_table_theses", "SELECT CAST(id + s_suppkey * 1000 AS BIGINT) AS id, CAST(CASE WHEN oid < 0 THEN oid - s_suppkey * 1000 ELSE oid + s_suppkey * 1000 END AS BIGINT) AS oid, score, state FROM supplier, (VALUES (1, 10, 8, 'known'), (2, 11, 4, 'enriched'), (3, 12, 4, 'enriched'), (4, 13, 2, 'enriched'), (5, 14, 1, 'enriched'), (6, NULL, 0, 'new'), (7, -6, 4, 'enriched'), (8, NULL, 0, 'new')) AS e(id, oid, score, state)")
def _(t, s, d):
    ids = _rows(s, d, "supplier", n="CAST(s_suppkey AS BIGINT)")
    schema = "id bigint, researcher_id bigint, orientation_type string, student string, title string, handle string, uuid string"
    both = [tiled(ids, rows, schema, ("id", "researcher_id")) for rows in (_THESES, _ORIENTED)]
    return curation.thesis_matches(*both)


@query("r5_table_authors", "SELECT name, CAST(max(i) AS BIGINT) AS researcher_id FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'Silva, Ana ' || c_custkey WHEN 1 THEN 'ana ' || c_custkey || ' silva' WHEN 2 THEN 'Ana.' || c_custkey || ' Sílva' ELSE 'Bia ' || c_custkey END AS name, CASE WHEN c_custkey % 4 <> 3 AND c_custkey IN (SELECT s_suppkey FROM supplier) THEN c_custkey END AS i FROM customer) GROUP BY name")
def _(t, s, d):
    names = _rows(s, d, "customer", name="CASE c_custkey % 4 WHEN 0 THEN concat('Silva, Ana ', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('ana ', CAST(c_custkey AS STRING), ' silva') WHEN 2 THEN concat('Ana.', CAST(c_custkey AS STRING), ' Sílva') ELSE concat('Bia ', CAST(c_custkey AS STRING)) END")
    people = _rows(s, d, "supplier", id="CAST(s_suppkey AS BIGINT)", name="concat('Ana ', CAST(s_suppkey AS STRING), ' Silva')")
    return entities.match_authors(names, people).select("name", "researcher_id")


@query("r7_table_institutions", "SELECT name, CAST(max(i) AS BIGINT) AS institution_id FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'UNIVERSIDADE DE X' || (c_custkey % 40) || ' SUL' WHEN 1 THEN 'Departamento - Universidade de X' || (c_custkey % 40) || ' Sul' ELSE 'Nada ' || c_custkey END AS name, CASE WHEN c_custkey % 3 < 2 AND c_custkey % 40 IN (SELECT s_suppkey FROM supplier) THEN c_custkey % 40 END AS i FROM customer) GROUP BY name")
def _(t, s, d):
    names = _rows(s, d, "customer", name="CASE c_custkey % 3 WHEN 0 THEN concat('UNIVERSIDADE DE X', CAST(c_custkey % 40 AS STRING), ' SUL') WHEN 1 THEN concat('Departamento - Universidade de X', CAST(c_custkey % 40 AS STRING), ' Sul') ELSE concat('Nada ', CAST(c_custkey AS STRING)) END")
    places = _rows(s, d, "supplier", id="CAST(s_suppkey AS BIGINT)", name="concat('Universidade de X', CAST(s_suppkey AS STRING), ' Sul')")
    return entities.match_institutions(names, places)


@query("b13_table_fallback", "SELECT CAST(p_partkey AS BIGINT) AS fid, CASE WHEN p_partkey % 3 = 0 THEN 'educacao' WHEN p_partkey % 4 = 0 THEN 'ciencias-da-saude' END AS primary_area, CASE WHEN p_partkey % 3 = 0 THEN 'high' WHEN p_partkey % 4 = 0 THEN 'low' ELSE 'none' END AS confidence, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 = 0 THEN 'pubmed' END AS fallback FROM part")
def _(t, s, d):
    f = _rows(s, d, "part", fid="CAST(p_partkey AS BIGINT)")
    decided = f.where("fid % 3 = 0").select("fid", F.lit("educacao").alias("primary_area"), F.lit(1.0).alias("share"), F.lit("high").alias("confidence"), F.array().cast("array<struct<slug:string,share:double>>").alias("second"))
    return areas.with_fallback(decided, f, f.where("fid % 4 = 0")).select("fid", "primary_area", "confidence", "fallback")


@query(
    "b15_table_thesaurus",
    """WITH u AS (SELECT 'wos' AS vocabulary, 'Rótulo ' || (p_partkey % 50) AS label, count(*) AS n FROM part GROUP BY 2), x AS (SELECT *, CAST(substr(label, 8) AS INT) AS k FROM u)
 SELECT 'capes' AS vocabulary, name AS label, slug, 'active' AS status, CAST(0 AS BIGINT) AS occurrences FROM (VALUES ('Educação', 'educacao'), ('Física', 'fisica')) AS t(name, slug)
 UNION ALL SELECT vocabulary, label, CASE k % 3 WHEN 0 THEN 'educacao' WHEN 1 THEN 'fisica' END, CASE WHEN k % 3 < 2 THEN 'active' ELSE 'pending' END, CAST(n AS BIGINT) FROM x""",
)
def _(t, s, d):
    tax = s.createDataFrame([("educacao", "Educação"), ("fisica", "Física")], "slug string, name string")
    use = s.read.parquet(f"{d}/part.parquet").select(F.lit("wos").alias("vocabulary"), F.concat(F.lit("Rótulo "), F.col("p_partkey") % 50).alias("label")).groupBy("vocabulary", "label").agg(F.count(F.lit(1)).alias("occurrences"))
    k = F.regexp_extract("label", r"(\d+)$", 1).cast("int") % 3
    cw = use.withColumn("slug", F.when(k == 0, "educacao").when(k == 1, "fisica")).where("slug IS NOT NULL").select("vocabulary", "label", "slug")
    now = s.createDataFrame([], "vocabulary string, label string, slug string, manual boolean, status string, occurrences long")
    return areas.synced_thesaurus(now, tax, cw, use).select("vocabulary", "label", "slug", "status", "occurrences")


# --- B25, B31, A57, Z5 ---
@query(
    "b25_affiliations",
    f""", e AS (SELECT *, is_current OR end_year IS NULL OR end_year >= {YEAR} AS going FROM {X} WHERE contains(lower(institution_name), 'sede')),
 g AS (SELECT researcher_id, min(start_year) FILTER (WHERE start_year > 1960 AND start_year <= {YEAR} AND NOT regexp_matches(lower(coalesce(contract_type, '')), 'bolsista|substituto|temporário')) AS first, bool_or(going) AS going, max(end_year) FILTER (WHERE NOT going AND end_year < {YEAR}) AS last FROM e GROUP BY 1)
 SELECT r.id, coalesce(r.admission_year, first) AS admission_year, CASE WHEN going THEN CASE WHEN leave_year < {YEAR} THEN NULL ELSE leave_year END WHEN last IS NOT NULL AND (leave_year IS NULL OR leave_year >= {YEAR}) THEN last ELSE leave_year END AS leave_year,
  CASE WHEN going THEN 1 WHEN last IS NOT NULL THEN 0 ELSE status END AS status FROM {R} r LEFT JOIN g ON g.researcher_id = r.id""",
    R, X,
)
def _(t, s, d):
    return normalisation.affiliation(t(R), t(X).withColumn("role_name", F.lit(None).cast("string")), "sede", YEAR)


@query("z5_catalogue_variants", f"SELECT id, title, issn, qualis, (SELECT string_agg(DISTINCT CAST(database_id AS VARCHAR), ';' ORDER BY CAST(database_id AS VARCHAR)) FROM {L} l WHERE l.journal_id = id) AS databases, CASE WHEN id % 4 = 0 THEN 'Outro ' || id || ';R. ' || id ELSE 'R. ' || id END AS variants FROM {J}", J, L)
def _(t, s, d):
    names = t(J).select(F.col("id").alias("journal_id"), F.concat(F.lit("R. "), F.col("id")).alias("name"))
    more = t(J).where("id % 4 = 0").select(F.col("id").alias("journal_id"), F.concat(F.lit("Outro "), F.col("id")).alias("name"))
    return fam.catalogue_export(t(J), t(L), names.unionByName(more).unionByName(more))


@query(
    "a57_full_report",
    f""", f AS (SELECT coalesce(canonical_journal_id, id) AS fid, * FROM {J}), a AS (SELECT i.*, f.fid FROM {I} i LEFT JOIN f ON f.id = i.qualis_journal_id WHERE item_type = 'ARTIGO')
 SELECT part, key, CAST(value AS BIGINT) AS value FROM (
 SELECT 'rows' AS part, '' AS key, count(*) AS value FROM f UNION ALL SELECT 'families', '', count(DISTINCT fid) FROM f UNION ALL SELECT 'families_with_articles', '', count(DISTINCT fid) FROM a UNION ALL SELECT 'without_issn', '', count(*) FROM f WHERE coalesce(issn, '') = ''
 UNION ALL SELECT 'duplicate_issns', '', count(*) FROM (SELECT issn FROM f WHERE coalesce(issn, '') <> '' GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'linked_articles', '', count(*) FROM a WHERE fid IS NOT NULL UNION ALL SELECT 'unlinked_articles', '', count(*) FROM a WHERE fid IS NULL
 UNION ALL SELECT 'base_families', CAST(database_id AS VARCHAR), count(DISTINCT fid) FROM {L} l JOIN f ON f.id = l.journal_id GROUP BY 2
 UNION ALL SELECT 'evidence_families', CASE WHEN id % 2 = 0 THEN 'wos' ELSE 'doaj' END, count(DISTINCT fid) FROM f WHERE id % 5 > 0 GROUP BY 2 UNION ALL SELECT 'families_without_evidence', '', count(*) FROM (SELECT fid FROM f GROUP BY 1 HAVING max(id % 5) = 0)
 UNION ALL SELECT 'variants', CASE WHEN id % 3 = 0 THEN 'lattes' ELSE 'manual' END, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'queue', CASE WHEN id % 7 = 0 THEN 'ambiguous' ELSE 'pending' END, count(*) FROM f GROUP BY 2)""",
    J, I, L,
)
def _(t, s, d):
    j = t(J)
    evidence = j.where("id % 5 > 0").select(F.col("id").alias("journal_id"), F.when(F.col("id") % 2 == 0, "wos").otherwise("doaj").alias("source"))
    variants = j.select(F.col("id").alias("journal_id"), F.when(F.col("id") % 3 == 0, "lattes").otherwise("manual").alias("kind"))
    queue = j.select(F.when(F.col("id") % 7 == 0, "ambiguous").otherwise("pending").alias("status"))
    return jn.full_report(j, t(I), t(L), evidence, variants, queue)


@query(
    "b31_journal_line",
    f"""SELECT 'links' AS part, CASE WHEN o_orderkey % 3000 IN (SELECT id FROM {J}) THEN 'gained' ELSE 'same' END AS key, count(*) AS value FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 2
 UNION ALL SELECT 'evidence', 'legacy', count(*) FROM {J} WHERE area IS NOT NULL UNION ALL SELECT 'evidence', 'title_rule', count(*) FROM {J} WHERE id % 10 = 7""",
    J,
)
def _(t, s, d):
    """The line of 22 steps over the driver's tables: what the audit finds, and the evidence that the rows themselves give."""
    j = t(J).select("id", F.concat(F.lit("Revista Alfa "), F.col("id")).alias("title"), F.lit(None).cast("string").alias("issn"), "qualis", "area", F.lit(None).cast("string").alias("area_raw"), F.lit(None).cast("bigint").alias("canonical_journal_id"), F.lit(None).cast("string").alias("method"), "display_title", F.lit(False).alias("areas_locked"))
    records = j.select(F.lit("wos").alias("src"), F.col("id").cast("string").alias("rec"), "title", F.array().cast("array<string>").alias("issns"), F.array("area").alias("labels"), F.lit(None).cast("string").alias("country"))
    items = _rows(
        s, d, "orders", id="CAST(o_orderkey AS BIGINT)", item_type="CASE WHEN o_orderkey % 3 < 2 THEN 'ARTIGO' ELSE 'LIVRO' END", title="concat('t', CAST(o_orderkey AS STRING))", year="2000", researcher_id="CAST(o_custkey % 100 AS BIGINT)", journal_name="concat('REVISTA ALFA ', CAST(o_orderkey % 3000 AS STRING))",
        issn="CAST(NULL AS STRING)", qualis_journal_id="CAST(NULL AS BIGINT)",
    )
    labels = j.select("area").where("area IS NOT NULL").distinct()
    slug = F.regexp_replace(F.lower("area"), "[^a-z]+", "-")
    taxonomy = labels.select(F.lit(1).alias("id"), slug.alias("slug"), F.col("area").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"))
    sources = {
        "journals": j, "records": records, "items": items, "links": t(L), "taxonomy": taxonomy, "crosswalk": labels.select(F.lit("wos").alias("vocabulary"), F.col("area").alias("label"), slug.alias("slug")),
        "thesaurus": s.createDataFrame([], "vocabulary string, label string, slug string, manual boolean, status string, occurrences long"),
    }
    tables, _ = journal_pipeline.run(s, new_path(s, "journal-line"), sources, [("7$", "economy")])
    audit = tables["audit"].select(F.lit("links").alias("part"), F.col("state").alias("key"), F.col("rows").cast("bigint").alias("value"))
    return audit.unionByName(tables["report_evidence"].where("source <> 'wos'").select(F.lit("evidence"), "source", F.col("labels").cast("bigint")).toDF("part", "key", "value"))


# --- rules of several fields: a table's rows take one of the given rows by their number; the twin has the results, worked out by hand ---
def by_row(name: str, schema: str, kind: str, value, *cases: tuple, **more) -> None:
    """cases: (row, result). value: from the columns of schema (`name type`, comma-separated) to the result; more: columns made before."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    quoted = [("NULL" if w is None else str(w) if isinstance(w, (bool, int, float)) else "'" + w.replace("'", "''") + "'") for _, w in cases]
    sql = f"SELECT o_orderkey AS id, CAST(CASE o_orderkey % {len(cases)} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(quoted)) + f" END AS {kind}) AS value FROM orders"

    @query(name, sql)
    def _(t, s, d):
        rows = F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, (c, k) in zip(r, fields))) for r, _ in cases))
        x = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.get(rows, (F.col("o_orderkey") % len(cases)).cast("int")).alias("r"))
        return x.select("id", "r.*").withColumns({c: e() for c, e in more.items()}).select("id", value().alias("value"))


_PAIR = "a string, b string"
by_row("n19_title_cases", _PAIR, "DOUBLE", lambda: F.round(text.title_score(F.col("a"), F.col("b")), 6), (("Perspectiva (Florianópolis)", "Perspectiva"), 1.0), (("Educação & Sociedade", "Educação e Sociedade"), 1.0), (("Revista Brasileira de Educação", "Revista Brasileira de Educação Especial"), 0.9), (("Química Nova", "Química Nova na Escola"), 0.9), (("", ""), 0.0), (("Foo bar baz", "Bar foo qux"), 0.5), (("Вестник Науки", "Вестник науки"), 1.0), (("Educa&ccedil;&atilde;o Hoje", "Educação hoje"), 1.0), (("Nature", "Science"), 0.0), (("!?", "x y"), 0.0), (("A", "a"), 1.0))
by_row("n20_name_cases", _PAIR, "DOUBLE", lambda: F.round(rules.name_score("a", "b"), 6), (("abc", "abc"), 1.0), (("abc", "xyz"), 0.0), (("world", "word"), 0.444444), (("ab cd", "ab ce"), 0.566667))
by_row("n21_contained_names", _PAIR, "BOOLEAN", lambda: text.contains_words(F.col("a"), F.col("b")), (("maria silva santos", "maria silva"), True), (("juliana lima", "ana"), False), (("ana paula", "ana"), False), (("a b c", "b c"), True))
by_row("n23_affiliation_periods", "a boolean, s int, e int", "VARCHAR", lambda: rules.affiliation_period(F.col("a"), F.col("s"), F.col("e")), ((True, 2001, 2020), "2001–hoje"), ((False, 1999, 2010), "1999–2010"), ((False, 0, 2010), "até 2010"), ((False, 1999, None), "desde 1999"), ((True, None, 2000), None), ((False, None, 0), None))
by_row("n27_project_periods", "s int, e int, t string", "VARCHAR", lambda: rules.project_period(F.col("s"), F.col("e"), F.col("t")), ((2019, None, "EM_ANDAMENTO"), "2019 – atual"), ((2015, 2018, "CONCLUIDO"), "2015 – 2018"), ((2020, 2020, None), "2020"), ((None, 2018, None), "Até 2018"), ((None, None, None), "Ano não informado"), ((2019, None, "CONCLUIDO"), "2019"))
by_row("r9_shown_institution", _PAIR, "VARCHAR", lambda: curation.shown_institution(F.col("a"), F.col("b")), (("Universidade X", "UX"), "UX - Universidade X"), (("UX Universidade", "UX"), "UX Universidade"), (("Só nome", None), "Só nome"))
by_row("m3_cleaned_terms", "x string", "VARCHAR", lambda: topics.cleaned(F.col("x")), ((" 'educação'. ",), "educação"), (("ab",), None), ((" 2020 ",), None), (("(a-b c);",), "a-b c"), (("x y",), "x y"))
by_row(
    "n7_trajectory_institution", "x string", "VARCHAR", lambda: rules.trajectory_institution(F.col("x"), F.col("k")), (("Universidade Federal de São Carlos",), "UFSCar"), (("Universidade de São Paulo",), "USP"), (("USP - Ribeirão",), "USP"), (("Universidade de Franca",), "UNESP"), (("UNESP Araraquara",), "UNESP"),
    (("Pontifícia Universidade Católica de São Paulo",), "PUC-SP"), (("Universidade de Brasília",), "UnB"), (("UFMG",), "UFMG"), (("manuel",), "UEL"), (("",), "Não informado"), (("ESCOLA NORMAL",), "Escola Normal"), (("instituto superior de estudos muito longos",), "Instituto Superior De Estud..."), k=lambda: text.normalized(F.col("x")),
)


@query("b32_set_by_hand", "SELECT CAST(id + s_suppkey * 1000 AS BIGINT) AS id, area FROM supplier, (VALUES (1, 'direito'), (101, 'direito'), (13, 'saude')) AS e(id, area)")
def _(t, s, d):
    ids = _rows(s, d, "supplier", n="CAST(s_suppkey AS BIGINT)")
    j = tiled(ids, [(1, None), (101, 1), (3, None), (13, None)], "id bigint, canonical_journal_id bigint", ("id", "canonical_journal_id"))
    now = tiled(ids, [(101, "educacao"), (1, "direito"), (3, "saude"), (13, "saude")], "id bigint, area string", ("id",))
    change = tiled(ids, [(101, "direito,nada,direito"), (3, "")], "id bigint, slugs string", ("id",)).withColumn("slugs", F.filter(F.split("slugs", ","), lambda x: x != ""))
    return areas.set_by_hand(now, j, s.createDataFrame([("direito",), ("saude",)], "slug string"), change)


@query("b20_overrides", "SELECT CAST(id + s_suppkey * 1000 AS BIGINT) AS id, area, display_title, CAST(head + s_suppkey * 1000 AS BIGINT) AS canonical_journal_id FROM supplier, (VALUES (1, 'Y', 'T', NULL), (2, 'B', 'N', 1), (3, 'C', NULL, NULL), (4, 'D', NULL, NULL)) AS e(id, area, display_title, head)")
def _(t, s, d):
    ids = _rows(s, d, "supplier", n="CAST(s_suppkey AS BIGINT)")
    j = tiled(ids, [(1, "A", "T", None), (2, "B", None, None), (3, "C", None, 1), (4, "D", None, None)], "id bigint, area string, display_title string, canonical_journal_id bigint", ("id", "canonical_journal_id"))
    events = tiled(ids, [(1, 1, "area", "X", None), (2, 1, "area", "Y", None), (3, 2, "family", None, 1), (4, 2, "display_title", "N", None), (5, 3, "family", "", None), (6, 4, "family", None, 3), (7, 4, "name", "zz", None)], "n bigint, id bigint, field string, value string, head bigint", ("id", "head"))
    return curation.overridden(j, events.select("n", "id", "field", F.coalesce("value", F.col("head").cast("string")).alias("value")))


# --- A61, Z10: every order is an article; between two snapshots some gain, lose or change their journal ---
def _snapshots(s, d: str) -> tuple[DataFrame, DataFrame]:
    links = s.createDataFrame([(1, "WOS"), (1, "DOAJ"), (2, "WOS")], "journal_id long, acronym string")
    items = lambda journal, qualis: _rows(s, d, "orders", id="CAST(o_orderkey AS BIGINT)", item_type="'ARTIGO'", qualis_journal_id=journal, qualis=qualis)
    before = audit.link_state(items("CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_orderkey % 5 - 1 AS BIGINT) END", "CASE WHEN o_orderkey % 2 = 0 THEN 'A1' ELSE '' END").where("id % 11 > 0"), links)
    after = audit.link_state(items("CASE WHEN o_orderkey % 7 > 3 THEN CAST(o_orderkey % 7 - 3 AS BIGINT) END", "CASE WHEN o_orderkey % 4 = 0 THEN 'A1' WHEN o_orderkey % 4 = 1 THEN 'B1' END").where("id % 13 > 0"), links)
    path = new_path(s, "links-audit")
    audit.write_state(before, path, "2026-01-01T00:00:00Z")
    return audit.read_state(s, path), after


_STATES = """b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey % 5 - 1 END AS j, CASE WHEN o_orderkey % 2 = 0 THEN 'A1' END AS q FROM orders WHERE o_orderkey % 11 > 0),
 a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 3 THEN o_orderkey % 7 - 3 END AS j, CASE WHEN o_orderkey % 4 = 0 THEN 'A1' WHEN o_orderkey % 4 = 1 THEN 'B1' END AS q FROM orders WHERE o_orderkey % 13 > 0)"""
_SUMS = "SELECT 'stratum' AS section, coalesce(q, 'Sem Qualis') AS key, count(*) AS n FROM {0} GROUP BY 2 UNION ALL SELECT 'database', x.acronym, count(*) FROM {0} JOIN (VALUES (1, 'WOS'), (1, 'DOAJ'), (2, 'WOS')) AS x(j, acronym) ON x.j = {0}.j GROUP BY 2 UNION ALL SELECT 'total', 'articles', count(*) FROM {0} UNION ALL SELECT 'total', 'linked', count(j) FROM {0}"


@query(
    "a61_link_audit",
    f"""WITH {_STATES}, f AS (SELECT b.id AS bi, a.id AS ai, b.j AS bj, a.j AS aj, b.q AS bq, a.q AS aq FROM b FULL JOIN a ON a.id = b.id), sb AS ({_SUMS.format('b')}), sa AS ({_SUMS.format('a')})
 SELECT 'links' AS section, CASE WHEN bi IS NULL THEN 'new' WHEN ai IS NULL THEN 'removed' WHEN bj IS NOT DISTINCT FROM aj THEN 'same' WHEN bj IS NULL THEN 'gained' WHEN aj IS NULL THEN 'lost' ELSE 'changed' END AS key, CAST(NULL AS BIGINT) AS before, count(*) AS after FROM f GROUP BY 2
 UNION ALL SELECT 'links', 'other_changes', NULL, count(*) FROM f WHERE bi IS NOT NULL AND ai IS NOT NULL AND bj IS NOT DISTINCT FROM aj AND bq IS DISTINCT FROM aq
 UNION ALL SELECT coalesce(sb.section, sa.section), coalesce(sb.key, sa.key), coalesce(sb.n, 0), coalesce(sa.n, 0) FROM sb FULL JOIN sa ON sa.section = sb.section AND sa.key = sb.key""",
)
def _(t, s, d):
    return audit.compared(*_snapshots(s, d))


@query("a61_transitions", f"WITH {_STATES} SELECT b.j AS from_id, a.j AS to_id, count(*) AS n, 'R' || b.j AS from_title, 'R' || a.j AS to_title FROM b JOIN a ON a.id = b.id WHERE b.j IS DISTINCT FROM a.j GROUP BY 1, 2")
def _(t, s, d):
    titles = s.createDataFrame([(1, "R1"), (2, "R2"), (3, "R3")], "id long, title string")
    return audit.transitions(*_snapshots(s, d), titles)


@query("a61_known_cases", "SELECT k AS case, CASE k WHEN 'mix' THEN n ELSE 0 END AS articles, CASE k WHEN 'mix' THEN e ELSE '' END AS examples FROM (VALUES ('mix'), ('none')) AS x(k), (SELECT count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:5], ',') AS e FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 4 <> 2)")
def _(t, s, d):
    items = _rows(s, d, "orders", id="CAST(o_orderkey AS BIGINT)", item_type="'ARTIGO'", qualis_journal_id="CAST(o_orderkey % 3 AS BIGINT)", journal_name="CASE o_orderkey % 4 WHEN 2 THEN 'Caminhos da Educação' ELSE 'EDUCAÇÃO em Revista' END")
    titles = s.createDataFrame([(0, "Outra"), (1, "Caminhos"), (2, None)], "id long, title string")
    return audit.known_cases(items, titles, {"mix": (["educacao em revista", "educação"], ["caminhos"], ["CAMINHOS"]), "none": (["nada"], [], ["caminhos"])})


# --- rules whose rows stand alone: a table's rows take given rows by their number ---
def _picked(s, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """id of every order, and the columns of the row at its number modulo theirs."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    each = F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, (c, k) in zip(r, fields))) for r in rows))
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.get(each, (F.col("o_orderkey") % len(rows)).cast("int")).alias("r")).select("id", "r.*")


def _area_thesaurus(s):
    tax = s.createDataFrame([("educacao", "Educação"), ("fisica", "Física"), ("ensino", "Ensino")], "slug string, name string")
    v = s.createDataFrame([("wos", "Teaching", "educacao", False, "active"), ("doaj", "teaching", "ensino", False, "active"), ("livre", "Teaching, General", "ensino", True, "active"), ("doaj", "Nothing", None, False, "ignored")], "vocabulary string, label string, slug string, manual boolean, status string")
    return areas.thesaurus_groups(v, tax), tax


@query("n30_area_columns", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Física' WHEN 1 THEN 'Ensino' WHEN 2 THEN 'xyz' END AS area, CASE o_orderkey % 4 WHEN 1 THEN 'Teaching, General' WHEN 2 THEN 'xyz' END AS area_raw FROM orders")
def _(t, s, d):
    groups, tax = _area_thesaurus(s)
    return areas.area_columns(_picked(s, d, [("Física",), ("Teaching, General",), (" xyz ",), ("",)], "area string"), groups, tax)


@query("b10_title_rules", "SELECT o_orderkey AS id, slug, CAST(weight AS DOUBLE) AS weight FROM orders JOIN (VALUES (0, 'educacao', 0.3334), (0, 'saude', 0.3333), (0, 'fisica', 0.3333), (1, 'saude', 1.0)) AS e(k, slug, weight) ON k = o_orderkey % 3")
def _(t, s, d):
    j = _picked(s, d, [("Revista de Educação, Saúde e Física",), ("SAÚDE pública",), ("Outra",)], "title string")
    return curation.title_rules(j, [("educacao", "educacao"), ("saude", "saude"), ("fisica", "fisica")]).select("id", "slug", F.col("weight").cast("double").alias("weight"))


@query("n22_source_countries", "SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'BR' WHEN 1 THEN 'MX' WHEN 3 THEN 'BR' WHEN 4 THEN 'GB' WHEN 5 THEN 'US' WHEN 7 THEN 'BR' END AS country FROM orders")
def _(t, s, d):
    rows = [("doaj", "Brazil"), ("latindex", " México "), ("doaj", "Atlantis"), ("openalex", "br"), ("openalex", "XXK"), ("openalex", "CAU"), ("openalex", "SA"), ("openalex", "BL"), ("scopus", "Brazil"), ("openalex", "ZZ")]
    names = s.createDataFrame([("brazil", "BR"), ("brasil", "BR"), ("mexico", "MX")], "key string, code string")
    known = s.createDataFrame([("BR",), ("MX",), ("GB",), ("US",), ("SA",)], "code string")
    return curation.source_country(_picked(s, d, rows, "source string, raw string"), names, known, {"BL": "BR"}, {"K": "GB", "U": "US"}, ["SA"]).select("id", "country")


@query("b21_enriched_issns", f"SELECT CAST(p_partkey AS BIGINT) AS id, {_issn('1000000 + p_partkey').replace('AS STRING', 'AS VARCHAR')} AS issn FROM part WHERE p_partkey % 4 = 0")
def _(t, s, d):
    """Rows without ISSN; a quarter has a title that one record has, another shares it, another's title two records have, another has none."""
    own = "CASE WHEN p_partkey % 4 < 2 THEN concat('Alfa ', CAST(p_partkey AS STRING)) WHEN p_partkey % 4 = 2 THEN 'Beta' ELSE concat('Gama ', CAST(p_partkey AS STRING)) END"
    j = _rows(s, d, "part", id="CAST(p_partkey AS BIGINT)", title=own, issn="''")
    r = _rows(s, d, "part", k="p_partkey % 4", title=f"upper({own})", number=_issn("1000000 + p_partkey"))
    twice = r.where("k = 1").withColumn("number", F.lit("0378-5955"))
    return fam.enriched_issns(j, r.where("k <= 2").unionByName(twice).select("title", F.array("number").alias("issns")))


@query("n8_trajectory_category", "SELECT g AS graduation, m AS master, d AS doctorate, c AS category, CAST(count(*) AS BIGINT) AS total FROM supplier, (VALUES ('UFMG', 'Doutorado Direto', 'UnB', 'Outras'), ('USP', 'Doutorado Direto', 'UFRJ', 'Federais'), ('Graduação Não Inf.', 'UEL', 'Exterior - X', 'Exterior')) AS e(g, m, d, c) GROUP BY 1, 2, 3, 4")
def _(t, s, d):
    rows = [(1, 1, "GRADUACAO", "UFMG", 1990), (2, 1, "DOUTORADO", "UnB", None), (3, 2, "GRADUACAO", "USP", 1980), (4, 2, "GRADUACAO", "UEM", 1981), (5, 2, "DOUTORADO", "UFRJ", 1999), (6, 3, "MESTRADO", "UEL", 2000), (7, 3, "DOUTORADO", "Exterior - X", 2003)]
    ids = _rows(s, d, "supplier", n="CAST(s_suppkey AS BIGINT)")
    return figures.trajectories(tiled(ids, rows, "id bigint, researcher_id bigint, level string, institution_name string, start_year int", ("id", "researcher_id")))
