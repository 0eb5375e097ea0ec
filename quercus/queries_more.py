"""Further registered queries: over the driver's tables with SQL twins, and of rules over given cases whose results were worked out by hand."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, rules, text
from .operators import areas, authority, countries, curation, entities, families as fam, figures, journals, projects, topics
from .plans.bindings import load, new_path
from .plans.filters import ResearchFilter, department_name, department_values, fold_text, is_doi, major_area_code, prepared, relevance, text_predicate
from .queries import A, DONE, HASQ, I, J, K1, K3, KA, L, N1, O, P, QUERIES, R, SQL, TOPIC_STOPS, X, YEAR, _FAM, _KEY, _c, f_, query
from .sources import lists, readers, sinks


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(v) if not isinstance(v, decimal.Decimal) else str(v)
    if isinstance(v, datetime.date):
        return f"DATE '{v}'"
    return "'" + str(v).replace("'", "''") + "'"


#: Rules over given rows, with results worked out by hand: name -> (function of a session, columns, rows). Tests run them; they are no queries.
CASES: dict[str, tuple] = {}


def case(name: str, columns: str, expected: list[tuple]):
    """Keep f(spark) as a case. columns: `name type`, comma-separated."""

    def add(f):
        CASES[name] = f, [c.split()[0] for c in columns.split(", ")], expected
        return f

    return add


def texts(spark: SparkSession, *values: str | None) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x string")


def picked(x: str, values: list) -> str:
    """SQL of the value at x modulo their number."""
    return f"CASE {x} % {len(values)} " + " ".join(f"WHEN {i} THEN {_value(v)}" for i, v in enumerate(values)) + " END"


def of(name: str, kind: str, column, *pairs: tuple) -> None:
    """A function of one text over a table's rows, whose texts follow from their ids; the twin has the results, which were worked out by hand."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
        return rows.withColumn("x", F.get(F.array(*(F.lit(x).cast("string") for x, _ in pairs)), (F.col("id") % len(pairs)).cast("int"))).select("id", column(F.col("x")).alias("value"))

    QUERIES[name] = run
    SQL[name] = f"SELECT o_orderkey AS id, CAST({picked('o_orderkey', [want for _, want in pairs])} AS {kind}) AS value FROM orders"


# --- scalar rules ---
of("n2_resolver_key", "VARCHAR", text.resolver_key, ("Educa&ccedil;&atilde;o &amp; Sociedade", "educacao sociedade"), ("Revista-X (São Paulo)", "revista x sao paulo"), ("Вестник", ""), (None, None), ("日本 Studies", "studies"))
of("n4_title_key", "VARCHAR", text.title_key, ("Вестник Науки!", "вестник науки"), ("Educa&ccedil;&atilde;o", "educacao"), ("Ḉa  Ü", "ca u"), ("", ""))
of("n12_display_decode", "VARCHAR", text.unescape, ("a &amp;lt; b", "a &lt; b"), ("&quot;Escola&quot; &#233; &#xE7;", '"Escola" é ç'), ("sem & nada; &nope;", "sem & nada; &nope;"), ("&eacute;&Atilde;", "éÃ"))
of("n14_compact_key", "VARCHAR", text.compact_key, ("Educação e Sociedade", "educacao sociedade"), ("A Revista", None), ("Cadernos de Pesquisa da USP", "cadernos pesquisa usp"), ("The Journal of the Sea", "journal sea"))
of("n15_without_parentheses", "VARCHAR", text.without_parentheses, ("Perspectiva (Florianópolis)", "Perspectiva"), ("A (b) c (d)", "A c"), ("sem", "sem"))
of("n15_keyword_key", "VARCHAR", lambda c: text.keyword_key(c, ["revista", "de", "da"]), ("Revista de Educação e Saúde", "educacao saude"), ("Revista da", ""))
of("n17_title_case", "VARCHAR", text.display_title, ("REVISTA DE EDUCAÇÃO", "Revista de Educação"), ("ciência e cultura ii", "Ciência e Cultura II"), ("de volta ao tema", "De Volta Ao Tema"), ("RAE-REVISTA d'ÁGUA  xix", "Rae-Revista D'água XIX"), ("(a) the sea", "(A) the Sea"))
of("n26_bare_doi", "VARCHAR", text.bare_doi, ("https://doi.org/10.1/a", "10.1/a"), ("http://dx.doi.org/10.1/B", "10.1/B"), ("10.2/c", "10.2/c"))
of("n6_major_area", "VARCHAR", lambda c: text.rule_chain(text.normalized(c), figures.COURSE_AREAS, F.lit("Outras")), ("Educação Física", "Ciências da Saúde"), ("Engenharia Mecânica", "Engenharias"), ("Música", "Linguística, Letras e Artes"), ("Astrologia", "Outras"))
of("n11_major_area_code", "VARCHAR", major_area_code, ("Ciências Humanas", "CIENCIAS_HUMANAS"), ("CIENCIAS_HUMANAS", "CIENCIAS_HUMANAS"), ("engenharias", "ENGENHARIAS"), ("Nada", None))
of("n23_initials", "VARCHAR", rules.initials, ("Ana Maria de Sá Lima", "AL"), ("Ana", "A"), ("de sá", "DE"), ("João da Silva", "JS"))
of("n27_project_status", "VARCHAR", rules.project_status, ("EM_ANDAMENTO", "Em andamento"), ("OUTRO_CASO", "Outro caso"), (None, "Não informado"))
of("n27_project_nature", "VARCHAR", rules.project_nature, ("EXTENSAO", "Extensão"), ("x", "X"), ("", "Não informado"))
of("n27_funder_nature", "VARCHAR", rules.funder_nature, ("BOLSA", "Bolsa"), ("NAO_INFORMADO", None), (None, None), ("APOIO_TECNICO", "Apoio tecnico"))
of("n28_flags", "VARCHAR", curation.flag, ("BR", "\U0001f1e7\U0001f1f7"), ("FR", "\U0001f1eb\U0001f1f7"), ("", None))
of("n29_department_name", "VARCHAR", department_name, ("DCSo", "Departamento de Ciências Sociais"), ("GEO", "Departamento de Geografia"), ("ZZ", "ZZ"))
of(
    "n31_plausible_name", "BOOLEAN", curation.is_name, ("Revista A", True), ("<b>x</b>", False), ("--", False), ("Stimmen der Zeit <Freiburg, Breisgau>", True), ("State of Exception Studies", True), ("#PerDebate", True), ("--main-color: #fff;", False), (".btn-primary, a", False),
    ("color: red;", False), ("#12 /var/www/html/index.php", False), ("in /vendor/symfony/http-kernel", False), ("HTTP 500 Internal Server Error", False), ("/* cores */", False), ("<!DOCTYPE html>", False), ("a { b }", False), ("Вестник", True), ("Saúde: teoria e prática", True), ("  ", False),
)
of("s6_technical_type", "VARCHAR", curation.technical_type, ("SOFTWARE", "SOFTWARE"), ("PATENTE", "PATENTE"), ("PRODUTO-TECNOLOGICO", "TRABALHO_TECNICO"), ("DEMAIS-TIPOS-DE-PRODUCAO-TECNICA", "OUTRA_TECNICA"))
of("d1_curriculum_date", "DATE", lambda c: F.try_to_timestamp(c, F.lit("ddMMyyyy")).cast("date"), ("05032024", datetime.date(2024, 3, 5)), ("99992024", None), ("", None))
of("n10_slugs", "VARCHAR", text.slug, ("João da Silva", "joao-da-silva"), ("  A  &  B ", "a-b"), ("Ümläut/X", "umlaut-x"))
of("n1_upper", "VARCHAR", lambda c: text.normalized(c, upper=True), ("São Paulo!", "SAO PAULO"), ("Ёлка é", "ЕЛКА E"), ("a_b", "A B"), ("  ", ""))


@case("n7_trajectory_institution", "id INT, value VARCHAR", list(enumerate(["UFSCar", "USP", "USP", "UNESP", "UNESP", "PUC-SP", "UnB", "UFMG", "UEL", "Não informado", "Escola Normal", "Instituto Superior De Estud..."])))
def _(spark):
    x = texts(spark, "Universidade Federal de São Carlos", "Universidade de São Paulo", "USP - Ribeirão", "Universidade de Franca", "UNESP Araraquara", "Pontifícia Universidade Católica de São Paulo", "Universidade de Brasília", "UFMG", "manuel", "", "ESCOLA NORMAL", "instituto superior de estudos muito longos")
    return x.withColumn("k", text.normalized(F.col("x"))).select("id", rules.trajectory_institution(F.col("x"), F.col("k")).alias("value"))


@case("n8_trajectory_category", "graduation VARCHAR, master VARCHAR, doctorate VARCHAR, category VARCHAR, total BIGINT", [("UFMG", "Doutorado Direto", "UnB", "Outras", 1), ("USP", "Doutorado Direto", "UFRJ", "Federais", 1), ("Graduação Não Inf.", "UEL", "Exterior - X", "Exterior", 1)])
def _(spark):
    rows = [(1, 1, "GRADUACAO", "UFMG", 1990), (2, 1, "DOUTORADO", "UnB", None), (3, 2, "GRADUACAO", "USP", 1980), (4, 2, "GRADUACAO", "UEM", 1970 + 11), (5, 2, "DOUTORADO", "UFRJ", 1999), (6, 3, "MESTRADO", "UEL", 2000), (7, 3, "DOUTORADO", "Exterior - X", 2003)]
    e = spark.createDataFrame(rows, "id long, researcher_id long, level string, institution_name string, start_year int")
    return figures.trajectories(e)


@case("n19_title_cases", "id INT, score DOUBLE", [(0, 1.0), (1, 1.0), (2, 0.9), (3, 0.9), (4, 0.0), (5, 0.5), (6, 1.0), (7, 1.0), (8, 0.0), (9, 0.0), (10, 1.0)])
def _(spark):
    rows = [
        ("Perspectiva (Florianópolis)", "Perspectiva"), ("Educação & Sociedade", "Educação e Sociedade"), ("Revista Brasileira de Educação", "Revista Brasileira de Educação Especial"), ("Química Nova", "Química Nova na Escola"), ("", ""), ("Foo bar baz", "Bar foo qux"),
        ("Вестник Науки", "Вестник науки"), ("Educa&ccedil;&atilde;o Hoje", "Educação hoje"), ("Nature", "Science"), ("!?", "x y"), ("A", "a"),
    ]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, a string, b string")
    return d.select("id", F.round(text.title_score(F.col("a"), F.col("b")), 6).alias("score"))


# Shared text of world and word: wor and d; of ab cd and ab ce: ab c.
@case("n20_name_cases", "id INT, score DOUBLE", [(0, 1.0), (1, 0.0), (2, 0.444444), (3, 0.566667)])
def _(spark):
    d = spark.createDataFrame([(0, "abc", "abc"), (1, "abc", "xyz"), (2, "world", "word"), (3, "ab cd", "ab ce")], "id int, a string, b string")
    return d.select("id", F.round(rules.name_score("a", "b"), 6).alias("score"))


@case("n21_contained_names", "id INT, value BOOLEAN", [(0, True), (1, False), (2, False), (3, True)])
def _(spark):
    d = spark.createDataFrame([(0, "maria silva santos", "maria silva"), (1, "juliana lima", "ana"), (2, "ana paula", "ana"), (3, "a b c", "b c")], "id int, a string, b string")
    return d.select("id", text.contains_words(F.col("a"), F.col("b")).alias("value"))


@case("n22_source_countries", "id INT, country VARCHAR", [(0, "BR"), (1, "MX"), (2, None), (3, "BR"), (4, "GB"), (5, "US"), (6, None), (7, "BR"), (8, None), (9, None)])
def _(spark):
    rows = [(0, "doaj", "Brazil"), (1, "latindex", " México "), (2, "doaj", "Atlantis"), (3, "openalex", "br"), (4, "openalex", "XXK"), (5, "openalex", "CAU"), (6, "openalex", "SA"), (7, "openalex", "BL"), (8, "scopus", "Brazil"), (9, "openalex", "ZZ")]
    r = spark.createDataFrame(rows, "id int, source string, raw string")
    names = spark.createDataFrame([("brazil", "BR"), ("brasil", "BR"), ("mexico", "MX")], "key string, code string")
    codes = spark.createDataFrame([("BR",), ("MX",), ("GB",), ("US",), ("SA",)], "code string")
    return curation.source_country(r, names, codes, {"BL": "BR"}, {"K": "GB", "U": "US"}, ["SA"]).select("id", "country")


@case("n23_affiliation_periods", "id INT, value VARCHAR", [(0, "2001–hoje"), (1, "1999–2010"), (2, "até 2010"), (3, "desde 1999"), (4, None), (5, None)])
def _(spark):
    rows = [(0, True, 2001, 2020), (1, False, 1999, 2010), (2, False, 0, 2010), (3, False, 1999, None), (4, True, None, 2000), (5, False, None, 0)]
    return spark.createDataFrame(rows, "id int, a boolean, s int, e int").select("id", rules.affiliation_period(F.col("a"), F.col("s"), F.col("e")).alias("value"))


@case("n27_project_periods", "id INT, value VARCHAR", [(0, "2019 – atual"), (1, "2015 – 2018"), (2, "2020"), (3, "Até 2018"), (4, "Ano não informado"), (5, "2019")])
def _(spark):
    rows = [(0, 2019, None, "EM_ANDAMENTO"), (1, 2015, 2018, "CONCLUIDO"), (2, 2020, 2020, None), (3, None, 2018, None), (4, None, None, None), (5, 2019, None, "CONCLUIDO")]
    return spark.createDataFrame(rows, "id int, s int, e int, t string").select("id", rules.project_period(F.col("s"), F.col("e"), F.col("t")).alias("value"))


@case("f2_clean_requests", "id INT, q VARCHAR, item_type VARCHAR, a INT, b INT, affiliation VARCHAR", [(0, "a b", "ARTIGO", 1990, 2000, "vigente"), (1, "", "", None, 2027, ""), (2, "x" * 200, "", None, None, "")])
def _(spark):
    fs = [ResearchFilter.of(YEAR, q="  a \n b ", item_type="Artigo", first_year="2000", last_year="1990", affiliation="vigente"), ResearchFilter.of(YEAR, item_type="nada", first_year=1900, last_year=2027, affiliation="x"), ResearchFilter.of(YEAR, q="x" * 300, first_year="abc", last_year=3000)]
    return spark.createDataFrame([(i, f.q, f.item_type, f.first_year, f.last_year, f.affiliation) for i, f in enumerate(fs)], "id int, q string, item_type string, a int, b int, affiliation string")


@case("f3_terms", "id INT, terms VARCHAR", [(0, "educação|básica"), (1, "a educação básica"), (2, "de a"), (3, "um1|dois|três|quatro|cinco|seis|sete|oito"), (4, "")])
def _(spark):
    fs = [ResearchFilter.of(YEAR, q="a Educação, básica; educação"), ResearchFilter.of(YEAR, q="a educação básica", exact=True), ResearchFilter.of(YEAR, q="de a"), ResearchFilter.of(YEAR, q="um1 dois três quatro cinco seis sete oito nove"), ResearchFilter.of(YEAR)]
    return spark.createDataFrame([(i, "|".join(f.terms())) for i, f in enumerate(fs)], "id int, terms string")


@case("f10_doi_queries", "id INT, value BOOLEAN", [(0, True), (1, True), (2, False), (3, False), (4, True)])
def _(spark):
    return spark.createDataFrame([(i, is_doi(q)) for i, q in enumerate(["10.1590/abc", "https://doi.org/10.1590/s1", "10.1590", "educação 10.1590/abc", " http://dx.doi.org/10.12345/x "])], "id int, value boolean")


@case("f7_department_values", "department VARCHAR, filter_values VARCHAR", [("DCSo", "CS,DCS,DCSo,Departamento de Ciências Sociais"), ("GEO", "GEO"), ("FIL", "DFil,Departamento de Filosofia,FI,FIL")])
def _(spark):
    names = {"FIL": {"Departamento de Filosofia"}}
    return spark.createDataFrame([(d, ",".join(sorted({*department_values(d), *names.get(d, set())}))) for d in ("DCSo", "GEO", "FIL")], "department string, filter_values string")


# --- families and names ---
_ISSN = ["0102-6909", "1806-9053", "0378-5955", "2434-561X", "1050-124X"]


@case("b1_families", "id BIGINT, family BIGINT, method VARCHAR, reason VARCHAR", [(1, 1, "issn", None), (2, 1, "issn", None), (3, 3, "issn", None), (4, 1, "title", None), (5, 5, "alone", "title"), (6, 6, "alone", None), (7, 3, "issn", "title"), (8, 8, "manual", None), (9, 8, "manual", None)])
def _(spark):
    a, b, c, d, e = _ISSN
    rows = [(1, "Revista Alfa", a, None, None), (2, "Revista Alfa (online)", b, None, None), (3, "Estudos Beta", c, None, None), (4, "REVISTA ALFA", None, None, None), (5, "Outra coisa", f"{a} {c}", None, None), (6, "Sem par", None, None, None), (7, "Estudos Beta", f"{b} {c}", None, None), (8, "Mão", d, None, "manual"), (9, "Membro", None, 8, "manual")]
    j = spark.createDataFrame(rows, "id long, title string, issn string, canonical long, method string")
    r = spark.createDataFrame([("doaj", "1", "Revista Alfa", [a, b]), ("wos", "2", "Estudos Beta", [c]), ("wos", "3", "Pacote", [a, b, c, d]), ("x", "4", "Lista", [e])], "src string, rec string, title string, issns array<string>")
    return fam.families(j, r, spark.createDataFrame([(1, 9), (3, 4)], "id long, n long")).select("id", "family", "method", "reason")


@case("b2_contradicted", "src VARCHAR, rec VARCHAR", [("a", "1")])
def _(spark):
    rows = [("a", "1", ["x", "y", "z"]), ("b", "2", ["x"]), ("c", "3", ["y", "z"]), ("d", "4", ["p", "q", "r"]), ("b", "5", ["p"]), ("b", "6", ["q"])]
    return fam.contradicted(spark.createDataFrame(rows, "src string, rec string, issns array<string>"))


@case("b3_countries_apart", "id BIGINT, family BIGINT, reason VARCHAR, tie BOOLEAN", [(1, 1, None, False), (2, 2, None, False), (3, 3, "country", True), (4, 4, None, False), (5, 4, None, False)])
def _(spark):
    a, b, c, d, _e = _ISSN
    j = spark.createDataFrame([(1, "Gama", a), (2, "Gama", b), (3, "Gama", f"{a} {b}"), (4, "Delta Nova", f"{c} {d}"), (5, "Delta", d)], "id long, title string, issn string")
    r = spark.createDataFrame([("s", "1", "Gama", [a], "BR"), ("s", "2", "Gama", [b], "US"), ("s", "3", "Delta Nova", [c], "BR"), ("s", "4", "Delta Nova Azul", [d], None)], "src string, rec string, title string, issns array<string>, country string")
    return fam.families(j, r).select("id", "family", "reason", "tie")


@case("b6_display_names", "fid BIGINT, shown VARCHAR, source VARCHAR", [(1, "Ciência e Cultura", "scopus"), (2, "Revista Áurea", "lattes"), (3, "Título da Linha", "title"), (4, "RAE-Revista", "doaj")])
def _(spark):
    rows = spark.createDataFrame([(1, 1, "CIÊNCIA E CULTURA"), (2, 2, "REV AUREA"), (3, 3, "TÍTULO DA LINHA"), (30, 3, "outra"), (4, 4, "rae")], "id long, fid long, title string")
    c = spark.createDataFrame([(1, "wos", 1, "CIENCIA E CULTURA"), (1, "scopus", 2, "Ciencia e Cultura"), (4, "doaj", 1, " "), (4, "doaj", 2, "RAE-Revista"), (4, "xx", 1, "Nada")], "fid long, source string, n int, title string")
    n = spark.createDataFrame([(2, "Revista Aurea"), (2, "Revista Áurea"), (2, "Revista Aurea"), (2, "Revista Áurea"), (3, "só uma vez")], "fid long, name string")
    return authority.display_names(rows, c, n)


@case("b9_evidence", "id BIGINT, rec VARCHAR, label VARCHAR, weight DOUBLE", [(1, "1", "x", 0.3334), (1, "1", "y", 0.3333), (1, "1", "z", 0.3333), (2, "2", "w", 1.0)])
def _(spark):
    j = spark.createDataFrame([(1, "A", "0378-5955"), (2, "B", None), (3, "C", "2434-561X")], "id long, title string, issn string")
    r = spark.createDataFrame([("s", "1", "A", ["0378-5955"], ["x", "y", "z"]), ("s", "2", "b", [], ["w"]), ("s", "3", "c", [], ["v"])], "src string, rec string, title string, issns array<string>, labels array<string>")
    return fam.evidence(r, j).select("id", "rec", "label", F.col("weight").cast("double").alias("weight"))


@case("b10_title_rules", "id INT, slug VARCHAR, weight DOUBLE", [(0, "educacao", 0.5), (0, "saude", 0.5), (1, "fisica", 1.0)])
def _(spark):
    j = spark.createDataFrame([(0, "Revista de Educação e Saúde"), (1, "Física Hoje"), (2, "Nada")], "id int, title string")
    return curation.title_rules(j, [("educacao", "educacao"), ("saude", "saude"), ("fisica", "fisica")]).select("id", "slug", F.col("weight").cast("double").alias("weight"))


@case("b11_crosswalk", "vocabulary VARCHAR, key VARCHAR, slug VARCHAR", [("wos", "A", "ensino"), ("wos", "B", "fisica"), ("doaj", "B", None)])
def _(spark):
    schema = "vocabulary string, label string, slug string"
    return areas.crosswalked(spark.createDataFrame([("wos", "A", "educacao"), ("wos", "b", "fisica")], schema), spark.createDataFrame([("wos", "a", "ensino"), ("doaj", "B", None)], schema))


@case("b13_fallback", "fid INT, primary_area VARCHAR, confidence VARCHAR, fallback VARCHAR", [(1, "educacao", "high", None), (2, "ciencias-da-saude", "low", "pubmed"), (3, None, "none", None)])
def _(spark):
    d = spark.createDataFrame([(1, "educacao", 1.0, "high", [])], "fid int, primary_area string, share double, confidence string, second array<struct<slug:string,share:double>>")
    f = spark.createDataFrame([(1,), (2,), (3,)], "fid int")
    return areas.with_fallback(d, f, f.where("fid < 3")).select("fid", "primary_area", "confidence", "fallback")


def _thesaurus(spark):
    tax = spark.createDataFrame([("educacao", "Educação"), ("fisica", "Física"), ("ensino", "Ensino")], "slug string, name string")
    v = spark.createDataFrame([("wos", "Teaching", "educacao", False, "active"), ("doaj", "teaching", "ensino", False, "active"), ("livre", "Teaching, General", "ensino", True, "active"), ("doaj", "Nothing", None, False, "ignored")], "vocabulary string, label string, slug string, manual boolean, status string")
    return areas.thesaurus_groups(v, tax), tax


@case("b14_resolved_areas", "id INT, slugs VARCHAR, unknown VARCHAR", [(1, "fisica", ""), (2, "ensino", ""), (3, "ensino,fisica", "x,y,z"), (4, "", "only")])
def _(spark):
    rows = spark.createDataFrame([(1, "Física"), (2, "Teaching, General"), (3, "x; Ensino, Física | Nothing; y, z"), (4, "only"), (5, " ")], "id int, area string")
    return areas.resolved_areas(rows, _thesaurus(spark)[0]).select("id", F.array_join("slugs", ",").alias("slugs"), F.array_join("unknown", ",").alias("unknown"))


@case("n30_area_columns", "id INT, area VARCHAR, area_raw VARCHAR", [(1, "Física", None), (2, "Ensino", "Teaching, General"), (3, "xyz", "xyz"), (4, None, None)])
def _(spark):
    g, tax = _thesaurus(spark)
    return areas.area_columns(spark.createDataFrame([(1, "Física"), (2, "Teaching, General"), (3, " xyz "), (4, "")], "id int, area string"), g, tax)


@case("b15_thesaurus_sync", "vocabulary VARCHAR, label VARCHAR, slug VARCHAR, status VARCHAR, occurrences BIGINT", [("capes", "Educação", "educacao", "active", 0), ("capes", "Física", "fisica", "active", 0), ("wos", "Education", "educacao", "active", 7), ("doaj", "HAND", "educacao", "active", 6), ("livre", "Novo", None, "pending", 3)])
def _(spark):
    tax = spark.createDataFrame([("educacao", "Educação"), ("fisica", "Física")], "slug string, name string")
    cw = spark.createDataFrame([("wos", "Education", "educacao"), ("wos", "Bad", "nirgends"), ("doaj", "Hand", "fisica")], "vocabulary string, label string, slug string")
    now = spark.createDataFrame([("doaj", "HAND", "educacao", True, "active", 1), ("wos", "Old", "fisica", False, "active", 0), ("wos", "Pend", None, False, "pending", 2)], "vocabulary string, label string, slug string, manual boolean, status string, occurrences long")
    use = spark.createDataFrame([("wos", "Education", 3), ("wos", "education", 4), ("doaj", "hand", 6), ("livre", "Novo", 2), ("livre", "NOVO", 1), ("asjc", "1200", 9)], "vocabulary string, label string, occurrences long")
    return areas.synced_thesaurus(now, tax, cw, use).select("vocabulary", "label", "slug", "status", "occurrences")


@case("b17_external_names", "name VARCHAR, sources BIGINT", [("Rev Educ", 2), ("Changing English", 1)])
def _(spark):
    t = [(1, "Revista Educação"), (2, "Física"), (3, "Changing English: Studies in Culture and Education")]
    r = [("a", "Rev. Educ.", 1), ("b", "Rev Educ", 1), ("a", "Zzz", 2), ("a", "Changing English", 3), ("a", "Known", 1), ("a", "Dois", 1), ("b", "Dois", 2)]
    return curation.external_names(spark.createDataFrame(r, "src string, name string, fid long"), spark.createDataFrame([("known",)], "key string"), spark.createDataFrame(t, "fid long, title string")).select("name", "sources")


@case("b20_overrides", "id BIGINT, area VARCHAR, display_title VARCHAR, canonical_journal_id BIGINT", [(1, "Y", "T", None), (2, "B", "N", 1), (3, "C", None, None), (4, "D", None, None)])
def _(spark):
    j = spark.createDataFrame([(1, "A", "T", None), (2, "B", None, None), (3, "C", None, 1), (4, "D", None, None)], "id long, area string, display_title string, canonical_journal_id long")
    ev = [(1, 1, "area", "X"), (2, 1, "area", "Y"), (3, 2, "family", "1"), (4, 2, "display_title", "N"), (5, 3, "family", ""), (6, 4, "family", "3"), (7, 4, "name", "zz")]
    return curation.overridden(j, spark.createDataFrame(ev, "n long, id long, field string, value string"))


@case("b20_override_names", "key VARCHAR, fid BIGINT", [("alfa", 1), ("gama", 3), ("nova", 2)])
def _(spark):
    names = spark.createDataFrame([("alfa", 1), ("beta", 1), ("gama", 2)], "key string, fid long")
    ev = [(1, 1, "name", "Beta"), (2, 1, "name_reject", "BETA"), (3, 3, "name", "Gama"), (4, 2, "name", "Nova"), (5, 1, "area", "x")]
    return curation.overridden_names(names, spark.createDataFrame(ev, "n long, id long, field string, value string"))


@case("b21_enriched_issns", "id BIGINT, issn VARCHAR", [(1, "0378-5955")])
def _(spark):
    j = spark.createDataFrame([(1, "Alfa", None), (2, "Beta", ""), (3, "BETA", None), (4, "Gama", "2434-561X"), (5, "Delta", None)], "id long, title string, issn string")
    r = spark.createDataFrame([("alfa", ["0378-5955"]), ("Beta", ["1050-124X"]), ("delta", ["1806-9053"]), ("Delta", ["0102-6909"])], "title string, issns array<string>")
    return fam.enriched_issns(j, r)


@case("b22_merged_journals", "part VARCHAR, a VARCHAR, b VARCHAR", [("j", "1", "0378-5955/A1/"), ("j", "3", "//1"), ("l", "1", "7"), ("l", "1", "8"), ("v", "1", "Beta"), ("v", "1", "Var"), ("e", "1", "10"), ("e", "1", "12")])
def _(spark):
    j = spark.createDataFrame([(1, "Alfa", None, "A1", None), (2, "Beta", "0378-5955", "B1", None), (3, "Gama", None, None, 2)], "id long, title string, issn string, qualis string, canonical_journal_id long")
    m = spark.createDataFrame([(2, 1)], "old long, new long")
    ln = spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "journal_id long, database_id int")
    v = spark.createDataFrame([(2, "Var"), (1, "ALFA")], "journal_id long, name string")
    e = spark.createDataFrame([(10, 1, "s", "r", "l"), (11, 2, "s", "r", "l"), (12, 2, "s", "r", "k")], "id long, journal_id long, source string, record_key string, label string")
    a, b, c, d = entities.merged_journals(j, m, ln, v, e)
    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    row = lambda df, part, x, y: df.select(F.lit(part).alias("part"), x.cast("string").alias("a"), y.cast("string").alias("b"))
    return row(a, "j", F.col("id"), F.concat_ws("/", blank("issn"), blank("qualis"), blank("canonical_journal_id"))).unionByName(row(b, "l", F.col("journal_id"), F.col("database_id"))).unionByName(row(c, "v", F.col("journal_id"), F.col("name"))).unionByName(row(d, "e", F.col("journal_id"), F.col("id")))


@case("b23_title_upsert", "n BIGINT, state VARCHAR, journal_id BIGINT", [(1, "updated", 1), (2, "updated", 6), (3, "updated", 2), (4, "ambiguous", None), (5, "updated", 3), (6, "inserted", None)])
def _(spark):
    none = (None, None, None)
    j = spark.createDataFrame([(1, "Alfa", "0378-5955", *none, None), (2, "Beta", None, *none, None), (3, "Gama", None, "2434-561X", None, None, None), (4, "Delta", None, *none, None), (5, "Delta", None, *none, None), (6, "Êta (Rio)", None, *none, None)], "id long, title string, issn string, issn_imp string, issn_e string, issn_l string, canonical_journal_id long")
    rows = [(1, "Alfa", "", "9999-9994", "", ""), (2, "Eta (Rio)", "", "", "", ""), (3, "Beta (São Paulo)", "", "", "", ""), (4, "Delta", "", "", "", ""), (5, "Zeta", "2434-561X", "", "", ""), (6, "Outra", "", "", "", "")]
    return entities.upsert_titles(j, spark.createDataFrame(rows, "n long, title string, issn string, issn_imp string, issn_e string, issn_l string"))


@case("b28_thesis_matches", "id BIGINT, oid BIGINT, score INT, state VARCHAR", [(1, 10, 8, "known"), (2, 11, 4, "enriched"), (3, 12, 4, "enriched"), (4, 13, 2, "enriched"), (5, 14, 1, "enriched"), (6, None, 0, "new"), (7, -6, 4, "enriched"), (8, None, 0, "new")])
def _(spark):
    m, d = "MESTRADO", "DOUTORADO"
    o = [(10, 1, m, "Zé", "x", "h1", None), (11, 1, m, "Ana Lima", "y", None, None), (12, 1, m, "Outro Nome", "Um título bem comprido", None, None), (13, 1, m, "Bia Reis", "Outro título bastante comprido mesmo", None, None), (14, 1, m, "Maria Silva Santos", "w", None, None), (15, 1, d, "Leo", "v", None, None)]
    t = [(1, 1, m, "Alguém", "q", "h1", "u1"), (2, 1, m, "ANA LIMA", "q", "h2", "u2"), (3, 1, m, "Sem Nome", "um titulo bem comprido", "h3", "u3"), (4, 1, m, "Caio", "título bastante comprido", "h4", "u4"), (5, 1, m, "Maria Silva", "r", "h5", "u5"), (6, 1, m, "Leo", "s", None, None), (7, 1, m, "LEO", "t", "h7", None), (8, 1, m, "Ana Lima", "p", "h8", "u8")]
    schema = "id long, researcher_id long, orientation_type string, student string, title string, handle string, uuid string"
    return curation.thesis_matches(spark.createDataFrame(t, schema), spark.createDataFrame(o, schema))


@case("b32_set_by_hand", "id BIGINT, area VARCHAR", [(1, "direito"), (101, "direito"), (13, "saude")])
def _(spark):
    j = spark.createDataFrame([(1, None), (101, 1), (3, None), (13, None)], "id long, canonical_journal_id long")
    now = spark.createDataFrame([(101, "educacao"), (1, "direito"), (3, "saude"), (13, "saude")], "id long, area string")
    change = spark.createDataFrame([(101, ["direito", "nada", "direito"]), (3, [])], "id long, slugs array<string>")
    return areas.set_by_hand(now, j, spark.createDataFrame([("direito",), ("saude",)], "slug string"), change)


@case("z11_imported_batch", "n INT, reason VARCHAR, fid BIGINT, secondary VARCHAR", [(1, None, 5, "b"), (2, "duplicate_family", None, None), (3, "invalid_json", None, None), (4, "missing_key", None, None), (5, "unclassifiable", None, None), (6, "invalid_primary", None, None), (7, "invalid_secondary", None, None), (8, "invalid_confidence", None, None), (9, "unknown_family", None, None), (10, "ambiguous_family", None, None), (12, None, 6, "")])
def _(spark):
    k = '{"key": "issn:1", "primary": "a", "secondary": ["b", "a", "b"], "confidence": 0.9}'
    rows = [(1, k), (2, k), (3, "{no"), (4, '{"primary": "a"}'), (5, '{"key": "issn:1", "primary": null}'), (6, '{"key": "issn:1", "primary": "zz"}'), (7, '{"key": "issn:1", "primary": "a", "secondary": ["b", "c", "d"], "confidence": 1}'), (8, '{"key": "issn:1", "primary": "a", "confidence": "0.9"}'), (9, '{"key": "title:q", "primary": "a", "confidence": 1}'), (10, '{"key": "title:t", "primary": "a", "confidence": 0}'), (11, " "), (12, '{"key": "issn:2", "primary": "c", "secondary": [], "confidence": 1}')]
    f = spark.createDataFrame([("issn:1", 5), ("issn:2", 6), ("title:t", 5), ("title:t", 6)], "key string, fid long")
    return curation.imported_batch(spark.createDataFrame(rows, "n int, line string"), f, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "slug string")).select("n", "reason", "fid", "secondary")


@case("s22_journal_import", "n BIGINT, state VARCHAR, journal_id BIGINT", [(1, "completed", 1), (2, "unchanged", 2), (3, "locked", 3), (4, "ambiguous", None), (5, "created", None), (6, "invalid", 1), (8, "created", None), (9, "completed", None)])
def _(spark):
    j = spark.createDataFrame([(1, "Alfa", "0378-5955", None, "", None, False), (2, "Beta", None, "A1", "x", None, False), (3, "Gama", "2434-561X", "B1", "x", None, True), (4, "Delta", None, None, None, None, False), (5, "Delta", None, None, None, None, False)], "id long, title string, issn string, qualis string, area string, canonical_journal_id long, areas_locked boolean")
    rows = [(1, "outro nome", "0378-5955", "a2", ""), (2, "BETA", "", "B9", ""), (3, "Gama", "2434561x", "A1", ""), (4, "delta", "", "", ""), (5, "Alfa", "1050-124X", "", "q"), (6, "", "0378-5955", "", ""), (7, " ", "", "", ""), (8, "Nova", "", "", ""), (9, "NOVA", "", "C", "")]
    return entities.import_journals(j, spark.createDataFrame(rows, "n long, title string, issn string, qualis string, area string")).select("n", "state", "journal_id")


@case("s20_detected_formats", "id INT, format VARCHAR, confidence DOUBLE", [(0, "latindex", 0.98), (1, "pubmed", 0.95), (2, None, None), (3, "wos", 0.95), (4, "openalex", 0.9), (5, "scopus", 0.99), (6, "own", 0.8)])
def _(spark):
    found = [lists.detect(["folio_u"]), lists.detect(["MedAbbr"]), lists.detect(["a"]), lists.detect(["Journal title", "eISSN", "Publisher name"]), lists.detect(["ISSN-L", "display_name"]), lists.detect(["x"], ["Scopus Sources"]), lists.detect(["foo"], databases={"own": ["FOO"]})]
    return spark.createDataFrame([(i, *(x or (None, None))) for i, x in enumerate(found)], "id int, format string, confidence double")


@case("r5_author_levels", "name VARCHAR, researcher_id BIGINT, identity_id BIGINT", [("Sá, Ana", 2, None), ("ana sa", 2, None), ("Bia Lima", None, 7), ("LIMA, BIA", None, 7), ("C. Reis", 3, 8), ("Ninguém", None, None), ("x", None, None)])
def _(spark):
    p = spark.createDataFrame([(1, "Ana Sá"), (2, "Ana Sá"), (3, "Caio Reis")], "id long, name string")
    v = spark.createDataFrame([("C Reis", 8), ("Sumiu", 9)], "name string, identity_id long")
    i = spark.createDataFrame([(7, "Bia Lima"), (8, "Caio Reis")], "id long, preferred_name string")
    return entities.match_authors(spark.createDataFrame([(n,) for n in ("Sá, Ana", "ana sa", "Bia Lima", "LIMA, BIA", "C. Reis", "Ninguém", "x")], "name string"), p, v, i)


@case("r6_identities", "name VARCHAR, group_size BIGINT", [("Silva, Ana", 3), ("Ana Silva", 3), ("ANA SILVA", 3), ("Bia Lima", 1)])
def _(spark):
    n = authority.identities(spark.createDataFrame([("Silva, Ana",), ("Ana Silva",), ("ANA SILVA",), ("Bia Lima",), (None,)], "name string"))
    return n.join(n.groupBy("identity").agg(F.count(F.lit(1)).alias("group_size")), "identity").select("name", "group_size")


@case("r7_institutions", "name VARCHAR, institution_id BIGINT", [("USP - Campus", 5), ("Universidade de Brasília, Darcy Ribeiro", 4), ("Univ", None), ("Universidade", 4), ("universidade federal", 6)])
def _(spark):
    inst = spark.createDataFrame([(5, "USP"), (6, "Universidade Federal"), (4, "Universidade de Brasília")], "id long, name string")
    names = spark.createDataFrame([(n,) for n in ("USP - Campus", "Universidade de Brasília, Darcy Ribeiro", "Univ", "Universidade", "universidade federal")], "name string")
    return entities.match_institutions(names, inst)


@case("r8_countries", "id INT, value VARCHAR", [(0, "JP"), (1, "JP"), (2, "DE"), (3, "BR"), (4, "JP"), (5, "GB"), (6, None), (7, None), (8, "JP"), (9, "CL")])
def _(spark):
    stored = spark.createDataFrame([(1, "Japão", None, "jp", "JPN")], "id long, common_name string, official_name string, iso2 string, iso3 string")
    x = texts(spark, "JAPAO", " jp ", "Alemanha", "brasileira", "jpn", "INGLATERRA", "Atlantis", "!!", "Universidade do Japão", "chi")
    return countries.codes(x, "x", countries.country_keys(stored)).select("id", F.col("code").alias("value"))


@case("r9_shown_institution", "id INT, value VARCHAR", [(0, "UX - Universidade X"), (1, "UX Universidade"), (2, "Só nome")])
def _(spark):
    d = spark.createDataFrame([(0, "Universidade X", "UX"), (1, "UX Universidade", "UX"), (2, "Só nome", None)], "id int, a string, b string")
    return d.select("id", curation.shown_institution(F.col("a"), F.col("b")).alias("value"))


@case("r10_matched_people", "id BIGINT, researcher_id BIGINT", [(1, 1), (1, 2), (2, 2), (3, 1)])
def _(spark):
    p = spark.createDataFrame([(1, "0" * 16, "o1", "Ana"), (2, "1" * 16, "o2", "Bia")], "id long, registry string, orcid string, name string")
    r = spark.createDataFrame([(1, ["0" * 16], ["o2"], ["Caio"]), (2, [], [], ["bia"]), (3, ["0" * 16, "9" * 16], [], ["Bia"])], "id long, ids array<string>, orcids array<string>, names array<string>")
    return curation.matched_people(r, p)


@case("a27_foreign_partners", "name VARCHAR, total BIGINT", [("Company C", 3), ("Université X", 2), ("Oxford Brookes", 1)])
def _(spark):
    names = ["Empresa C"] * 3 + ["Université X"] * 2 + ["Oxford Brookes", "Universidade A", "Universidade A", "Sede", "", None]
    known = spark.createDataFrame([("empresa c", "Company C", "US"), ("universidade a", "Universidade A", "BR")], "name_key string, shown string, iso string")
    return fam.partners(spark.createDataFrame([(n,) for n in names], "institution_name string"), known, True, "sede", 200)


@case("x3_hybrid_terms", "key VARCHAR, term VARCHAR, source VARCHAR, occurrences BIGINT, researchers BIGINT", [("redes neurais", "Redes Neurais", "hybrid", 4, 2), ("genero", "Gênero", "keyword", 3, 1), ("educacao", "Educação", "mined", 2, 1)])
def _(spark):
    i = spark.createDataFrame([(1, 1, "Redes neurais", None), (2, 2, "x", '{"keywords": ["Redes  neurais", "gênero.", 5, "12", "ab", "estudos"]}'), (3, 2, "gênero", None)], "id long, researcher_id long, title string, extra_data string")
    o = spark.createDataFrame([(1, 2, "", "Redes neurais", None)], "id long, researcher_id long, title string, alternative_title string, keywords string")
    p = spark.createDataFrame([(1, 1, "Educação e trabalho")], "id long, researcher_id long, name string")
    ix = topics.index(topics.spellings(topics.mentions(i, o, p, TOPIC_STOPS)), TOPIC_STOPS)
    return ix.select("key", "term", "source", "occurrences", "researchers")


@case("m3_cleaned_terms", "id INT, value VARCHAR", [(0, "educação"), (1, None), (2, None), (3, "a-b c"), (4, "x y")])
def _(spark):
    return texts(spark, " 'educação'. ", "ab", " 2020 ", "(a-b c);", "x y").select("id", topics.cleaned(F.col("x")).alias("value"))


# --- over the tables ---
@query("s1_bound_scan", f"SELECT id, title FROM {I} WHERE researcher_id = 7 AND year >= 2005 AND item_type = 'ARTIGO'", I)
def _(t, s, d):
    return s.sql("SELECT id, title FROM {items} WHERE researcher_id = :r AND year >= :y AND item_type = :k", args={"r": 7, "y": 2005, "k": "ARTIGO"}, items=t(I))


@query("f4_every_term", f"SELECT id FROM {I} WHERE (contains({f_('title')}, 'redes') OR contains({f_('coalesce(keywords_text, chr(32))')}, 'redes')) AND (contains({f_('title')}, 'educacao') OR contains({f_('coalesce(keywords_text, chr(32))')}, 'educacao'))", I)
def _(t, s, d):
    return prepared(t(I)).where(text_predicate(ResearchFilter.of(YEAR, q="redes educação"))).select("id")


@query("f6_topic", f"SELECT id FROM {I} WHERE contains({f_('title')}, 'fisica') OR contains({f_('coalesce(keywords_text, chr(32))')}, 'fisica')", I)
def _(t, s, d):
    return prepared(t(I)).where(text_predicate(ResearchFilter.of(YEAR, topic="Física"))).select("id")


@query("f8_both_spellings", f"SELECT id FROM {I} WHERE researcher_id IN (SELECT researcher_id FROM {KA} WHERE major_area IN ('CIENCIAS_HUMANAS', 'Ciências Humanas')) AND researcher_id IN (SELECT researcher_id FROM {KA} WHERE {f_('area')} = 'educacao')", I, KA)
def _(t, s, d):
    from .plans.filters import apply_filter

    one = apply_filter(t(I), ResearchFilter.of(YEAR, major_area="CIENCIAS_HUMANAS"), areas=t(KA))
    return apply_filter(one, ResearchFilter.of(YEAR, area="educação"), areas=t(KA)).select("id")


@query("f9_facets", f"SELECT id FROM {I} WHERE item_type = 'LIVRO' AND year BETWEEN 1995 AND 2010 AND researcher_id IN (SELECT id FROM {R} WHERE status = 0)", I, R)
def _(t, s, d):
    from .plans.filters import apply_filter

    return apply_filter(t(I), ResearchFilter.of(YEAR, item_type="livro", first_year=2010, last_year=1995, affiliation="encerrado"), t(R)).select("id")


@query("f14_named_journals", f"SELECT id FROM {I} WHERE regexp_matches(coalesce(journal_name, ''), '[[:alnum:]]')", I)
def _(t, s, d):
    return t(I).where(F.coalesce(F.col("journal_name"), F.lit("")).rlike(r"\p{Alnum}")).select("id")


@query("f15_null_safe", f"SELECT id FROM {I} WHERE qualis IS DISTINCT FROM 'A1'", I)
def _(t, s, d):
    return t(I).where(~F.col("qualis").eqNullSafe("A1")).select("id")


@query("f16_first_filled", f"SELECT id, coalesce(nullif(journal_name, ''), nullif(event_name, ''), nullif(publisher, '')) AS venue FROM {I}", I)
def _(t, s, d):
    return t(I).select("id", keys.venue().alias("venue"))


@query("t5_relevance", f"""SELECT id, 1 * (CASE WHEN contains({f_('title')}, 'redes') THEN 3 ELSE 0 END + CASE WHEN contains({f_("coalesce(keywords_text, '')")}, 'redes') THEN 1 ELSE 0 END + CASE WHEN contains({f_('title')}, 'neurais') THEN 3 ELSE 0 END + CASE WHEN contains({f_("coalesce(keywords_text, '')")}, 'neurais') THEN 1 ELSE 0 END + CASE WHEN contains({f_('title')}, 'redes neurais') THEN 5 ELSE 0 END) AS score,
 CASE WHEN contains({f_('title')}, 'genero') THEN 8 ELSE 0 END + CASE WHEN contains({f_("coalesce(keywords_text, '')")}, 'genero') THEN 3 ELSE 0 END AS exact_score, 1 AS none FROM {I}""", I)
def _(t, s, d):
    score = lambda **k: relevance(ResearchFilter.of(YEAR, **k))
    return prepared(t(I)).select("id", score(q="redes neurais").alias("score"), score(q="gênero", exact=True).alias("exact_score"), score().alias("none"))


@query("j3_owned_items", f"SELECT {I}.id, full_name, database_id FROM {I} JOIN {R} r ON r.id = researcher_id JOIN {L} ON journal_id = qualis_journal_id WHERE item_type = 'ARTIGO'", I, R, L)
def _(t, s, d):
    people = t(R).select(F.col("id").alias("researcher_id"), "full_name")
    return t(I).where("item_type = 'ARTIGO'").join(people, "researcher_id").join(t(L).withColumnRenamed("journal_id", "qualis_journal_id"), "qualis_journal_id").select("id", "full_name", "database_id")


@query("j4_optional_journal", f"SELECT i.id, j.title AS journal FROM {I} i LEFT JOIN {J} j ON j.id = qualis_journal_id", I, J)
def _(t, s, d):
    return t(I).select("id", "qualis_journal_id").join(t(J).select(F.col("id").alias("qualis_journal_id"), F.col("title").alias("journal")), "qualis_journal_id", "left").select("id", "journal")


@query("j5_with_articles", f"SELECT id FROM {R} WHERE id IN (SELECT researcher_id FROM {I} WHERE item_type = 'ARTIGO' AND qualis = 'A1')", I, R)
def _(t, s, d):
    return t(R).join(t(I).where("item_type = 'ARTIGO' AND qualis = 'A1'").select(F.col("researcher_id").alias("id")), "id", "left_semi").select("id")


@query("j7_unique_keys", f", {_FAM} SELECT {_KEY('title')} AS key, min(j.id) AS id, min(fid) <> max(fid) AS ambiguous FROM {J} j JOIN fam ON fam.id = j.id WHERE {_KEY('title')} <> '' GROUP BY 1", J)
def _(t, s, d):
    j = t(J).withColumn("title", F.regexp_replace("title", r"\(.*", ""))
    return journals.key_table(j).where("stage = 2").select("key", "id", "ambiguous")


@query("j12_unknown_issns", f"SELECT DISTINCT CAST(1000 + id % 9000 AS VARCHAR) || '-' || CAST(1000 + id % 50 AS VARCHAR) AS issn FROM {J} WHERE CAST(1000 + id % 9000 AS VARCHAR) || '-' || CAST(1000 + id % 50 AS VARCHAR) NOT IN (SELECT issn FROM {J} WHERE issn IS NOT NULL)", J)
def _(t, s, d):
    seen = t(J).select(F.expr("concat(CAST(1000 + id % 9000 AS STRING), '-', CAST(1000 + id % 50 AS STRING))").alias("issn")).distinct()
    return seen.join(t(J).where("issn IS NOT NULL").select("issn"), "issn", "left_anti")


@query("a59_quality_histogram", f"SELECT coalesce(nullif(qualis, ''), 'N/A') AS qualis, count(*) AS journals FROM {J} GROUP BY 1", J)
def _(t, s, d):
    from .operators.summaries import qualis_distribution

    return qualis_distribution(t(J).withColumn("item_type", F.lit("ARTIGO"))).select(F.when(F.col("qualis") == "Sem Qualis", "N/A").otherwise(F.col("qualis")).alias("qualis"), F.col("total").alias("journals"))


@query("a57_articles_by_base", f", {_FAM} SELECT database_id, count(DISTINCT i.id) AS articles, count(DISTINCT fid) AS families FROM {I} i JOIN fam ON fam.id = qualis_journal_id JOIN {L} ON journal_id = qualis_journal_id WHERE item_type = 'ARTIGO' GROUP BY 1", I, J, L)
def _(t, s, d):
    return journals.articles_by_base(t(I), t(J), t(L))


_AR = "ar AS (SELECT id AS journal_id, CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS area, CAST(id % 2 AS INT) AS is_primary, CAST(id % 7 AS DOUBLE) / 10 AS score, CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN id % 5 = 0 THEN 'manual' ELSE 'auto' END AS method FROM journals UNION ALL SELECT id, 'd', 1, 0.5, 'low', 'auto' FROM journals WHERE id % 6 = 0)"


def _area_rows(t):
    j = t(J)
    base = j.selectExpr("id AS journal_id", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS area", "CAST(id % 2 AS INT) AS is_primary", "CAST(id % 7 AS DOUBLE) / 10 AS score", "CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence", "CASE WHEN id % 5 = 0 THEN 'manual' ELSE 'auto' END AS method")
    return base.unionByName(j.where("id % 6 = 0").selectExpr("id AS journal_id", "'d' AS area", "1 AS is_primary", "0.5D AS score", "'low' AS confidence", "'auto' AS method"))


@query("a57_confidence", f""", {_FAM}, {_AR}, v AS (SELECT DISTINCT fid FROM {I} JOIN fam ON fam.id = qualis_journal_id WHERE item_type = 'ARTIGO'), p AS (SELECT journal_id, confidence, row_number() OVER (PARTITION BY journal_id ORDER BY CAST(method <> 'manual' AS INT), area) AS n FROM ar WHERE is_primary = 1)
 SELECT coalesce(confidence, 'none') AS confidence, count(*) AS families FROM v LEFT JOIN p ON journal_id = fid AND n = 1 GROUP BY 1""", I, J)
def _(t, s, d):
    return journals.confidence_report(t(I), t(J), _area_rows(t))


@query("a49_area_chips", f""", {_FAM}, {_AR}, tx(area, name, o) AS (VALUES ('a', 'Artes', 3), ('b', 'Bio', 1), ('c', 'Civil', 2), ('d', 'Direito', 0))
 SELECT fid, string_agg(name, ', ' ORDER BY is_primary DESC, score DESC, o, name) AS areas FROM ar JOIN fam ON fam.id = journal_id AND fid = id JOIN tx ON tx.area = ar.area GROUP BY 1""", J)
def _(t, s, d):
    return journals.area_chips(t(J), _area_rows(t), s.createDataFrame([("a", "Artes", 3), ("b", "Bio", 1), ("c", "Civil", 2), ("d", "Direito", 0)], "slug string, name string, sort_order int"))


@query("b8_family_articles", f", {_FAM} SELECT fid, count(DISTINCT {K3}) AS articles FROM {I} JOIN fam ON fam.id = qualis_journal_id WHERE item_type = 'ARTIGO' GROUP BY 1", I, J)
def _(t, s, d):
    j = journals.with_family(t(J)).select(F.col("id").alias("qualis_journal_id"), "fid")
    return t(I).where("item_type = 'ARTIGO'").select("qualis_journal_id", keys.article_key().alias("k")).join(j, "qualis_journal_id").select("fid", "k").distinct().groupBy("fid").agg(F.count(F.lit(1)).alias("articles"))


@query("w2_group_sizes", f"SELECT id, count(*) OVER (PARTITION BY coalesce(CASE WHEN {N1('name')} <> '' THEN sha1({N1('name')} || '|' || coalesce(CAST(start_year AS VARCHAR), '')) END, '#' || CAST(id AS VARCHAR))) AS records FROM {P}", P)
def _(t, s, d):
    return projects.grouped(t(P)).select("id", "records")


@query("w3_first_degrees", f"SELECT researcher_id, level, institution_name FROM (SELECT *, row_number() OVER (PARTITION BY researcher_id, level ORDER BY start_year ASC NULLS FIRST, id) AS p FROM educations) WHERE p = 1", "educations")
def _(t, s, d):
    e = t("educations")
    return e.groupBy("researcher_id", "level").agg(F.min_by("institution_name", F.struct(F.col("start_year").isNotNull().alias("a"), "start_year", "id")).alias("institution_name"))


@query("t11_unions", f"SELECT year, count(*) AS rows FROM (SELECT year FROM {I} UNION ALL SELECT year FROM {O}) GROUP BY 1", I, O)
def _(t, s, d):
    return t(I).select("year").unionByName(t(O).select("year")).groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


@query("t12_sets", f"SELECT researcher_id FROM {I} INTERSECT SELECT researcher_id FROM {O} EXCEPT SELECT researcher_id FROM {KA} WHERE area IS NULL", I, O, KA)
def _(t, s, d):
    return t(I).select("researcher_id").intersect(t(O).select("researcher_id")).subtract(t(KA).where("area IS NULL").select("researcher_id"))


@query("d3_calendar", f"SELECT CAST(y AS INT) AS year, count(o.id) AS concluded FROM range(1980, {YEAR + 1}) c(y) LEFT JOIN {O} o ON year = y AND {DONE} GROUP BY 1", O)
def _(t, s, d):
    n = t(O).where(keys.concluded()).groupBy("year").agg(F.count(F.lit(1)).alias("concluded"))
    return s.range(1980, YEAR + 1).select(F.col("id").cast("int").alias("year")).join(n, "year", "left").fillna(0)


@query("d5_percentages", f"SELECT item_type, CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(round(CAST(100.0 * count(*) FILTER (WHERE {HASQ}) / count(*) AS DECIMAL(28, 10)), 1) AS DOUBLE) END AS percent FROM {I} GROUP BY 1", I)
def _(t, s, d):
    n = t(I).groupBy("item_type").agg(F.sum(keys.has_qualis().cast("int")).alias("a"), F.count(F.lit(1)).alias("b"))
    return n.select("item_type", figures.share(F.col("a"), F.col("b")).alias("percent"))


@query("d7_epsilon", "SELECT p_partkey AS id, CAST(p_partkey % 10 AS DOUBLE) / 10 * 3 + 1e-9 >= 0.3 * 3 AS reached FROM part")
def _(t, s, d):
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 10).cast("double") / 10 * 3 + areas.EPS >= 0.3 * 3).alias("reached"))


@query("m4_databases_json", f"SELECT journal_id, '[' || string_agg(CAST(database_id AS VARCHAR), ',' ORDER BY database_id) || ']' AS databases FROM (SELECT DISTINCT * FROM {L}) GROUP BY 1", L)
def _(t, s, d):
    return t(L).groupBy("journal_id").agg(F.to_json(F.array_sort(F.collect_set("database_id"))).alias("databases"))


@query("m5_filled_counts", f"SELECT researcher_id, {_c(chr(113) + 'ualis = ' + repr('A1'), 'a1')}, {_c('qualis = ' + repr('B1'), 'b1')}, {_c('qualis = ' + repr('ZZ'), 'zz')} FROM {I} GROUP BY 1", I)
def _(t, s, d):
    return t(I).groupBy("researcher_id").pivot("qualis", ["A1", "B1", "ZZ"]).count().fillna(0).withColumnsRenamed({"A1": "a1", "B1": "b1", "ZZ": "zz"})


@query("n25_work_key", f"SELECT id, {K1} AS key FROM {I} WHERE item_type = 'LIVRO'", I)
def _(t, s, d):
    return prepared(t(I)).where("item_type = 'LIVRO'").select("id", F.col("work").alias("key"))


# --- files: written from a table and read back ---
@query("z1_csv_round_trip", f"SELECT CAST(id AS VARCHAR) AS id, full_name, coalesce(department, '') AS department FROM {R}", R)
def _(t, s, d):
    path = new_path(s, "csv")
    sinks.write_table(t(R).select("id", "full_name", "department"), path, "csv")
    back = s.read.csv(path, header=True, sep=";")
    return back.toDF(*(c.lstrip("﻿") for c in back.columns)).select("id", "full_name", F.coalesce("department", F.lit("")).alias("department"))


@query("z4_json_round_trip", f"SELECT id, title, qualis FROM {J}", J)
def _(t, s, d):
    path = new_path(s, "json")
    sinks.write_table(t(J).select("id", "title", "qualis"), path, "json")
    return s.read.schema("id long, title string, qualis string").json(path)


@query("s23_copied_tables", f"SELECT id, upper(title) AS title FROM {J}", J)
def _(t, s, d):
    path = new_path(s, "copy")
    sinks.copy_tables(s, t, {J: lambda df: df.select("id", F.upper("title").alias("title")), R: lambda df: df}, path)
    return s.read.parquet(f"{path}/{J}")


@query("z9_swapped_versions", f"SELECT qualis, count(*) AS n FROM {J} GROUP BY 1", J)
def _(t, s, d):
    path = new_path(s, "swap")
    sinks.swap(s, lambda p: t(J).limit(0).write.parquet(p), path, "1")
    sinks.swap(s, lambda p: t(J).write.parquet(p), path, "2")
    return s.read.parquet(sinks.current(s, path)).groupBy("qualis").agg(F.count(F.lit(1)).alias("n"))


@query("z7_evidence_artifact", "SELECT 'part' AS src, CAST(p_partkey AS VARCHAR) AS rec, p_name AS title FROM part")
def _(t, s, d):
    path = new_path(s, "artifact")
    rows = s.read.parquet(f"{d}/part.parquet").selectExpr("'part' AS src", "CAST(p_partkey AS STRING) AS rec", "p_name AS title")
    sinks.write_evidence(rows, path, '{"version": 1}')
    return s.read.schema("src string, rec string, title string, _meta string").json(path).where("_meta IS NULL").select("src", "rec", "title")


@query("z10_link_snapshot", f"SELECT id, qualis_journal_id FROM {I}", I)
def _(t, s, d):
    path = new_path(s, "snapshot")
    curation.write_snapshot(t(I).select("id", "qualis_journal_id"), path)
    return s.read.schema("id long, qualis_journal_id long").json(path)


_ISSN_SQL = "(SELECT p_partkey, p_name, p_type, d, substr(d, 1, 4) || '-' || substr(d, 5, 3) || CASE c WHEN 10 THEN 'X' ELSE CAST(c AS VARCHAR) END AS issn FROM (SELECT *, (11 - list_sum(list_transform(range(1, 8), lambda i: (9 - i) * CAST(d[i] AS INT))) % 11) % 11 AS c FROM (SELECT *, lpad(CAST(p_partkey * 977 % 10000000 AS VARCHAR), 7, '0') AS d FROM part)))"


def _numbered(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type", F.expr("lpad(CAST(p_partkey * 977 % 10000000 AS STRING), 7, '0')").alias("d"))
    total = sum(((8 - i) * F.substring("d", i + 1, 1).cast("int") for i in range(7)), F.lit(0))
    c = (F.lit(11) - total % 11) % 11
    return p.withColumn("issn", F.concat(F.substring("d", 1, 4), F.lit("-"), F.substring("d", 5, 3), F.when(c == 10, "X").otherwise(c.cast("string"))))


@query("s12_doaj", f"SELECT 'u' || CAST(p_partkey AS VARCHAR) AS rec, issn, p_name AS title, p_type || '/x' AS labels FROM {_ISSN_SQL}")
def _(t, s, d):
    path = new_path(s, "doaj")
    _numbered(s, d).select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("URL in DOAJ"), F.col("issn").alias("Journal ISSN (print version)"), F.lit("bad").alias("Journal EISSN (online version)"), F.col("p_name").alias("Journal title"), F.concat("p_type", F.lit(" | x|"), "p_type").alias("Subjects")).write.option("header", True).csv(path)
    return readers.doaj(s, path).select("rec", F.get("issns", 0).alias("issn"), "title", F.array_join("labels", "/").alias("labels"))


@query("s13_latindex", f"SELECT CAST(p_partkey AS VARCHAR) AS rec, issn, p_name AS title, 'a/' || p_type AS labels FROM {_ISSN_SQL}")
def _(t, s, d):
    path = new_path(s, "latindex")
    rows = _numbered(s, d).select(F.col("p_partkey").cast("string").alias("﻿folio_u"), F.lit("").alias("issn_e"), F.col("issn").alias("issn_l"), F.lit("").alias("issn_imp"), F.col("p_name").alias("tit_propio"), F.concat(F.lit("a, "), "p_type").alias("subtemas"))
    rows.write.option("header", True).option("sep", ";").csv(path)
    return readers.latindex(s, path).select("rec", F.get("issns", 0).alias("issn"), "title", F.array_join("labels", "/").alias("labels"))


@query("s14_pubmed", f"SELECT 'n' || CAST(p_partkey AS VARCHAR) AS rec, issn, p_name AS title FROM {_ISSN_SQL}")
def _(t, s, d):
    path = new_path(s, "pubmed")
    block = F.concat(F.lit("-" * 40 + "\nJrId: 1\nJournalTitle: "), F.col("p_name"), F.lit("\nISSN (Print): \nISSN (Online): "), F.col("issn"), F.lit("\nNlmId: n"), F.col("p_partkey").cast("string"))
    _numbered(s, d).select(block.alias("value")).write.text(path)
    return lists.pubmed(s, path).select("rec", F.get("issns", 0).alias("issn"), "title")


@query("s18_openalex", f"SELECT CAST(p_partkey AS VARCHAR) AS rec, issn, p_name AS title, '27:0.75/33:0.25' AS labels FROM {_ISSN_SQL} WHERE p_partkey % 3 <> 0")
def _(t, s, d):
    path = new_path(s, "openalex")
    topic = lambda n, c: F.struct(F.lit(n).cast("long").alias("count"), F.struct(F.lit(f"https://x/subfields/{c}").alias("id")).alias("subfield"))
    rows = _numbered(s, d).select(F.col("p_partkey").cast("string").alias("id"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'repository' ELSE 'journal' END").alias("type"), F.col("p_name").alias("display_name"), F.array("issn").alias("issn"), F.lit(5).cast("long").alias("works_count"), F.array(topic(1, 33), topic(2, 27), topic(1, 27)).alias("topics"))
    rows.write.option("compression", "gzip").json(path)
    return readers.openalex(s, path).select("rec", F.get("issns", 0).alias("issn"), "title", F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["code"], x["share"].cast("string"))), "/").alias("labels"))


@query("s19_title_list", "SELECT 'T' || CAST(p_partkey AS VARCHAR) AS title, p_name AS area FROM part")
def _(t, s, d):
    path = new_path(s, "titles")
    s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("Full Title"), F.col("p_name").alias("Subject area")).write.option("header", True).option("sep", ";").csv(path)
    return lists.title_list(s, path).select("title", "area")


@query("s21_thesaurus_csv", f"SELECT title AS header, display_title AS variant FROM {J} WHERE display_title <> ''", J)
def _(t, s, d):
    path = new_path(s, "thesaurus")
    t(J).where("display_title <> ''").select(F.col("title").alias("header"), F.col("display_title").alias("variant")).write.option("header", True).csv(path)
    return lists.thesaurus(s, path).select("header", F.explode("variants").alias("variant")).distinct()


SQL["s21_thesaurus_csv"] = SQL["s21_thesaurus_csv"].replace("SELECT title AS header", "SELECT DISTINCT title AS header")


@query("z3_bibtex", f"SELECT id, '@' || CASE item_type WHEN 'ARTIGO' THEN 'article' WHEN 'LIVRO' THEN 'book' WHEN 'CAPITULO' THEN 'incollection' WHEN 'EVENTO' THEN 'inproceedings' ELSE 'misc' END || '{{Owner' || coalesce(CAST(year AS VARCHAR), '') || '_' || CAST(id AS VARCHAR) AS head FROM {I}", I)
def _(t, s, d):
    x = t(I).select("id", F.lit("Owner").alias("owner"), "item_type", "title", "year", F.array(F.lit("A"), F.lit("B")).alias("authors"), "journal_name", F.lit("1-9").alias("pages"), "doi")
    return sinks.bibtex(x).select("id", F.regexp_extract("entry", r"^([^,]*)", 1).alias("head"))

