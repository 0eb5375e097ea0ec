"""The domain tables over the driver's tables.

Each domain table is one projection of one driver table, written once in expressions that Spark and DuckDB both read:
`load` gives DataFrames, `WITH` the same as SQL. Nothing is joined here, so columns that a query doesn't use are pruned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .filters import prepared
from .storage import new_path

_TYPES = ["ARTIGO", "LIVRO", "CAPITULO", "EVENTO", "TEXTO_JORNAL", "TRABALHO_TECNICO", "OUTRA_TECNICA", "SOFTWARE", "PATENTE", "MARCA", "PRODUCAO_ARTISTICA", "OUTRA", "ARTIGO", "ARTIGO"]
_STRATA = ["A1", "A2", "A3", "A4", "B1", "B2", "B3", "B4", "C"]
_LEVELS = ["MESTRADO", "DOUTORADO", "POS_DOUTORADO", "INICIACAO_CIENTIFICA", "TCC_GRADUACAO", "ESPECIALIZACAO", "OUTRA"]


def _pick(x: str, values: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE ({x}) % {len(values)} {cases} END"


_TITLES = ["Educação Básica", "educacao basica", "Gênero e Trabalho", "Redes Neurais em Educação", "A Política Pública", "Ensino de Física"]
_ORDER = "CAST(l_orderkey AS STRING)"

#: name: (driver table, column: expression)
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "researchers": ("supplier", {
        "id": "s_suppkey", "full_name": "s_name",
        "department_code": _pick("s_suppkey", ["DCSo", "CS", "DL", "DPsi", "DFil", None, ""]), "department": "concat('Departamento ', CAST(s_nationkey % 6 AS STRING))",
        "status": "CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1 END", "admission_year": "CAST(1980 + s_suppkey % 40 AS INT)", "leave_year": "CASE WHEN s_suppkey % 5 = 0 THEN CAST(2000 + s_suppkey % 30 AS INT) END",
        "last_indexed_at": "CASE WHEN s_suppkey % 4 <> 0 THEN '2026-01-01' END",
        "birth_state": "CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE concat('UF', CAST(s_nationkey AS STRING)) END",
    }),
    "production_items": ("lineitem", {
        "id": "l_orderkey * 8 + l_linenumber", "researcher_id": "l_suppkey", "item_type": _pick("l_orderkey", _TYPES),
        "year": "CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE CAST(1990 + l_orderkey % 31 AS INT) END",
        "doi": f"CASE l_orderkey % 3 WHEN 0 THEN concat(' 10.5555/O', {_ORDER}) WHEN 1 THEN '' END",
        "title": f"concat({_pick('l_orderkey + l_linenumber % 2', _TITLES)}, ' ', CAST(l_orderkey % 2000 AS STRING))",
        "qualis": _pick("l_partkey", [*_STRATA, None, ""]), "isbn": "CASE WHEN l_orderkey % 5 = 0 THEN concat('978', CAST(l_orderkey % 300 AS STRING)) ELSE '' END",
        "journal_name": "CASE WHEN l_partkey % 6 <> 0 THEN concat('Revista ', CAST(l_partkey % 60 AS STRING)) END", "event_name": "CASE WHEN l_partkey % 6 = 0 THEN concat('Evento ', CAST(l_partkey % 7 AS STRING)) ELSE '' END", "publisher": "'Editora'",
        "keywords_text": _pick("l_orderkey + l_partkey", ["gênero; educação", "Educação Básica", None, "redes neurais", "física, ensino"]), "qualis_journal_id": "CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END",
        "extra_data": _pick("l_orderkey + l_partkey", ['{"keywords":["gênero","Educação Básica",5,null,"ab"]}', '{"keywords":"texto"}', None, '{"publisher":"x"}', '{"keywords":["redes neurais"," Física. "]}']),
        "indexed_databases": "concat('[{\"acronym\":\"B', CAST(l_partkey % 4 AS STRING), '\"},{\"acronym\":\"B', CAST(l_partkey % 3 AS STRING), '\"}]')",
    }),
    "production_authors": ("lineitem", {
        "production_item_id": "l_orderkey * 8 + 1", "author_name": "concat('AUTOR ', CAST(l_suppkey % 45 AS STRING))", "author_order": "l_linenumber",
        "matched_researcher_id": "CASE WHEN l_suppkey % 6 <> 0 THEN l_suppkey END", "item_key": "l_orderkey % 4000", "is_indexed": "l_linenumber % 2 = 0", "is_own_researcher": "l_suppkey % 6 <> 0", "author_identity_id": "CASE WHEN l_suppkey % 6 = 0 AND l_suppkey % 4 = 0 THEN l_suppkey % 45 END",
    }),
    "orientations": ("orders", {
        "id": "o_orderkey", "researcher_id": "o_custkey % 100 + 1", "orientation_type": _pick("o_orderkey", _LEVELS), "nature": _pick("o_custkey", ["CONCLUIDA", "EM_ANDAMENTO", "CONCLUIDA"]),
        "handle": "CASE WHEN o_orderkey % 7 = 0 THEN concat('h/', CAST(o_orderkey AS STRING)) END", "title": f"concat({_pick('o_orderkey', _TITLES)}, ' ', CAST(o_orderkey % 900 AS STRING))",
        "year": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(1965 + o_orderkey % 62 AS INT) END", "course_name": _pick("o_custkey", [" Educação ", "", "Psicologia", None, "Engenharia Química"]), "program": _pick("o_orderkey", ["PPGE", "PPGPsi"]),
        "student_name": "concat('Aluno ', CAST(o_custkey AS STRING))", "keywords": _pick("o_orderkey", ["educação; gênero", None, "trabalho, política"]),
        "alternative_title": f"CASE WHEN o_orderkey % 4 = 0 THEN concat({_pick('o_orderkey', ['Gender and Work', 'Redes Neurais', 'Teoria do Estado Novo'])}, ' ', CAST(o_orderkey % 40 AS STRING)) WHEN o_orderkey % 4 = 1 THEN '' END",
    }),
    "knowledge_areas": ("customer", {
        "researcher_id": "c_custkey % 100 + 1", "major_area": _pick("c_custkey", ["CIENCIAS_HUMANAS", "Ciências Humanas", "ENGENHARIAS", "Engenharias", ""]), "area": _pick("c_nationkey", ["Educação", "Sociologia", None, "Engenharia Civil"]),
    }),
    "educations": ("customer", {
        "id": "c_custkey", "researcher_id": "c_custkey % 100 + 1", "level": _pick("c_custkey", ["GRADUACAO", "MESTRADO", "DOUTORADO", "GRADUACAO"]),
        "course_name": _pick("c_nationkey", ["Licenciatura em Pedagogia", "Engenharia Mecânica", "Educação Física", "Física", "Direito", "Teatro Popular", None]), "institution_name": _pick("c_nationkey", ["USP", "UNICAMP", "UNESP", "UFMG", "Exterior - X", "UEL"]),
        "start_year": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(1970 + c_custkey % 45 AS INT) END",
    }),
    "experiences": ("customer", {
        "id": "c_custkey", "researcher_id": "c_custkey % 100 + 1", "institution_name": _pick("c_custkey", ["Universidade A", "Universidade B", "Empresa C", "Revista D", "Universidade Sede"]), "contract_type": _pick("c_nationkey", ["Servidor Público", "Bolsista", "", None, "Professor visitante"]),
        "start_year": "CAST(1990 + c_custkey % 35 AS INT)", "end_year": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(2000 + c_custkey % 25 AS INT) END", "is_current": "c_custkey % 3 = 0",
    }),
    "projects": ("orders", {
        "id": "o_orderkey", "researcher_id": "o_custkey % 100 + 1", "name": _pick("o_orderkey", ["Projeto Água", "PROJETO AGUA!", "Rede de Saúde", "", "Memória e Cidade"]), "status": _pick("o_custkey", ["EM_ANDAMENTO", "CONCLUIDO", "DESATIVADO"]), "nature": _pick("o_custkey", ["PESQUISA", "EXTENSAO"]),
        "start_year": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(1995 + o_orderkey % 25 AS INT) END", "end_year": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(2000 + o_orderkey % 25 AS INT) END", "description": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('d', CAST(o_orderkey % 1000 AS STRING)) END",
        "is_coordinator": "o_custkey % 4 = 0",
    }),
    "journals": ("part", {
        "id": "p_partkey", "title": "concat('Revista ', p_name, ' ', p_brand)", "issn": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(CAST(1000 + p_partkey % 9000 AS STRING), '-', CAST(1000 + p_size AS STRING)) END",
        "qualis": "CASE WHEN p_size % 10 = 9 THEN NULL " + " ".join(f"WHEN p_size % 10 = {i} THEN '{s}'" for i, s in enumerate(_STRATA)) + " END",
        "canonical_journal_id": "CASE WHEN p_partkey % 3 = 0 AND p_partkey > 3 THEN p_partkey - 1 END", "display_title": "CASE WHEN p_partkey % 7 = 0 THEN concat('R. ', p_name) ELSE '' END", "area": "p_type",
    }),
    "journal_databases": ("part", {"journal_id": "p_partkey", "database_id": "CAST(1 + p_size % 5 AS INT)"}),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table."""
    source, columns = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(f"{e} AS `{c}`" for c, e in columns.items()))


_made: dict[tuple[str, str, str], str] = {}


def folder_state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input's files, so that what was made from other ones isn't taken for it."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen, folders = [], [top]
    while folders:
        for x in fs.listStatus(folders.pop()):
            if x.isDirectory():
                folders.append(x.getPath())
            else:
                seen.append(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    """The path that `make` filled in the shared folder, made once for each application and state of the input: what the domain keeps as stored tables."""
    key = (spark.sparkContext.applicationId, folder_state(spark, sf_dir), name)
    if key not in _made:
        path = new_path(spark, name)
        make(path)
        _made[key] = path
    return _made[key]


def prepared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """production_items with the work's key and the folded columns that search reads, stored once."""
    path = once(spark, sf_dir, "prepared-items", lambda p: prepared(load(spark, sf_dir, "production_items")).write.option("compression", "zstd").parquet(p))
    return spark.read.parquet(path)


def with_sql(*names: str) -> str:
    """WITH clause of domain tables, for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in TABLES[n][1].items()) + f" FROM {TABLES[n][0]})" for n in names)
