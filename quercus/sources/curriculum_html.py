"""Curricula as web pages, into the same rows as those in XML (inventory S9).

A page is a list of cells under headings. `cells` reads each page once, where it lies, as a stream of tags: a small machine knows which
section and heading is open and gives out one row a cell. What a cell means is told by columns: `nodes` puts the rows of every section
into the form of `curriculum.nodes`, whose functions then make the child tables.

Where the page says less than the file the fields are empty: no codes, no numbers of other people. A `<br>` ends a line. A curriculum's
number is that of its address; a page without one gives no rows. A work that several cells hold (a block and the cell in it) is one, told
by type, year, title and authors; the last author is without the dot before the title. Cells of under ten characters are no works. Nested or unclosed elements end with what holds them.
A year is the one that is said of the work, behind its title (the original takes the first number that looks like one, also from the title or the name of a student or book).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

CELLS = "curriculum_id string, pos int, kind string, heading string, sub string, near string, label string, institution int, nth int, articles boolean, in_item boolean, text string, bold string, before_bold string, doi string"
_COLUMNS = [c.split(" ")[0] for c in CELLS.split(", ")]
# Classes of the page's cells, and elements that have no end.
KINDS = {"title-wrapper": "title", "cita-artigos": "sub", "data-cell": "data", "layout-cell-3": "label", "layout-cell-9": "detail", "layout-cell-11": "item", "artigo-completo": "item", "layout-cell-pad-5": "pad", "inst_back": "institution", "header": "header"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Open:
    """An open element: what it is, where it began, and the texts seen since."""

    def __init__(self, tag: str, kind: str | None, pos: int, name: str = "") -> None:
        self.tag, self.kind, self.pos, self.name = tag, kind, pos, name
        self.parts: list[str] = []
        self.bold: str | None = None
        self.before_bold = ""
        self.doi = ""
        self.heading = self.near = self.sub = ""
        self.id_articles = False

    def text(self) -> str:
        return "".join(self.parts)


class _Machine(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.pos = self.data_of = self.institution = self.nth = 0
        self.section = ""  # the heading of the open section, once its data cell has begun
        self.title: tuple[int, str] = (0, "")  # the last title and its place
        self.near: tuple[int, str] = (0, "")  # the last heading or named anchor that is over
        self.sub: tuple[int, str] = (0, "")
        self.label = ""
        self.rows: list[dict] = []
        self.facts: dict[str, str] = {}

    # --- the page's tags ---
    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        href = a.get("href", "")
        if tag == "br":
            return self.handle_data("\n")
        if tag == "input" and a.get("name") == "id" and re.fullmatch(r"\d{16}", a.get("value", "").strip()):
            self.facts.setdefault("number", a["value"].strip())
        if tag == "a" and (m := re.search(r"orcid\.org/.*?\b(\d{4}-\d{4}-\d{4}-[\dX]{4})\b", href)):
            self.facts.setdefault("orcid", m[1])
        if tag == "a" and ("doi" in href or "icone-doi" in classes) and (m := re.search(r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", href)):
            for x in self.stack:
                x.doi = x.doi or m[0]
        if tag in VOID:
            return
        self.pos += 1
        kind = next((KINDS[c] for c in classes if c in KINDS), None) if tag == "div" else None
        if tag == "h2" and "nome" in classes or tag == "h2" and any(x.kind == "person" for x in self.stack):
            kind = "name"
        elif tag == "div" and ("infpessoa" in classes or "informacoes-autor" in classes):
            kind = "person"
        elif any("resumo" in c for c in classes):
            kind = kind or "resume"
        elif tag in ("li", "span"):
            kind = "line"
        elif tag == "a" and a.get("name"):
            kind = "anchor"
        elif tag == "b":
            kind = "bold"
        new = _Open(tag, kind, self.pos, a.get("name", ""))
        if kind == "anchor":
            for x in self.stack:
                if x.kind == "title":
                    x.name += " " + new.name
        if kind == "bold":
            for x in self.stack:
                if x.bold is None and x.kind in ("item", "pad", "detail"):
                    x.bold, x.before_bold = "", x.text()
        if kind == "data" and not any(x.kind == "data" for x in self.stack):
            inside = next((x for x in self.stack if x.kind == "title"), None)
            at, heading = (inside.pos, f"{inside.text()} {inside.name}") if inside else self.title
            if at != self.data_of:  # only the first data cell after a title is its own
                self.data_of, self.section, self.institution, self.nth, self.label = at, heading, 0, 0, ""
                new.heading = heading
        new.near, new.sub = self.near[1], self.sub[1]
        new.id_articles = a.get("id") == "artigos-completos"
        self.stack.append(new)

    def handle_data(self, data: str) -> None:
        for x in self.stack:
            if x.kind:
                x.parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if any(x.tag == tag for x in self.stack):
            while self.stack:
                top = self.stack.pop()
                self.over(top)
                if top.tag == tag:
                    return

    def finish(self) -> None:
        self.close()
        while self.stack:
            self.over(self.stack.pop())

    # --- what they mean ---
    def over(self, x: _Open) -> None:
        text = x.text().strip()
        in_data = next((d for d in reversed(self.stack) if d.kind == "data" and d.heading), None)
        if x.kind in ("title", "sub", "anchor"):
            said = text or x.name.strip()
            if x.pos > self.near[0]:
                self.near = x.pos, said
            if x.kind != "title" and x.pos > self.sub[0]:
                self.sub = x.pos, f"{text} {x.name}".strip()
            if x.kind == "title":
                self.title = x.pos, f"{text} {x.name}"
        elif x.kind == "bold":
            for o in self.stack:
                if o.bold == "" and o.kind in ("item", "pad", "detail"):
                    o.bold = text
        elif x.kind == "name":
            self.facts.setdefault("name", text)
        elif x.kind == "resume":
            self.facts.setdefault("resume", re.sub(r"\s*\(Texto informado pelo autor\)$", "", " ".join(text.split()), flags=re.I))
        elif x.kind == "line":
            if "Endereço para acessar este CV" in text and (m := re.search(r"\b\d{16}\b", text)):
                self.facts["number"] = m[0]
            if "Última atualização" in text and (m := re.search(r"(\d{2})/(\d{2})/(\d{4})", text)):
                self.facts.setdefault("updated", "".join(m.groups()))
        elif x.kind == "label":
            self.label = text
        elif x.kind == "institution" and in_data:
            self.institution += 1
            self.row(x, text, in_data)
        elif x.kind in ("detail", "item", "pad"):
            if x.kind == "detail":
                self.nth += 1
                for key, word in (("citation", "Nome em citações"), ("nationality", "Nacionalidade"), ("address", "Endereço Profissional")):
                    if word in self.label:
                        self.facts.setdefault(key, text)
            if not any(h.kind == "header" for h in self.stack):
                self.row(x, text, in_data)

    def row(self, x: _Open, text: str, data: _Open | None) -> None:
        self.rows.append({
            "pos": x.pos, "kind": x.kind, "heading": data.heading if data else None, "sub": x.sub, "near": x.near, "label": self.label if x.kind == "detail" else None, "institution": self.institution, "nth": self.nth,
            "articles": any(o.id_articles for o in self.stack), "in_item": any(o.kind == "item" for o in self.stack), "text": text, "bold": x.bold, "before_bold": x.before_bold, "doi": x.doi or None,
        })


def cells(pages: DataFrame, content: str = "content") -> DataFrame:
    """One row a cell of every page, and one of kind `head` whose text is JSON of what stands outside the sections. content: text, or bytes in UTF-8 or Latin-1."""
    types = {"pos": pa.int32(), "institution": pa.int32(), "nth": pa.int32(), "articles": pa.bool_(), "in_item": pa.bool_()}
    schema = pa.schema([(c, types.get(c, pa.string())) for c in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page in b.column(0).to_pylist():
                if page is None:
                    continue
                if isinstance(page, bytes):
                    try:
                        page = page.decode()
                    except UnicodeDecodeError:
                        page = page.decode("latin-1")
                m = _Machine()
                m.feed(page)
                m.finish()
                number = m.facts.get("number") or next(iter(re.findall(r"cnpq\.br/(\d{16})", page)), None)
                if number:
                    rows = [{"pos": 0, "kind": "head", "text": json.dumps(m.facts, ensure_ascii=False)}, *m.rows]
                    yield pa.RecordBatch.from_pylist([{"curriculum_id": number} | r for r in rows], schema)

    return pages.select(content).mapInArrow(run, CELLS)


# --- from cells to nodes ---
def _map(**columns: Column) -> Column:
    """A map of attributes (their names with - for _), without those that are null or empty."""
    m = F.create_map(*(x for k, c in columns.items() for x in (F.lit(k.replace("_", "-")), c)))
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def _get(pattern: str, c: Column | None = None) -> Column:
    return F.trim(F.regexp_extract(F.col("text") if c is None else c, pattern, 1))


def _node(df: DataFrame, section: str | Column, tag: Column | None = None, **parts: Column) -> DataFrame:
    maps, lists = "map<string,string>", "array<map<string,string>>"
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        "curriculum_id", (F.lit(section) if isinstance(section, str) else section).alias("section"), (F.lit("HTML") if tag is None else tag).alias("tag"), F.col("pos").cast("int").alias("pos"),
        *(parts.get(c, F.create_map().cast(maps) if c == "item" else none(maps)).alias(c) for c in ("item", "basic", "detail", "first")), parts.get("authors", F.array().cast(lists)).alias("authors"),
        F.array().cast("array<string>").alias("keywords"), *(parts.get(c, F.array().cast(lists)).alias(c) for c in ("members", "funders")),
    )


YEAR = r"\b((?:19|20)\d{2})\b"
#: A year that is a field of its own, not a page, volume or number.
FIELD = r"(?i)(?:^|(?<!\b(?:pp?|v|vol|n))\.|[,;:(])\s*((?:19|20)\d{2})(?=\s*(?:[.,;()]|$))"
YEARS = r"(?i)\b((?:19|20)\d{2})\s*-\s*((?:19|20)\d{2}|Atual)\b"


def _start_end(c: Column) -> tuple[Column, Column]:
    end = F.regexp_extract(c, YEARS, 2)
    return F.regexp_extract(c, YEARS, 1), F.when(end.rlike(r"^\d"), end)


def _first_said(*found: Column) -> Column:
    """The first that isn't empty, '' if all are."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in found), F.lit(""))


def _last_field(c: Column) -> Column:
    """The last year that is a field of its own."""
    years = F.regexp_extract_all(c, F.lit(FIELD), 1)
    return F.get(years, F.size(years) - 1)


def _by_words(c: Column, rules: list[tuple[str, str]], otherwise: Column | str | None = None) -> Column:
    """The first rule whose words the text has."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for words, value in reversed(rules):
        out = F.when(c.rlike(words), value).otherwise(out)
    return out


def _in_section(c: DataFrame, words: str) -> DataFrame:
    return c.where(F.lower("heading").rlike(words))


# Words that tell a degree, in order; a section of complementary courses has its own level.
DEGREES = [("(?<!pós-)doutorado", "DOUTORADO"), ("p[óo]s-doutorado", "POS-DOUTORADO"), ("mestrado", "MESTRADO"), ("especializa[çc][ãa]o", "ESPECIALIZACAO"), ("aperfeiçoamento", "APERFEICOAMENTO")]
INSTITUTION = "Universidade|Faculdade|Escola|Instituto|UFSCAR|USP|UNESP|UNICAMP|UFMG"


def _educations(c: DataFrame) -> DataFrame:
    d = _in_section(c, "forma[cç][ãa]o|p[óo]s-?doutorado|complementar").where("kind = 'detail' AND text <> ''")
    low = F.lower("text")
    short = F.lower("heading").contains("complementar") | low.rlike("workshop|curta duração|extensão universitária")
    level = F.when(F.lower("heading").rlike("p[óo]s-?doutorado"), F.lit("POS-DOUTORADO")).otherwise(_by_words(low, DEGREES, "GRADUACAO"))
    start, end = _start_end(F.concat_ws(" ", "label", "text"))
    course = F.coalesce(F.nullif(_get(r"(?i)(?:Doutorado|Mestrado|Graduação|Especialização|Pós-Doutorado)\s+em\s+([^.]+)\."), F.lit("")), _get(r"^([^.(]+?)(?:\.|\s*\(|\s*,\s*Ano|$)"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(INSTITUTION))
    item = _map(
        NOME_CURSO=course, NOME_INSTITUICAO=F.coalesce(F.get(lines, 0), F.col("text")), ANO_DE_INICIO=start, ANO_DE_CONCLUSAO=end, TITULO_DA_DISSERTACAO_TESE=F.regexp_replace(_get(r"(?i)Título:\s*([^,<\n]+)"), r"\.$", ""),
        NOME_DO_ORIENTADOR=_get(r"(?i)Orientador:\s*([^.<\n]+)"), CARGA_HORARIA=_get(r"(?i)Carga horária:\s*(\d+)h"), NOME_AGENCIA=_get(r"(?i)Bolsista do\(a\):\s*([^,<\n]+)"),
    )
    return _node(d, F.when(short, "complementary").otherwise("education"), F.when(short, F.lit("FORMACAO-COMPLEMENTAR-CURTA-DURACAO")).otherwise(level), item=item)


def _experiences(c: DataFrame) -> DataFrame:
    x = _in_section(c, "atua[cç][ãa]o ?profissional")
    institutions = x.where("kind = 'institution' AND text <> ''").select("curriculum_id", "institution", F.col("pos").alias("at"), F.col("text").alias("name"))
    when = r"(?i)(?:(\d{2})/)?((?:19|20)\d{2})\s*-\s*(?:(?:(\d{2})/)?((?:19|20)\d{2})|Atual)\b"
    label = F.regexp_replace("label", r"\s+", " ")
    bonds = x.where("kind = 'detail'").where(label.rlike(when)).select(
        "curriculum_id", "institution", "pos",
        _map(
            ANO_INICIO=F.regexp_extract(label, when, 2), MES_INICIO=F.regexp_extract(label, when, 1), ANO_FIM=F.regexp_extract(label, when, 4), MES_FIM=F.regexp_extract(label, when, 3), OUTRO_ENQUADRAMENTO_FUNCIONAL_INFORMADO=_get(r"(?i)Enquadramento Funcional:\s*([^,<\n]+)"),
            OUTRO_VINCULO_INFORMADO=_get(r"(?i)Vínculo:\s*([^,<\n]+)"), CARGA_HORARIA_SEMANAL=_get(r"(?i)Carga horária:\s*(\d+)"), FLAG_DEDICACAO_EXCLUSIVA=F.when(F.lower("text").contains("dedicação exclusiva"), "SIM"),
        ).alias("bond"),
    )
    j = institutions.join(bonds, ["curriculum_id", "institution"], "left").withColumn("pos", F.coalesce("pos", "at"))
    return _node(j, "experience", item=_map(NOME_INSTITUICAO=F.col("name")), basic=F.col("bond"))


def _listed(label: str) -> Column:
    """(name, role) of a list `name - role / name - role` after its label, as an array of structs."""
    part = F.split(F.regexp_extract("about", r"(?is)" + label + r"\s*(.*?)(?:Integrantes:|Financiador\(es\):|Número de produções|Número de orientações|Alunos envolvidos:|$)", 1), "/")
    trimmed = F.filter(F.transform(part, lambda p: F.regexp_replace(F.trim(p), r"[. ]+$", "")), lambda p: p != "")
    return F.transform(trimmed, lambda p: F.struct(F.trim(F.regexp_extract(p, r"(?s)^(.*?)(?: - (?!.* - )(.*))?$", 1)).alias("name"), F.trim(F.regexp_extract(p, r"(?s)^(.*?)(?: - (?!.* - )(.*))?$", 2)).alias("role")))


def _projects(c: DataFrame) -> DataFrame:
    """A project is two cells: its name with the years beside it, and what is said about it."""
    d = _in_section(c, "projetos?").where("kind = 'detail'").withColumn("half", (F.col("nth") - 1) % 2)
    start, end = _start_end(F.col("label"))
    names = d.where("half = 0").select("curriculum_id", "heading", "nth", "pos", "text", start.alias("start"), end.alias("end"))
    said = d.where("half = 1").select("curriculum_id", "heading", (F.col("nth") - 1).alias("nth"), F.col("text").alias("about"))
    j = names.join(said, ["curriculum_id", "heading", "nth"], "left").withColumn("about", F.coalesce("about", F.lit(""))).where("text <> '' OR about <> ''")
    kind = _by_words(F.lower("heading"), [("extens", "EXTENSAO"), ("desenvolvimento", "DESENVOLVIMENTO")], "PESQUISA")
    state = _by_words(F.lower("about"), [("conclu[íi]do", "CONCLUIDO"), ("desativado", "DESATIVADO")], "EM_ANDAMENTO")
    item = _map(
        NOME_DO_PROJETO=F.coalesce(F.nullif("text", F.lit("")), F.lit("Projeto sem título")), NATUREZA=kind, SITUACAO=state, ANO_INICIO=F.col("start"), ANO_FIM=F.col("end"),
        DESCRICAO_DO_PROJETO=_get(r"(?s)Descrição:\s*(.*?)(?:Situação:|Integrantes:|Financiador|$)", F.col("about")), FLAG_COORDENADOR=F.when(F.lower("about").contains("coordenador"), "SIM"),
    )
    members = F.transform(_listed("Integrantes:"), lambda x, i: _map(NOME_COMPLETO=x["name"], ORDEM_DE_INTEGRACAO=(i + 1).cast("string"), FLAG_RESPONSAVEL=F.when(F.startswith(F.lower(x["role"]), F.lit("coordenador")), "SIM").otherwise("NAO")))
    funders = F.transform(_listed(r"Financiador\(es\):"), lambda x, i: _map(NOME_INSTITUICAO=x["name"], NATUREZA=x["role"], SEQUENCIA_FINANCIADOR=(i + 1).cast("string")))
    return _node(j, "project", item=item, members=members, funders=funders)


def _areas(c: DataFrame) -> DataFrame:
    d = _in_section(c, "[áa]reas ?(?:de ?)?atua").where("kind = 'detail' AND text <> ''")
    of = lambda name: F.regexp_replace(_get(rf"(?:^|[/\s])(?iu:{name}):\s*([^/]+)"), r"[.\s]+$", "")
    return _node(d, "area", item=_map(NOME_GRANDE_AREA_DO_CONHECIMENTO=of("grande área"), NOME_DA_AREA_DO_CONHECIMENTO=_area(), NOME_DA_SUB_AREA_DO_CONHECIMENTO=of("subárea"), NOME_DA_ESPECIALIDADE=of("especialidade")))


def _area() -> Column:
    """The area itself: `Área:` at the beginning or after a stroke, not that of `Grande área:`."""
    return F.regexp_replace(_get(r"(?:^|/)\s*(?iu:área):\s*([^/]+)"), r"[.\s]+$", "")


def _languages(c: DataFrame) -> DataFrame:
    d = _in_section(c, "idiomas").where("kind = 'detail' AND label <> ''")
    of = lambda word: _get(rf"(?i){word}\s*([A-Za-zÀ-ÿ]+)")
    return _node(d, "language", item=_map(IDIOMA=F.col("label"), PROFICIENCIA_DE_LEITURA=of("Lê"), PROFICIENCIA_DE_ESCRITA=of("Escreve"), PROFICIENCIA_DE_FALA=of("Fala"), PROFICIENCIA_DE_COMPREENSAO=of("Compreende")))


def _awards(c: DataFrame) -> DataFrame:
    d = _in_section(c, "pr[êe]mios").where("kind = 'detail' AND text <> ''")
    parts = F.split("text", ",")
    return _node(d, "award", item=_map(NOME_DO_PREMIO_OU_TITULO=F.trim(F.get(parts, 0)), NOME_DA_ENTIDADE_PROMOTORA=F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -1))), ANO_DA_PREMIACAO=F.regexp_extract("label", YEAR, 1)))


# Words of headings, or of the anchors' names, that tell what is listed below them, in order; the first rule's are no works.
WORKS = [
    ("forma[cç][aã]o|atua[cç][aã]o|projeto|pr[eê]mio|idioma|[aá]rea|orienta[cç]|banca|cita[cç]", None), ("cap[ií]tulos ?(?:de )?livros", "chapter"), ("livros ?cap[ií]tulos|livros/cap", "book"), ("cap[ií]tulo", "chapter"), ("livro", "book"), ("artigo", "article"),
    ("jornal|revista|not[ií]cia", "newspaper"), ("(?:trabalhos? ?publicado|congresso|anais|resumo|apresenta).*t[eé]cnico|t[eé]cnico.*(?:trabalhos? ?publicado|congresso|anais|resumo|apresenta)", "technical"), ("trabalhos? ?publicado|congresso|anais|resumo|apresenta", "event_work"),
    ("programa.*computador|computador.*programa|software", "SOFTWARE"), ("patente|marca|cultivar", "PATENTE"), ("art[ií]stica|cultural|m[uú]sica|artes", "artistic"),
    ("assessoria|consultoria|t[eé]cnic|redes|website|blog|editora[cç][aã]o|relat[oó]rio|did[aá]tico|curta dura[cç][aã]o|curso ministrado", "technical"), ("bibliogr[aá]fica|outra", "other_work"),
]


def _productions(c: DataFrame) -> DataFrame:
    near = F.lower("near")
    d = c.where("kind = 'item' OR kind = 'pad' AND heading IS NULL").where(F.length("text") >= 10)
    d = d.withColumn("what", F.coalesce(_by_words(near, WORKS), F.when(F.col("articles"), "article"))).where("what IS NOT NULL")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.col("text"), r"^\d+[.)]\s*", ""), r"\s+", " "))
    cut = r"^(.*?)(?:\s+\.\s+|\.\s*\.\s+)(.*)$"
    d = d.withColumn("clean", clean).withColumn("by", F.trim(F.regexp_extract("clean", cut, 1))).withColumn("rest", F.when(F.col("clean").rlike(cut), F.trim(F.regexp_extract("clean", cut, 2))).otherwise(F.col("clean")))
    halves = F.when(F.col("clean").rlike(cut), F.split("rest", r"\.\s+(?=[0-9A-Z]|v\.)", 2)).otherwise(F.array("rest"))
    d = d.withColumn("halves", halves).withColumn("title", F.regexp_replace(F.trim(F.get("halves", 0)), r"\.$", "")).withColumn("rest", F.coalesce(F.trim(F.get("halves", 1)), F.lit("")))
    # Where a work is printed the year ends what is said of that; elsewhere it comes first after the title.
    field = F.when(F.col("what").isin("article", "book", "chapter", "newspaper"), _last_field(F.col("rest"))).otherwise(F.regexp_extract("rest", FIELD, 1))
    d = d.withColumn("year", _first_said(field, F.regexp_extract("rest", YEAR, 1), _last_field(F.col("clean")), F.regexp_extract("clean", YEAR, 1)))
    # The block and the cell in it are one work, as are cells of the same title, year and authors.
    same = Window.partitionBy("curriculum_id", "what", "year", F.lower("title"), F.lower(F.substring("by", 1, 100))).orderBy("pos")
    d = d.withColumn("again", F.row_number().over(same)).where("again = 1")
    what, tag = F.col("what"), F.col("what").isin("SOFTWARE", "PATENTE")
    title = F.substring(F.coalesce(F.nullif("title", F.lit("")), F.lit("Produção Científica/Técnica")), 1, 500)
    nature = F.when(what == "event_work", _by_words(near, [("expandido", "RESUMO_EXPANDIDO"), ("resumo", "RESUMO"), ("apresenta", "APRESENTACAO")], "COMPLETO"))
    house = F.when(what.isin("book", "chapter"), _get(r"[A-Za-zÀ-ÿ .-]+:\s*([A-Za-zÀ-ÿ0-9\s.&-]+),\s*(?:19|20)\d{2}"))
    where = F.when(what == "article", _get(r"^([A-Za-zÀ-ÿ0-9\s&/:()'\"-]+?)(?:,|\.|\sv\.)", F.col("rest"))).when(what == "newspaper", F.trim(F.get(F.split("rest", ","), 0)))
    inside = F.when(what == "chapter", _get(r"In:\s*([^.]+)\."))
    data = _map(TITULO=title, TITULO_DO_ARTIGO=F.when(what == "article", title), TITULO_DO_LIVRO=F.when(what == "book", title), TITULO_DO_CAPITULO_DO_LIVRO=F.when(what == "chapter", title), ANO=F.col("year"), DOI=F.col("doi"), NATUREZA=nature)
    detail = _map(
        TITULO_DO_PERIODICO_OU_REVISTA=where, TITULO_DO_LIVRO=inside, NOME_DO_EVENTO=F.when(what == "event_work", _get(r"In:\s*([^,]+)")), NOME_DA_EDITORA=house, VOLUME=F.when(what.isin("article", "book"), _get(r"(?i)\bv\.\s*([A-Za-z0-9-]+)")),
        FASCICULO=F.when(what == "article", _get(r"(?i),\s*n\.\s*([A-Za-z0-9-]+)")), PAGINA_INICIAL=F.when(what.isin("article", "chapter"), _get(r"(?i)\bp\.\s*([0-9e.-]*[0-9])")),
    )
    names = F.filter(F.transform(F.split("by", ";"), lambda a: F.trim(F.regexp_replace(F.trim(a), r"(?i)\((?:Org|Ed|Coord)\.?\s*\)|^\d+[.)]\s*", ""))), lambda a: F.length(a) >= 2)
    authors = F.transform(names, lambda a, i: _map(ORDEM_DE_AUTORIA=(i + 1).cast("string"), NOME_COMPLETO_DO_AUTOR=a, NOME_PARA_CITACAO=a))
    technical = F.when(near.rlike("assessoria|consultoria"), "ASSESSORIA").otherwise("TRABALHO_TECNICO")
    return _node(d, F.when(tag, "technical").otherwise(what), F.when(tag, what).when(what == "technical", technical), basic=data, first=data, detail=detail, authors=authors)


# Words that tell an orientation's type, in order, with the tag or nature that the tables read.
ORIENTATIONS = [("doutorado", "DOUTORADO"), ("mestrado", "MESTRADO"), ("inicia[çc][ãa]o|pibic", "INICIACAO"), ("gradua[çc][ãa]o|conclus[ãa]o de curso|tcc", "GRADUACAO"), ("especializa[çc][ãa]o|aperfeiçoamento", "ESPECIALIZACAO")]
SCHOOL = r"-\s*([A-Za-zÀ-ÿ\s./-]+?)(?:,|\.\s|\.$|$)"


def _listed_items(c: DataFrame, words: str) -> DataFrame:
    """The items of a section: cells of their own, or paddings that are in none; not too short."""
    return _in_section(c, words).where("kind = 'item' OR kind = 'pad' AND NOT in_item").where(F.length("text") >= 10).withColumn("clean", F.regexp_replace("text", r"^\d+[.)]\s*", ""))


# Words that stand after the year of a thesis.
THESES = r"(?i)\b((?:19|20)\d{2})\.\s*(?:disserta|tese|monografia|trabalho|relat|inicia|orienta|supervis|exame)"


def _thesis_year() -> Column:
    """The year behind the title, which is bold; without one, that before the kind of thesis, that of the beginning, or a field after the first name."""
    bold, start = F.coalesce("bold", F.lit("")), F.length(F.regexp_replace(F.coalesce("before_bold", F.lit("")), r"(?U)^\s+", "")) + 1
    at = F.position(bold, F.col("text"), start)
    after = F.when((bold != "") & (at > 0), F.col("text").substr(at + F.length(bold), F.length("text")))
    named = F.regexp_extract("clean", r"(?s)^[^.]*(\..*)$", 1)
    return _first_said(F.regexp_extract(after, FIELD, 1), F.regexp_extract("clean", THESES, 1), F.regexp_extract("clean", r"(?i)in[íi]cio:\s*((?:19|20)\d{2})\b", 1), F.regexp_extract(after, YEAR, 1), F.regexp_extract(named, FIELD, 1), F.regexp_extract("text", YEAR, 1))


def _orientations(c: DataFrame) -> DataFrame:
    d = _listed_items(c, "orienta[çc]")
    sub, low = F.lower("sub"), F.lower("text")
    stated = F.when(sub.contains("concluid"), "concluded").when(sub.contains("andamento"), "ongoing").when(low.rlike(r"in[íi]cio:\s*(?:19|20)\d{2}"), "ongoing").when(low.rlike(r"\b(?:19|20)\d{2}\.\s*(?:disserta|tese|monografia|trabalho|relat)") | low.contains("orientador:"), "concluded")
    section = F.coalesce(stated, F.when(F.lower("heading").contains("andamento"), "ongoing").otherwise("concluded"))
    halves = F.split("clean", r"\.", 2)
    bold = F.coalesce("bold", F.lit("")) != ""
    student = F.when(bold, F.regexp_replace(F.trim(F.regexp_replace(F.trim("before_bold"), r"^\d+[.)]\s*", "")), r"\.$", "")).otherwise(F.trim(F.get(halves, 0)))
    title = F.when(bold, F.col("bold")).otherwise(F.trim(F.coalesce(F.get(halves, 1), F.col("clean"))))
    kind = _by_words(F.concat_ws(" ", sub, low), ORIENTATIONS, "OUTRA")
    basic = _map(NATUREZA=kind, TITULO=F.substring(title, 1, 500), ANO=_thesis_year())
    return _node(d, section, basic=basic, detail=_map(NOME_DO_ORIENTADO=F.coalesce(F.nullif(student, F.lit("")), F.lit("Orientando")), NOME_DA_INSTITUICAO=_get(SCHOOL)))


def _boards(c: DataFrame) -> DataFrame:
    d = _listed_items(c, "banca")
    kind = _by_words(F.lower(F.concat_ws(" ", "text", "heading")), [("doutorado", "DOUTORADO"), ("qualifica[çc][ãa]o", "QUALIFICACAO"), ("(?<!pós-)gradua[çc][ãa]o|tcc", "GRADUACAO"), ("concurso|comiss[õãao]+e?s? julgadoras?", "CONCURSO")], "MESTRADO")
    title = F.substring(F.coalesce(F.nullif("bold", F.lit("")), F.col("clean")), 1, 500)
    return _node(d, "board", kind, basic=_map(TITULO=title, ANO=_thesis_year()), detail=_map(NOME_DO_CANDIDATO=_get(r"(?i)banca\s+(?:examinadora\s+)?de\s+([^.]+?)(?:\.|$)"), NOME_DA_INSTITUICAO=_get(SCHOOL)))


def _participations(c: DataFrame) -> DataFrame:
    d = _listed_items(c, "eventos?")
    kind = F.translate(F.upper(_get(r"(?i)\((Congresso|Simpósio|Seminário|Encontro|Oficina|Outro)\)")), "ÓÁ", "OA")
    mode = F.when(F.lower("heading").rlike("organiza|organizou"), "ORGANIZACAO").otherwise("PARTICIPACAO")
    return _node(d, "participation", kind, basic=_map(ANO=_first_said(_last_field(F.col("clean")), F.regexp_extract("text", YEAR, 1)), TIPO_PARTICIPACAO=mode), detail=_map(NOME_DO_EVENTO=F.substring("clean", 1, 500)))


def _head(c: DataFrame) -> DataFrame:
    h = c.where("kind = 'head'")
    of = lambda name: F.trim(F.get_json_object("text", f"$.{name}"))
    address = F.regexp_replace(of("address"), r"\s+", " ")
    city = r"([A-Za-zÀ-ÿ\s-]+),\s*([A-Z]{2})\s*-\s*Brasil"
    first = _map(
        NOME_COMPLETO=F.substring(of("name"), 1, 255), NOME_EM_CITACOES_BIBLIOGRAFICAS=of("citation"), ORCID_ID=of("orcid"), PAIS_DE_NACIONALIDADE=F.substring(of("nationality"), 1, 50), TEXTO_RESUMO_CV_RH=of("resume"), ENDERECO_PROFISSIONAL=F.substring(address, 1, 255),
        CEP=F.regexp_extract(address, r"(\d{5}-?\d{3})", 1), TELEFONE=F.trim(F.regexp_extract(address, r"(?i)Telefone:\s*([^<\n,]+)", 1)), CIDADE=F.trim(F.regexp_replace(F.regexp_extract(address, city, 1), r"^[\s-]+", "")), UF=F.regexp_extract(address, city, 2), PAIS=F.when(address.rlike(city), "Brasil"),
    )
    return _node(h, "head", item=_map(DATA_ATUALIZACAO=of("updated")), first=first)


def nodes(pages: DataFrame, content: str = "content") -> DataFrame:
    """The rows of all sections of all pages in the form of the XML reader's. The cells are stored, as every section reads them."""
    c, _ = stored(cells(pages, content), "curriculum-cells")
    out = _head(c)
    for part in (_educations, _experiences, _projects, _areas, _languages, _awards, _productions, _orientations, _boards, _participations):
        out = out.unionByName(part(c))
    return out


def stored_nodes(pages: DataFrame, content: str = "content") -> tuple[DataFrame, str]:
    """The same, written out once for the tables that are made of them, with their path."""
    return stored(nodes(pages, content), "curriculum-nodes")


def files(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of all page files under path."""
    return nodes(spark.read.format("binaryFile").load(path).select("content"))

