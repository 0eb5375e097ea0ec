"""Research filter, terms, text predicate and relevance (inventory F1-F11, F13, F16, T5)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import fold, fold_text

# Words that need not occur in a work.
STOPWORDS = frozenset(
    "de da do das dos e a o as os em no na nos nas um uma para por com ao aos à às pelo pela sobre the of and in on for to an del la el y en los las".split()
)
# Types a filter can ask for, and affiliations.
FILTER_TYPES = {"artigo": "ARTIGO", "livro": "LIVRO", "capitulo": "CAPITULO", "evento": "EVENTO"}
AFFILIATIONS = ("vigente", "encerrado")
MIN_YEAR, MAX_CHARS, MAX_TERMS = 1950, 200, 8

@dataclass(frozen=True)
class ResearchFilter:
    """What a caller can ask for. `of` cleans raw values; empty means no restriction."""

    q: str = ""
    exact: bool = False
    department: str = ""
    topic: str = ""
    major_area: str = ""
    area: str = ""
    affiliation: str = ""
    item_type: str = ""
    first_year: int | None = None
    last_year: int | None = None
    researcher_id: int | None = None
    aliases: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, as_of_year: int, **raw) -> ResearchFilter:
        """blanks collapse, 200 characters, unknown enumerations and impossible years drop, years in order."""
        text = lambda k: re.sub(r"\s+", " ", str(raw.get(k) or "")).strip()[:MAX_CHARS]

        def year(k: str) -> int | None:
            try:
                y = int(raw.get(k) or 0)
            except ValueError:
                return None
            return y if MIN_YEAR <= y <= as_of_year + 1 else None

        a, b = year("first_year"), year("last_year")
        if a and b and a > b:
            a, b = b, a
        affiliation = text("affiliation") if text("affiliation") in AFFILIATIONS else ""
        return cls(text("q"), bool(raw.get("exact")), text("department"), text("topic"), text("major_area"), text("area"), affiliation, FILTER_TYPES.get(text("item_type").lower(), ""), a, b, raw.get("researcher_id"), raw.get("aliases") or {})

    def terms(self) -> list[str]:
        """the whole phrase if exact, else up to eight distinct words of two letters or more that aren't stopwords."""
        if not self.q:
            return []
        if self.exact:
            return [self.q]
        out: list[str] = []
        for w in re.split(r"[\s,;:!?()\[\]{}\"“”«»]+", self.q):
            w = w.strip(" \t\n\r\0\x0b.'’-").lower()
            if len(w) >= 2 and w not in STOPWORDS and w not in out:
                out.append(w)
        return out[:MAX_TERMS] or [self.q]


def is_doi(q: str) -> bool:
    """such a query searches publications."""
    return bool(re.match(r"^(https?://(dx\.)?doi\.org/)?10\.\d{4,9}/\S+$", q.strip(), re.I))


#: Columns whose folded form the text predicates compare.
SEARCHED = ("title", "keywords_text", "journal_name", "event_name", "doi")


def prepared(items: DataFrame) -> DataFrame:
    """items with `work`, the key of the unique work, and folded columns `f_...`: made once, as a stored table, then only read."""
    return items.withColumns({"work": keys.work_key(), **{f"f_{c}": fold(F.coalesce(F.col(c), F.lit(""))) for c in SEARCHED}})


def _has(column: str, term: str) -> Column:
    return F.contains(F.col(f"f_{column}"), F.lit(fold_text(term)))


def text_predicate(f: ResearchFilter, with_venue: bool = False) -> Column:
    """Every term in title or keywords; publications may also match the whole text in journal, event or DOI, or by the journal's family. Over `prepared` items."""
    hits = [_has("title", t) | _has("keywords_text", t) for t in f.terms()]
    out = reduce(lambda a, b: a & b, hits) if hits else F.lit(True)
    if with_venue and f.q:
        out = out | _has("journal_name", f.q) | _has("event_name", f.q) | _has("doi", f.q) | F.col("in_family")
    if f.topic:
        out = out & (_has("title", f.topic) | _has("keywords_text", f.topic))
    return out


def relevance(f: ResearchFilter, with_venue: bool = False) -> Column:
    """T5: the score of a work; 1 if no text is asked for. Over `prepared` items."""
    n = lambda c: c.cast("int")
    parts = []
    terms = f.terms()
    if f.exact and terms:
        parts.append(n(_has("title", terms[0])) * 8 + n(_has("keywords_text", terms[0])) * 3)
    elif terms:
        parts += [n(_has("title", t)) * 3 + n(_has("keywords_text", t)) for t in terms]
        if len(terms) > 1:
            parts.append(n(_has("title", f.q)) * 5)
    if f.topic:
        parts.append(n(_has("title", f.topic)) * 3 + n(_has("keywords_text", f.topic)))
    if with_venue and f.q:
        parts.append(n(_has("journal_name", f.q) | _has("event_name", f.q) | _has("doi", f.q)))
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(1)


def apply_filter(items: DataFrame, f: ResearchFilter, researchers: DataFrame | None = None, areas: DataFrame | None = None, with_venue: bool = False, family_rows: DataFrame | None = None) -> DataFrame:
    """the works that fit. Facets of researchers and areas are semi-joins; the rest is pushed to the scan.

    items may be `prepared` already. family_rows (id) are the journal rows whose articles a search of publications takes too.
    """
    out = items if "f_title" in items.columns else prepared(items)
    if f.item_type:
        out = out.where(F.col("item_type") == f.item_type)
    if f.first_year:
        out = out.where(F.col("year") >= f.first_year)
    if f.last_year:
        out = out.where(F.col("year") <= f.last_year)
    if f.researcher_id is not None:
        out = out.where(F.col("researcher_id") == f.researcher_id)
    if with_venue:
        if family_rows is not None and len(f.q) >= 3:
            rows = family_rows.select(F.col("id").alias("qualis_journal_id"), F.lit(True).alias("__row")).distinct()
            out = out.join(rows, "qualis_journal_id", "left").withColumn("in_family", F.coalesce(F.col("__row") & (F.col("item_type") == "ARTIGO"), F.lit(False))).drop("__row")
        else:
            out = out.withColumn("in_family", F.lit(False))
    out = out.where(text_predicate(f, with_venue))
    if researchers is not None and (f.department or f.affiliation):
        r = researchers
        if f.department:  # F7
            names = f.aliases.get(f.department) or department_values(f.department)
            r = r.where(F.col("department_code").isin(f.department, *names) | F.col("department").isin(f.department, *names))
        if f.affiliation:
            r = r.where(F.col("status") == (1 if f.affiliation == "vigente" else 0))
        out = out.join(r.select(F.col("id").alias("researcher_id")), "researcher_id", "left_semi")
    if areas is not None and (f.major_area or f.area):  # F8
        a = areas
        if f.major_area:
            a = a.where(F.col("major_area").isin(major_area_spellings(f.major_area)))
        if f.area:
            a = a.where(fold(F.col("area")) == fold_text(f.area))
        out = out.join(a.select("researcher_id"), "researcher_id", "left_semi")
    return out


# Names of departments by their codes, and the values that stand for the same department in a filter.
DEPARTMENTS = {
    "AC": "Departamento de Artes e Comunicação", "DAC": "Departamento de Artes e Comunicação", "CA": "Departamento de Ciências Ambientais", "DCA": "Departamento de Ciências Ambientais", "DCAm": "Departamento de Ciências Ambientais",
    "CI": "Departamento de Ciência da Informação", "DCI": "Departamento de Ciência da Informação", "CS": "Departamento de Ciências Sociais", "DCSo": "Departamento de Ciências Sociais", "DCS": "Departamento de Ciências Sociais",
    "ED": "Departamento de Educação", "DEd": "Departamento de Educação", "DEC": "Departamento de Educação e Comunicação", "FI": "Departamento de Filosofia", "FIL": "Departamento de Filosofia", "DFil": "Departamento de Filosofia",
    "IFD": "Departamento de Metodologia de Ensino / Formação Docente", "DME": "Departamento de Metodologia de Ensino", "DMTE": "Departamento de Metodologia e Teoria da Educação", "DTE": "Departamento de Teoria e Prática da Educação",
    "LE": "Departamento de Letras", "DL": "Departamento de Letras", "PS": "Departamento de Psicologia", "DPsi": "Departamento de Psicologia", "SO": "Departamento de Sociologia", "DSo": "Departamento de Sociologia",
    "TPP": "Departamento de Teoria e Prática Pedagógica", "DTPP": "Departamento de Teoria e Prática Pedagógica", "DEF": "Departamento de Educação Física", "DAD": "Departamento de Administração", "DART": "Departamento de Artes",
    "DMUS": "Departamento de Música", "GEO": "Departamento de Geografia", "HIS": "Departamento de História",
}
DEPARTMENT_ALIASES = {
    "CS": ["DCSo", "DCS", "Departamento de Ciências Sociais"], "AC": ["DAC", "Departamento de Artes e Comunicação"], "CA": ["DCA", "DCAm", "Departamento de Ciências Ambientais"], "CI": ["DCI", "Departamento de Ciência da Informação"],
    "ED": ["DEd", "DEC", "Departamento de Educação"], "FI": ["FIL", "DFil", "Departamento de Filosofia"], "IFD": ["DME", "DMTE", "Departamento de Metodologia de Ensino / Formação Docente", "Departamento de Metodologia de Ensino"],
    "LE": ["DL", "Departamento de Letras"], "PS": ["DPsi", "Departamento de Psicologia"], "SO": ["DSo", "Departamento de Sociologia"], "TPP": ["DTPP", "DTE", "Departamento de Teoria e Prática Pedagógica"],
}
#: Other names under which a filter may ask for one of them.
ALSO_ASKED = {"DCSo": "CS", "Departamento de Ciências Sociais": "CS", "DAC": "AC", "Departamento de Artes e Comunicação": "AC", "FIL": "FI"}


def department_values(department: str) -> list[str]:
    """All values that a filter by this department takes."""
    code = ALSO_ASKED.get(department, department)
    return [code, *DEPARTMENT_ALIASES[code]] if code in DEPARTMENT_ALIASES else [department]


def department_name(code: Column) -> Column:
    """The name of a code; another value stays as it is."""
    names = F.create_map(*(F.lit(x) for kv in DEPARTMENTS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, code), code)


# Codes of major areas and their names.
MAJOR_AREAS = {
    "CIENCIAS_EXATAS_E_DA_TERRA": "Ciências Exatas e da Terra", "CIENCIAS_BIOLOGICAS": "Ciências Biológicas", "ENGENHARIAS": "Engenharias", "CIENCIAS_DA_SAUDE": "Ciências da Saúde", "CIENCIAS_AGRARIAS": "Ciências Agrárias",
    "CIENCIAS_SOCIAIS_APLICADAS": "Ciências Sociais Aplicadas", "CIENCIAS_HUMANAS": "Ciências Humanas", "LINGUISTICA_LETRAS_E_ARTES": "Linguística, Letras e Artes", "OUTROS": "Outros",
}


def major_area_spellings(code: str) -> list[str]:
    """The code and its name."""
    return [code, MAJOR_AREAS[code]] if code in MAJOR_AREAS else [code]


def major_area_code(c: Column) -> Column:
    """The code of either spelling; null if unknown."""
    x = fold(c)
    out = F.lit(None).cast("string")
    for code, label in MAJOR_AREAS.items():
        out = F.when(x.isin(fold_text(code), fold_text(label), fold_text(code).replace("_", " ")), code).otherwise(out)
    return out
