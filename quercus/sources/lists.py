"""Spreadsheets, title lists and thesaurus files (inventory S11, S14, S16, S19-S21, S24).

Files are read where they lie, one task a file; what comes out are rows of plain columns. A spreadsheet is a zip of XML parts, which
the standard library reads.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import issn_valid, issns
from ..plans.filters import DEPARTMENTS

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
#: The delimiter that a header line has most of; comma if none.
DELIMITERS = ";,\t"


def decoded(content: bytes) -> str:
    """UTF-16 by its mark or its zero bytes, UTF-8, else Latin-1; the mark off."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content.decode(name, "replace").lstrip("﻿")
    if b"\0" in content[:200]:
        return content.decode("utf-16-le" if content[1:2] == b"\0" else "utf-16-be", "replace").lstrip("﻿")
    try:
        return content.decode("utf-8").lstrip("﻿")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def sniff_delimiter(head: str) -> str:
    """The most frequent of ; , and tab in the first line."""
    line = head.lstrip("﻿").split("\n", 1)[0]
    return max(DELIMITERS, key=line.count) if any(c in line for c in DELIMITERS) else ","


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [s.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)]


def sheet_rows(content: bytes, choose: Callable[[list[str]], str | None]) -> Iterator[dict[str, str]]:
    """The rows of the chosen sheet, as texts by column letter; empty cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheets = {s.get("name", ""): s.get(f"{{{_NS['r']}}}id") for s in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)}
        name = choose(list(sheets))
        if name is None:
            return
        target = next(r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == sheets[name])
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, row in ET.iterparse(part):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                out = {}
                for c in row.findall("m:c", _NS):
                    kind, v = c.get("t"), c.find("m:v", _NS)
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    else:
                        text = (v.text or "") if v is not None else ""
                        if kind == "s" and text:
                            text = shared[int(text)]
                        elif kind is None and re.fullmatch(r"-?\d+\.0+", text):
                            text = text.partition(".")[0]
                    if text.strip():
                        out[re.sub(r"\d", "", c.get("r", ""))] = text.strip()
                yield out
                row.clear()


def _by_file(spark: SparkSession, path: str, columns: str, rows: Callable[[str, bytes], Iterable[tuple]]) -> DataFrame:
    """rows(file name, content) of every file, as a table of string columns (or arrays, marked by a star)."""
    names = [c.rstrip("*") for c in columns.split()]
    types = [pa.list_(pa.string()) if c.endswith("*") else pa.string() for c in columns.split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(rows(file.rsplit("/", 1)[-1], content))
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    schema = ", ".join(f"`{n}` {'array<string>' if isinstance(t, pa.ListType) else 'string'}" for n, t in zip(names, types))
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


# --- S11 ---
def faculty(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheet with a 16-digit number in A: department in B, name in C, ORCID in G, years in Y and Z; the header row goes."""

    def rows(_: str, content: bytes) -> Iterator[tuple]:
        for n, r in enumerate(sheet_rows(content, lambda names: names[0] if names else None)):
            if n and re.fullmatch(r"\d{16}", r.get("A", "")):
                yield tuple(r.get(c, "") for c in "ABCGYZ")

    raw = _by_file(spark, path, "curriculum_id department_code full_name orcid first last", rows)
    names = F.create_map(*(F.lit(x) for kv in DEPARTMENTS.items() for x in kv))
    year = lambda c: F.nullif(F.regexp_extract(c, r"^(\d+)", 1).try_cast("int"), F.lit(0))
    code = F.nullif(F.col("department_code"), F.lit(""))
    return raw.select(
        "curriculum_id", code.alias("department_code"), F.when(code.isNotNull(), F.coalesce(F.try_element_at(names, code), F.concat(F.lit("Departamento ("), code, F.lit(")")))).alias("department"), "full_name",
        F.nullif(F.regexp_replace("orcid", "(?i)^https?://orcid\\.org/", ""), F.lit("")).alias("orcid"), year("first").alias("admission_year"), year("last").alias("leave_year"),
    )


def with_faculty(researchers: DataFrame, sheet: DataFrame) -> DataFrame:
    """Researchers (curriculum_id, full_name, department_code, department, orcid, admission_year, leave_year) after the sheet: its departments and years hold
    where it has them, its ORCIDs only where none is there; unknown numbers are added. Of several rows of a number the largest value counts."""
    columns = ["full_name", "department_code", "department", "orcid", "admission_year", "leave_year"]
    s = sheet.groupBy("curriculum_id").agg(*(F.max(c).alias(f"__{c}") for c in columns))
    old_first = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}"))
    keep = {"full_name": old_first("full_name"), "orcid": old_first("orcid")}
    return researchers.join(s, "curriculum_id", "full_outer").select("curriculum_id", *(keep.get(c, F.coalesce(f"__{c}", c)).alias(c) for c in columns))


# --- S14, S16 ---
def _cleaned(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _evidence(df: DataFrame, src: str, rec: Column, issn: Column, title: Column, labels: Column) -> DataFrame:
    """src, rec (a hash of ISSNs and title where the source has none), issns, title and labels of rows that have an ISSN or a title."""
    rows = df.select(rec.alias("r"), issn.alias("issns"), _cleaned(F.coalesce(title, F.lit(""))).alias("title"), labels.alias("labels")).where((F.size("issns") > 0) | (F.col("title") != ""))
    fallback = F.md5(F.concat(F.array_join("issns", ","), "title"))
    return rows.select(F.lit(src).alias("src"), F.coalesce(F.nullif(F.trim("r"), F.lit("")), fallback).alias("rec"), "issns", "title", "labels")


def _valid(*cs: Column) -> Column:
    return F.filter(issns(F.concat_ws(" ", *cs)), issn_valid)


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of `Key: value` lines between lines of dashes, keys in any case; no labels."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^\s*---.*$")).alias("b"))
    v = lambda k: F.trim(F.regexp_extract("b", rf"(?im)^\s*{k}\s*:[ \t]*(.*)$", 1))
    return _evidence(blocks, "pubmed", v("NlmId"), _valid(v(r"ISSN \(Print\)"), v(r"ISSN \(Online\)")), v("JournalTitle"), F.array().cast("array<string>"))


def _padded(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,7}$"), F.lpad(c, 8, "0")).otherwise(c)


# Headers of the source list, in lower case, and the start of the one of the subject codes.
SCOPUS = {"sourcerecord id": "rec", "source record id": "rec", "source title": "title", "issn": "issn", "eissn": "eissn", "active or inactive": "active", "source type": "type", "publisher": "publisher"}
SCOPUS_CODES = "all science journal classification codes"


def scopus(spark: SparkSession, path: str) -> DataFrame:
    """The sheet `Scopus Sources ...`, columns found by their headers, short ISSNs filled with zeros; a sheet without title, ISSN or code column is an error."""

    def rows(file: str, content: bytes) -> Iterator[tuple]:
        sheet = sheet_rows(content, lambda names: next((n for n in names if re.match(r"\s*scopus sources\b", n, re.I)), None))
        header = next(sheet, None)
        if header is None:
            return
        at: dict[str, str] = {}
        for letter, text in header.items():
            name = " ".join(text.lower().split())
            field = "asjc" if name.startswith(SCOPUS_CODES) else SCOPUS.get(name)
            if field:
                at.setdefault(field, letter)
        if missing := {"title", "issn", "asjc"} - set(at):
            raise ValueError(f"{file} has no column {sorted(missing)}")
        for r in sheet:
            yield tuple(r.get(at.get(f, ""), "") for f in ("rec", "title", "issn", "eissn", "asjc"))

    raw = _by_file(spark, path, "rec title issn eissn asjc", rows)
    codes = F.array_distinct(F.filter(F.transform(F.split("asjc", ";"), lambda x: F.trim(x)), lambda x: x != ""))
    return _evidence(raw, "scopus", F.col("rec"), _valid(_padded(F.col("issn")), _padded(F.col("eissn"))), F.col("title"), codes)


# --- S19, S20 ---
def plain_header(s: str) -> str:
    return re.sub(r"[^a-z0-9]", "", s.lower())


# Plain headers of each canonical column.
ALIASES = {
    "title": "sourcetitle journaltitle fulltitle title titpropio displayname nome periodico itemtitle".split(), "issn_e": "issne eissn electronicissn issnelectronic journalissnonlineonline issnonline journaleissnonlineversion issneletronico".split(),
    "issn_l": "issnl linkingissn issnlinking".split(), "issn_imp": "issnimp printissn issnprint journalissnprintprint journalissnprintversion pissn issnimpresso".split(), "issn": ["issn"],
    "area": "webofsciencecategories asjcclassificationcodes allsciencejournalclassificationcodesasjc asjc subjectarea area subjects subtemas".split(), "variation": "abbreviation alternativetitle alternatetitle medabbr isoabbr titulovariante tituloabreviado".split(),
}
LIST_COLUMNS = "title issn issn_imp issn_e issn_l area"


def header_places(headers: list[str]) -> dict[str, int]:
    """The place of each canonical column; a plain ISSN also stands for the printed one where that is missing."""
    plain = [plain_header(h) for h in headers]
    out = {c: i for c, names in ALIASES.items() if (i := next((i for i, h in enumerate(plain) if h in names), None)) is not None}
    if "issn_imp" not in out and "issn" in out:
        out["issn_imp"] = out["issn"]
    return out


def _sheet_of_titles(names: list[str]) -> str | None:
    return next((n for n in names if any(w in n.lower() for w in ("sources", "journal", "titles"))), names[0] if names else None)


def _letter(n: int) -> str:
    s = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        s = chr(65 + k) + s
    return s


def _list_rows(file: str, content: bytes) -> Iterator[tuple]:
    kind = file.rsplit(".", 1)[-1].lower()
    fields = LIST_COLUMNS.split()
    if kind == "json":
        data = json.loads(decoded(content))
        items = data if isinstance(data, list) else next((data[k] for k in ("results", "items", "data") if isinstance(data.get(k), list)), [data])
        for x in items:
            if not isinstance(x, dict):
                continue
            numbers = x.get("issn") if isinstance(x.get("issn"), list) else [x["issn"]] if x.get("issn") else []
            topics = [t["display_name"] for t in x.get("topics") or [] if isinstance(t, dict) and t.get("display_name")]
            other = [t.strip() for t in x.get("alternate_titles") or [] if isinstance(t, str) and t.strip()]
            yield (str(x.get("display_name") or x.get("title") or x.get("name") or ""), "", *(str(numbers[i]) if len(numbers) > i else "" for i in (0, 1)), str(x.get("issn_l") or ""), "; ".join(topics[:5]), other)
        return
    if kind == "txt":
        for block in re.split(r"(?m)^\s*---.*$", decoded(content)):
            v = lambda k: [x.strip() for x in re.findall(rf"(?m)^\s*{k}:[ \t]*(.*)$", block) if x.strip()]  # noqa: E731, B023
            one = lambda k: (v(k) or [""])[-1]  # noqa: E731, B023
            yield one("JournalTitle"), "", one(r"ISSN \(Print\)"), one(r"ISSN \(Online\)"), "", "", [*v("MedAbbr"), *v("IsoAbbr")]
        return
    if kind in ("xlsx", "xls"):
        sheet = sheet_rows(content, _sheet_of_titles)
        header = next(sheet, {})
        letters = sorted(header, key=lambda c: (len(c), c))
        places = {c: letters[i] for c, i in header_places([header[x] for x in letters]).items()}
        values: Iterable[Callable[[str], str]] = (lambda c, r=r: r.get(places.get(c, ""), "") for r in sheet)
    else:
        text = decoded(content)
        first = text.split("\n", 1)[0]
        delimiter = ";" if first.count(";") > first.count(",") else "\t" if "\t" in first else ","
        records = csv.reader(io.StringIO(text), delimiter=delimiter)
        places = header_places(next(records, []))
        values = (lambda c, r=r: r[places[c]].strip() if c in places and places[c] < len(r) else "" for r in records)
    for value in values:
        yield (*(value(c) for c in fields), [v] if (v := value("variation")) else [])


def title_list(spark: SparkSession, path: str) -> DataFrame:
    """A title list (CSV, XLSX, TXT or JSON file, or a folder of them) as title, issn, issn_imp, issn_e, issn_l, area and variations. Rows without title and ISSN go.

    The delimiter is told by the header line, columns by their headers. Columns that aren't there are empty.
    """
    rows = _by_file(spark, path, f"{LIST_COLUMNS} variations*", _list_rows)
    return rows.where(F.concat("title", "issn", "issn_imp", "issn_e", "issn_l") != "")


def headers_of(file: str, content: bytes) -> tuple[list[str], list[str]]:
    """Headers and sheet names of a file's first kilobytes (a spreadsheet is read as a whole)."""
    kind = file.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xls"):
        names = sheet_names(content)
        return list(next(sheet_rows(content, _sheet_of_titles), {}).values()), names
    text = decoded(content)
    if kind == "csv":
        first = text.split("\n", 1)[0].rstrip("\r")
        return next(csv.reader([first], delimiter=";" if first.count(";") > first.count(",") else "\t" if "\t" in first else ","), []), []
    if kind == "txt":
        return (["jrid", "journaltitle", "medabbr", "isoabbr", "issnprint", "issnonline", "nlmid"] if re.search("JournalTitle:|MedAbbr:|NlmId:", "\n".join(text.split("\n")[:40])) else []), []
    if kind == "json":
        try:
            data = json.loads(text)
        except ValueError:
            return [], []
        items = data if isinstance(data, list) else next((data[k] for k in ("results", "items", "data") if isinstance(data.get(k), list)), [data])
        return (list(items[0]) if items and isinstance(items[0], dict) else []), []
    return [], []


# For each format its confidence and what must be among the plain headers: one of these sets.
SIGNATURES = [
    ("scopus", 0.99, ["sourcerecordid", "asjcclassificationcodes", "titlesdiscontinuedbyscopus"]), ("wos", 0.95, ["webofsciencecategories", "clarivate", "scie ssci", "journaltitle eissn publishername"]),
    ("doaj", 0.95, ["doajseal", "journalissnprintversion", "journalurlindoaj", "journalissnprintprint", "journallicense"]), ("pubmed", 0.95, ["pmid", "jrid", "medabbr", "journaltitle nlmid"]),
    ("scielo", 0.95, ["scielonetwork", "scielojournal", "lastvolume isactive", "lastnumber isactive"]), ("latindex", 0.98, ["foliou", "idcatalogo", "titpropio issne", "issne issnl issnimp"]), ("openalex", 0.90, ["issnl displayname"]),
]


def detect(headers: list[str], sheets: list[str] = (), databases: dict[str, list[str]] | None = None) -> tuple[str, float] | None:
    """The first format whose headers (or sheet) are there, with its confidence; else the first database all of whose own columns are, at 0.80; else None."""
    plain = {plain_header(h) for h in headers}
    for name, sure, sets in SIGNATURES:
        if any(set(s.split()) <= plain for s in sets) or name == "scopus" and any("scopussources" in plain_header(s) for s in sheets):
            return name, sure
    for name, columns in (databases or {}).items():
        if columns and {plain_header(c) for c in columns} <= plain:
            return name, 0.80
    return None


# --- S21 ---
HEADERS, VARIANTS = ("preferred_name", "preferred", "header", "official_name", "termo_preferido"), ("variant_name", "variation", "variant", "variantes")


def _the_entries(text: str) -> Iterator[tuple[str, list[str]]]:
    starred = text.startswith("**") or "\n**" in text
    header, names = None, []
    for line in map(str.strip, text.replace("\r", "").split("\n")):
        variant = None
        if not line:
            continue
        if line.startswith("**") or (header is None or not starred) and not line.startswith(";") and "^" not in line:
            if header is not None:
                yield header, names
            header, names = (line.lstrip("*#").strip() if line.startswith("**") else line), []
            continue
        if line.startswith(";"):
            variant = line.lstrip(";").strip()
        elif m := re.search(r"\^(.*?)\$?$", line):
            variant = m[1].strip()
        else:
            variant = line.rstrip("$").strip()
        if variant:
            names.append(variant)
    if header is not None:
        yield header, names


def _entries(file: str, content: bytes) -> Iterator[tuple[str, list[str]]]:
    text, kind = decoded(content), file.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        first = text.split("\n", 1)[0]
        delimiter = ";" if ";" in first and "," not in first else "\t" if "\t" in first else ","
        grouped: dict[str, list[str]] = {}
        for r in csv.DictReader(io.StringIO(text), delimiter=delimiter):
            pick = lambda names: next((r[n] for n in names if r.get(n) is not None), "").strip()  # noqa: E731, B023
            if header := pick(HEADERS):
                grouped.setdefault(header, []).extend(v.strip() for v in pick(VARIANTS).split("|") if v.strip())
        yield from grouped.items()
    elif kind == "json":
        data = json.loads(text)
        for key, item in data.items() if isinstance(data, dict) else ((None, x) for x in data):
            if isinstance(item, dict) and (item.get("header") is not None or item.get("preferred_name") is not None):
                names = item.get("variations", item.get("variants")) or []
                yield str(item.get("header") or item.get("preferred_name")).strip(), [str(v).strip() for v in names] if isinstance(names, list) else []
            elif key is not None and isinstance(item, list):
                yield key.strip(), [str(v).strip() for v in item]
    elif kind == "xml":
        try:
            root = ET.fromstring(text)
        except ET.ParseError:
            return
        for child in root:
            header = next((x for t in ("header", "name", "preferred_name") if (x := child.findtext(t)) is not None), "").strip()
            group = child.find("variations")
            names = [(v.text or "").strip() for v in (list(group) if group is not None else child.findall("variation"))]
            if header:
                yield header, [n for n in names if n]
    else:
        yield from _the_entries(text)


def thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """Header and distinct variants of a thesaurus in VantagePoint, CSV, JSON or XML files, by their extension. A header may have no variant."""
    return _by_file(spark, path, "header variants*", lambda file, content: ((h, list(dict.fromkeys(v))) for h, v in _entries(file, content)))


# --- S24 ---
def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Areas of a taxonomy file: id, slug, name, parent (its slug; null on the first level), level, college, sort_order (the file's)."""

    def rows(_: str, content: bytes) -> Iterator[tuple]:
        found = json.loads(decoded(content))["areas"]
        slugs = {a["id"]: a["slug"] for a in found}
        for n, a in enumerate(found):
            yield str(a["id"]), a["slug"], a["name"], slugs.get(a["parent"]), str(a["level"]), a.get("college"), str(n)

    return _by_file(spark, path, "id slug name parent level college sort_order", rows).withColumns({c: F.col(c).cast("int") for c in ("id", "level", "sort_order")})


def title_rule_table(spark: SparkSession, path: str) -> DataFrame:
    """Place, pattern and slug of a file of title rules, in its order."""
    rows = lambda _, content: ((str(n), r["pattern"], r["slug"]) for n, r in enumerate(json.loads(decoded(content))["rules"]))
    return _by_file(spark, path, "place pattern slug", rows).withColumn("place", F.col("place").cast("int"))


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary (the file's name), label and slug of crosswalk files: a JSON map `map` (or the object itself) of a label to one slug or several."""

    def rows(file: str, content: bytes) -> Iterator[tuple]:
        data = json.loads(decoded(content))
        for label, slugs in (data.get("map") or data).items():
            for s in slugs if isinstance(slugs, list) else [slugs]:
                if isinstance(s, str) and not label.startswith("_"):
                    yield file.rsplit(".", 1)[0], label, s

    return _by_file(spark, path, "vocabulary label slug", rows)


def words(spark: SparkSession, path: str, most: int = 10_000) -> list[str]:
    """The words of a text file, one or several a line, # before remarks: for stop lists, which are parameters of operators. An error beyond `most`."""
    out = [w for r in spark.read.text(path).limit(most + 1).collect() for w in r.value.partition("#")[0].split()]
    if len(out) > most:
        raise ValueError(f"a list of words has {most} at most")
    return list(dict.fromkeys(out))
