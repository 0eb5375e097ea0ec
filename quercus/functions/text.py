"""Text functions as native columns (inventory N1-N4, N10-N18, N21, N26)."""

from __future__ import annotations

import html
import html.entities
import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _marked_letters() -> tuple[str, str]:
    """Lower-case letters that decompose into one plain letter and marks, and those plain letters, by Unicode's own rule."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(d) > 1 and not unicodedata.combining(d[0]) and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            pairs[c] = d[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTS, PLAIN = _marked_letters()
# The letters that the topic normaliser folds; others become blanks.
TOPIC_ACCENTS = "áàãâäéèêëíìîïóòõôöúùûüçñ"
TOPIC_PLAIN = "aaaaaeeeeiiiiooooouuuucn"
# Connectives that the compact key leaves out.
COMPACT_STOPWORDS = ["a", "o", "as", "os", "e", "de", "da", "do", "das", "dos", "em", "the", "of", "and", "y", "la", "el", "los", "las", "del"]
# Connectives and Roman numerals of display titles.
TITLE_CONNECTIVES = ["de", "da", "do", "das", "dos", "e", "em", "a", "o", "as", "os", "para", "com", "of", "the", "and", "y", "la", "el", "del", "di"]
TITLE_ROMANS = ["ii", "iii", "iv", "vi", "vii", "viii", "ix", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx", "xxi"]


def without_marks(c: Column) -> Column:
    """Lower-case text without accents and other non-spacing marks, of any script but decomposed Hangul; composed and combining forms alike."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTS, PLAIN), r"\p{Mn}+", "")


def fold(c: Column) -> Column:
    """Case- and accent-insensitive form of text, trimmed: stands for the collation of the domain tables."""
    return without_marks(F.trim(c))


def fold_text(s: str) -> str:
    """fold for a text of the caller's."""
    return "".join(x for x in unicodedata.normalize("NFD", s.strip().lower()) if unicodedata.category(x) != "Mn")


def normalized(c: Column, upper: bool = False) -> Column:
    """Marks off, what isn't letter or number to a blank, blanks collapsed, one case. Any script stays."""
    x = F.trim(F.regexp_replace(F.regexp_replace(without_marks(c), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    return F.upper(x) if upper else x


def resolver_key(c: Column) -> Column:
    """N1 of the decoded text, then only a-z and 0-9: other scripts become empty."""
    return F.trim(F.regexp_replace(normalized(unescape(c)), "[^a-z0-9]+", " "))


def title_key(c: Column) -> Column:
    """N1 of the decoded text; titles of any script keep a key."""
    return normalized(unescape(c))


def topic_key(c: Column) -> Column:
    """Only seven accent classes are folded; any other letter becomes a blank."""
    x = F.translate(F.lower(F.trim(c)), TOPIC_ACCENTS, TOPIC_PLAIN)
    return F.regexp_replace(F.trim(F.regexp_replace(x, r"[^a-z0-9\s]", " ")), r"\s+", " ")


_ENTITIES = json.dumps({f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";") and len(v) == 1 and len(k) <= 9})


def _character(entity: Column) -> Column:
    """The character of a numeric reference; the reference itself if it isn't one."""
    number = F.when(F.lower(F.substring(entity, 3, 1)) == "x", F.conv(F.regexp_extract(entity, "([0-9A-Fa-f]+);$", 1), 16, 10)).otherwise(F.regexp_extract(entity, "([0-9]+);$", 1)).try_cast("int")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")).otherwise(entity)


def unescape(c: Column) -> Column:
    """Named (HTML's with a semicolon, of one character) and numeric character references decoded once; text without an ampersand is left alone."""
    names = F.from_json(F.lit(_ENTITIES), "map<string,string>")  # folded to one literal
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("(&[A-Za-z][A-Za-z0-9]{1,7};|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)"), F.lit(1)))
    named = F.transform(found, lambda e: F.struct(e.alias("e"), F.when(F.startswith(e, F.lit("&#")), _character(e)).otherwise(F.coalesce(F.try_element_at(names, e), e)).alias("c")))
    # What gives an ampersand goes last, so nothing is decoded twice.
    last = F.concat(F.filter(named, lambda x: x["c"] != "&"), F.filter(named, lambda x: x["c"] == "&"))
    return F.when(F.contains(c, F.lit("&")), F.aggregate(last, c, lambda acc, x: F.replace(acc, x["e"], x["c"]))).otherwise(c)


def slug(c: Column) -> Column:
    """Hyphens between words; an empty one becomes a hash of the text instead of a random id."""
    s = F.trim(F.regexp_replace(normalized(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.md5(c)).otherwise(s)


def without_parentheses(c: Column) -> Column:
    """Parentheses and what is in them off."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\s+", " "))


def compacted(key: Column) -> Column:
    """N14 of a key: its words but for connectives; null with fewer than two."""
    words = F.filter(F.split(key, " "), lambda w: ~w.isin(COMPACT_STOPWORDS) & (w != ""))
    return F.when(F.size(words) >= 2, F.array_join(words, " "))


def compact_key(c: Column) -> Column:
    """N14 of a text."""
    return compacted(resolver_key(c))


def keyword_key(c: Column, stopwords: list[str]) -> Column:
    """Words of over one letter that aren't stopwords."""
    return F.array_join(F.filter(F.split(resolver_key(c), " "), lambda w: ~w.isin(stopwords) & (F.length(w) > 1)), " ")


def inverted_name(c: Column) -> Column:
    """N16: 'Surname, Given' to 'Given Surname' and back."""
    comma = F.concat_ws(" ", F.trim(F.regexp_extract(c, "^([^,]*),(.*)$", 2)), F.trim(F.regexp_extract(c, "^([^,]*),(.*)$", 1)))
    last = F.concat(F.regexp_extract(c, r"(\S+)\s*$", 1), F.lit(", "), F.regexp_extract(c, r"^\s*(.*?)\s+\S+\s*$", 1))
    return F.when(F.contains(c, F.lit(",")), F.trim(comma)).when(F.contains(F.trim(c), F.lit(" ")), last).otherwise(F.trim(c))


def display_title(c: Column) -> Column:
    """Every run of letters with a capital, but not after an apostrophe; connectives small but for the first one, Roman numerals capital; blanks collapsed."""
    plain = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    tokens = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"), F.lit(1))
    is_word = lambda t: t.rlike(r"^[\p{L}\p{M}]")
    capital = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))

    def cased(t: Column, i: Column) -> Column:
        before = F.coalesce(F.get(tokens, i - 1), F.lit(""))
        first = (i == 0) | ((i == 1) & ~is_word(before))
        bound = (i > 1) & before.isin("'", "’")
        return F.when(~is_word(t), t).when(~first & t.isin(TITLE_CONNECTIVES), t).when(t.isin(TITLE_ROMANS), F.upper(t)).when(bound, t).otherwise(capital(t))

    return F.array_join(F.transform(tokens, cased), "")


def own_case(c: Column) -> Column:
    """A name that mixes capitals and small letters stays; another gets N17."""
    return F.when(c.rlike(r"\p{Lu}") & c.rlike(r"\p{Ll}"), c).otherwise(display_title(c))


def contains_words(long: Column, short: Column) -> Column:
    """The words of short stand side by side in long, and are two or more."""
    return F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" "))) & F.contains(short, F.lit(" "))


def bare_doi(c: Column) -> Column:
    """The DOI without scheme and host."""
    return F.regexp_replace(F.trim(c), r"(?i)^(https?://)?(dx\.)?doi\.org/", "")


def issns(c: Column) -> Column:
    """The distinct ISSN-shaped tokens in order, as dddd-dddX."""
    raw = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"([0-9]{4}-?[0-9]{3}[0-9X])"), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda x: F.concat(F.substring(x, 1, 4), F.lit("-"), F.substring(F.replace(x, F.lit("-"), F.lit("")), 5, 4))))


def issn_valid(c: Column) -> Column:
    """The check digit modulo 11 of dddd-dddX."""
    d = F.replace(c, F.lit("-"), F.lit(""))
    total = sum(((8 - i) * F.substring(d, i + 1, 1).try_cast("int") for i in range(7)), F.lit(0))
    check = (F.lit(11) - total % 11) % 11
    return (F.length(d) == 8) & (F.when(check == 10, "X").otherwise(check.cast("string")) == F.substring(d, 8, 1))


#: The score of a title whose words stand side by side in another (fixed value).
CONTAINED = 0.9


def title_score(a: Column, b: Column) -> Column:
    """How alike two titles are, 0 to 1.

    1 if their compact keys (N14 of N4) are equal, 0.9 if one stands in the other by whole words, else the Jaccard of their words, of
    the compact key where there is one; the best of whole titles and titles without parentheses. 0 if either has no key or is null.
    """
    sides = lambda c: F.transform(
        F.array_distinct(F.filter(F.array(title_key(c), F.when(F.contains(c, F.lit("(")), title_key(without_parentheses(c)))), lambda k: k != "")),
        lambda k: F.struct(k.alias("k"), compacted(k).alias("c")),
    )
    inside = lambda long, short: F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))

    def score(x: Column, y: Column) -> Column:
        u, v = (F.array_distinct(F.split(F.coalesce(z["c"], z["k"]), " ")) for z in (x, y))
        jaccard = F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v))
        both = x["c"].isNotNull() & y["c"].isNotNull()
        within = both & (inside(x["c"], y["c"]) | inside(y["c"], x["c"]))
        return F.when(both & (x["c"] == y["c"]), F.lit(1.0)).when(within, F.greatest(F.lit(CONTAINED), jaccard)).otherwise(jaccard)

    best = F.array_max(F.flatten(F.transform(sides(a), lambda x: F.transform(sides(b), lambda y: score(x, y)))))
    return F.coalesce(best, F.lit(0.0))


def plain_title_key(s: str) -> str:
    """N4 of one text, for tasks that compare titles one by one."""
    x = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in fold_text(html.unescape(s)))
    return " ".join(x.split())


def plain_title_score(a: str, b: str) -> float:
    """N19 of two texts, for tasks that compare titles one by one."""

    def sides(s: str) -> list[tuple[list[str], bool]]:
        keys = [plain_title_key(s), *([plain_title_key(re.sub(r"\([^)]*\)", " ", s))] if "(" in s else [])]
        out = []
        for k in filter(None, dict.fromkeys(keys)):
            c = [w for w in k.split(" ") if w not in COMPACT_STOPWORDS]
            out.append((c, True) if len(c) >= 2 else (k.split(" "), False))
        return out

    def score(x: tuple[list[str], bool], y: tuple[list[str], bool]) -> float:
        (u, cu), (v, cv) = x, y
        if cu and cv and u == v:
            return 1.0
        jaccard = len(set(u) & set(v)) / len(set(u) | set(v))
        p, q = f" {' '.join(u)} ", f" {' '.join(v)} "
        return max(CONTAINED, jaccard) if cu and cv and (p in q or q in p) else jaccard

    if not plain_title_key(a) or not plain_title_key(b):
        return 0.0
    return max(score(x, y) for x in sides(a) for y in sides(b))


def weight_units(n: Column, i: Column) -> Column:
    """The weight of label i (from 0) of n, in ten-thousandths that add up to 1."""
    return ((F.floor(F.lit(10000) / n) + (i < F.lit(10000) % n).cast("int")) / 10000).cast("decimal(6,4)")


def rule_chain(c: Column, rules: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """The outcome of the first rule one of whose needles c contains."""
    out = None
    for outcome, needles in rules:
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(c, F.lit(n))
        out = F.when(hit, outcome) if out is None else out.when(hit, outcome)
    return out.otherwise(otherwise)
