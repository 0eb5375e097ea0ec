"""Countries by code, name, variant or alias (inventory R8, N22).

One table of typed keys answers all: `country_keys` makes it from the stored countries, their variants and the usual aliases, each key once,
with what decided and whether several countries claim it; `resolved` joins distinct texts with it. Texts that no key equals are tried by part:
keys and texts that share four letters are compared, so nothing is crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized

# What countries are also called, in two languages, with their code.
ALIASES = {
    "brasil": "BR", "brazil": "BR", "bra": "BR", "brasileira": "BR", "brasileiro": "BR", "eua": "US", "usa": "US", "estados unidos": "US", "estados unidos da america": "US", "united states": "US", "reino unido": "GB", "uk": "GB", "united kingdom": "GB", "inglaterra": "GB", "england": "GB",
    "franca": "FR", "france": "FR", "alemanha": "DE", "germany": "DE", "deutschland": "DE", "espanha": "ES", "spain": "ES", "espana": "ES", "italia": "IT", "italy": "IT", "portugal": "PT", "argentina": "AR", "chile": "CL", "uruguai": "UY", "uruguay": "UY", "canada": "CA", "mexico": "MX",
    "australia": "AU", "japao": "JP", "japan": "JP", "china": "CN", "holanda": "NL", "netherlands": "NL", "suica": "CH", "switzerland": "CH", "colombia": "CO", "peru": "PE", "cuba": "CU", "india": "IN", "russia": "RU", "africa do sul": "ZA", "south africa": "ZA", "suecia": "SE", "sweden": "SE",
    "noruega": "NO", "norway": "NO", "dinamarca": "DK", "denmark": "DK", "belgica": "BE", "belgium": "BE",
}
# What those that aren't stored are called.
NAMES = {
    "US": "Estados Unidos", "BR": "Brasil", "GB": "Reino Unido", "FR": "França", "DE": "Alemanha", "ES": "Espanha", "IT": "Itália", "PT": "Portugal", "AR": "Argentina", "CL": "Chile", "UY": "Uruguai", "CA": "Canadá", "MX": "México", "AU": "Austrália", "JP": "Japão", "CN": "China", "NL": "Holanda",
    "CH": "Suíça", "CO": "Colômbia", "PE": "Peru", "CU": "Cuba", "IN": "Índia", "RU": "Rússia", "ZA": "África do Sul", "SE": "Suécia", "NO": "Noruega", "DK": "Dinamarca", "BE": "Bélgica",
}
#: Letters that a key and a text have to share to be compared by part, and the fewest bytes of such a key are one more than three.
GRAM = 4


def _code(c: str) -> Column:
    return F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))


def country_keys(countries: DataFrame, variants: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Key, country_id, common_name, iso2, iso3, kind, place, ambiguous: a row a key.

    Kinds in order: the codes and names of stored countries (iso2, iso3, name, official), of which the larger id has a key that several claim; variants, the lower row first; aliases (alias: code),
    which stand for the stored country of that code, else for one without id. A kind never takes a key of an earlier one. ambiguous: several countries of the deciding kind claim the key.
    countries: id, common_name, official_name, iso2, iso3; variants: id, country_id, name, and those of countries that aren't there don't count. place orders the keys as they came.
    """
    spark = countries.sparkSession
    c = countries.select("id", F.col("common_name").alias("common_name"), _code("iso2").alias("iso2"), _code("iso3").alias("iso3"), "official_name")
    facts = ["country_id", "common_name", "iso2", "iso3"]
    own = c.select(F.col("id").alias("country_id"), "common_name", "iso2", "iso3", F.posexplode(F.array(F.lower("iso2"), F.lower("iso3"), normalized(F.col("common_name")), normalized(F.col("official_name")))).alias("n", "key"))
    own = own.where("key <> ''").select("key", *facts, F.element_at(F.array(*map(F.lit, ("iso2", "iso3", "name", "official"))), F.col("n") + 1).alias("kind"), F.lit(0).alias("stage"), F.struct((-F.col("country_id")).alias("id"), (-F.col("n")).alias("n")).alias("rank"), F.struct(F.lit(0).alias("s"), F.col("country_id").cast("long").alias("i"), F.col("n").cast("long").alias("n")).alias("place"))
    out = own
    if variants is not None:
        v = variants.join(c.select(F.col("id").alias("country_id"), "common_name", "iso2", "iso3"), "country_id").withColumn("key", normalized(F.col("name"))).where("key <> ''")
        out = out.unionByName(v.select("key", *facts, F.lit("variant").alias("kind"), F.lit(1).alias("stage"), F.struct(F.col("id").alias("id"), F.lit(0).alias("n")).alias("rank"), F.struct(F.lit(1).alias("s"), F.col("id").cast("long").alias("i"), F.lit(0).cast("long").alias("n")).alias("place")))
    rows = [(i, code, alias, NAMES.get(code)) for i, (alias, code) in enumerate((ALIASES if aliases is None else aliases).items())]
    a = spark.createDataFrame(rows, "i long, code string, alias string, called string").withColumn("n", F.lit(0).cast("long"))
    by_code = c.where("iso2 IS NOT NULL").groupBy(F.col("iso2").alias("code")).agg(F.max_by(F.struct(F.col("id").alias("country_id"), "common_name", "iso2", "iso3"), "id").alias("x"))
    a = a.join(by_code, "code", "left").withColumn("key", normalized(F.col("alias"))).where("key <> ''")
    a = a.select("key", F.coalesce("x.country_id", F.lit(0)).alias("country_id"), F.coalesce("x.common_name", "called", F.initcap("alias")).alias("common_name"), F.coalesce("x.iso2", "code").alias("iso2"), F.col("x.iso3").alias("iso3"), F.lit("alias").alias("kind"), F.lit(2).alias("stage"), F.struct(F.col("i").alias("id"), F.col("n").cast("int").alias("n")).alias("rank"), F.struct(F.lit(2).alias("s"), F.col("i").alias("i"), F.col("n").alias("n")).alias("place"))
    out = out.unionByName(a)
    best = out.groupBy("key").agg(F.min("stage").alias("stage"), F.min("place").alias("place"))
    claims = out.drop("place").join(best, ["key", "stage"])
    return claims.groupBy("key").agg(F.min_by(F.struct(*facts, "kind"), "rank").alias("x"), F.first("place").alias("place"), (F.min("country_id") != F.max("country_id")).alias("ambiguous")).select("key", "x.*", "place", "ambiguous")


def resolved(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows with country_id, common_name, iso2, iso3 and how (the key's kind, or `part`); null where nothing is found.

    A text equals a key as normalised, else as it is in lower case. Else the first key, in the order they came, of over three bytes that the text contains or that contains the text. A text
    without letters or digits has no country. A key that several countries claim resolves like any other; who wants to leave it out filters the keys.
    """
    facts = ["country_id", "common_name", "iso2", "iso3"]
    texts = rows.select(F.col(column).alias("__text")).distinct().withColumn("__norm", normalized(F.col("__text"))).where("__norm <> ''")
    forms = texts.select("__text", F.posexplode(F.array("__norm", F.lower(F.trim("__text")))).alias("step", "key"))
    exact = forms.join(keys, "key").groupBy("__text").agg(F.min_by(F.struct(*facts, F.col("kind").alias("how")), "step").alias("__x"))
    rest = texts.join(exact.select("__text"), "__text", "left_anti")
    long_ = keys.where(F.octet_length("key") > GRAM - 1)
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))
    # The text contains the key: it has the key's first letters. The key contains the text: it has the text's first letters, fewer if it is shorter.
    inside = rest.select("__text", "__norm", F.explode(grams(F.col("__norm"), GRAM)).alias("g")).join(long_.select(F.substring("key", 1, GRAM).alias("g"), "key", "place"), "g").where(F.contains("__norm", F.col("key")))
    parts = long_.select("key", "place", F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.col("key"), n) for n in range(1, GRAM + 1)))))).alias("g"))
    around = rest.select("__text", "__norm", F.substring("__norm", 1, GRAM).alias("g")).join(parts, "g").where(F.contains("key", F.col("__norm")))
    first = inside.select("__text", "key", "place").unionByName(around.select("__text", "key", "place")).groupBy("__text").agg(F.min_by("key", "place").alias("key"))
    found = first.join(keys, "key").select("__text", F.struct(*facts, F.lit("part").alias("how")).alias("__x"))
    return rows.join(exact.unionByName(found).withColumnRenamed("__text", column), column, "left").select(*rows.columns, *(F.col(f"__x.{f}").alias(f) for f in (*facts, "how")))


def codes(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows with the country's two letters in `code`."""
    return resolved(rows, column, keys).select(*rows.columns, F.col("iso2").alias("code"))


def default_keys(spark: SparkSession) -> DataFrame:
    """The keys of the aliases alone, where no countries are stored."""
    return country_keys(spark.createDataFrame([], "id long, common_name string, official_name string, iso2 string, iso3 string"))
