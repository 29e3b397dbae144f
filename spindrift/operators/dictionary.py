"""Names in texts by a dictionary of any size: word n-grams of a text meet those of the aliases in an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Words of the longest alias that is looked for; longer ones are an error.
MOST_WORDS = 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def keyed(aliases: DataFrame) -> DataFrame:
    """gram (its words, joined by blanks), n, canonical: one row per distinct alias with a word in it; of equal ones the least canonical name."""
    told = aliases.select(words(F.col("alias")).alias("w"), F.trim("canonical").alias("canonical")).filter(F.size("w") > 0)
    return told.groupBy(F.array_join("w", " ").alias("gram"), F.size("w").alias("n")).agg(F.min("canonical").alias("canonical"))


def hits(texts: DataFrame, key: str, text: str, aliases: DataFrame, few: int = 200_000) -> DataFrame:
    """key, at, n, gram, canonical: every place of a text at which words stand that are an alias.

    The lengths of aliases are looked up first, so a text gives one gram for each place and length. The dictionary is broadcast while it is
    small, which is counted; else grams and aliases are shuffled.
    """
    names = keyed(aliases)
    lengths = sorted(r["n"] for r in names.select("n").distinct().collect())
    if lengths and lengths[-1] > MOST_WORDS:
        raise ValueError(f"aliases have at most {MOST_WORDS} words")
    own = texts.select(F.col(key), words(F.col(text)).alias("w"))
    none = F.array().cast("array<struct<at:int,n:int,gram:string>>")

    def of_length(n: int) -> Column:
        one = lambda i: F.struct(i.cast("int").alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("gram"))
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), one)).otherwise(none)

    grams = F.concat(none, *map(of_length, lengths))
    told = own.select(key, F.explode(grams).alias("g")).select(key, "g.*")
    names = F.broadcast(names) if names.limit(few + 1).count() <= few else names
    return told.join(names, ["gram", "n"])


def longest_first(found: DataFrame, key: str) -> DataFrame:
    """key, at, n, gram, canonical of the hits that stand when the longest go first and take their words out.

    A hit is tried after those with more words, of these after the longer and then the earlier ones; it falls if a word of it is
    taken. The hits of one text are folded in that order, as each pick depends on those before it; their number is bounded by the text's places.
    """
    order = F.struct((-F.col("n")).alias("fewer"), (-F.char_length("gram")).alias("shorter"), "at", "n", "gram", "canonical")
    sets = found.groupBy(key).agg(F.array_sort(F.collect_set(order)).alias("hits"))
    kind = "struct<fewer:int,shorter:int,at:int,n:int,gram:string,canonical:string>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(s: Column, h: Column) -> Column:
        own = F.sequence(h["at"], h["at"] + h["n"] - 1)
        return F.when(F.arrays_overlap(s["used"], own), s).otherwise(F.struct(F.concat(s["used"], own).alias("used"), F.concat(s["kept"], F.array(h)).alias("kept")))

    kept = F.aggregate(F.col("hits").cast(f"array<{kind}>"), start, step, lambda s: s["kept"])
    return sets.select(key, F.explode(kept).alias("h")).select(key, "h.at", "h.n", "h.gram", "h.canonical")


def expanded(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, names (distinct canonical names of the aliases that stand in the text, sorted), widened (the text with those names it doesn't hold appended).

    One row per row of texts, whose keys don't repeat.
    """
    found = longest_first(hits(texts, key, text, aliases), key)
    names = found.groupBy(key).agg(F.array_sort(F.collect_set("canonical")).alias("names"))
    own = texts.select(key, text).join(names, key, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    low = F.lower(F.col(text))
    new = F.filter("names", lambda x: ~low.contains(F.lower(x)))
    widened = F.when(F.size(new) > 0, F.concat(F.col(text), F.lit(" "), F.array_join(new, " "))).otherwise(F.col(text))
    return own.select(key, "names", widened.alias("widened"))
