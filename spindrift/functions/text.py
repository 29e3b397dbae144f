"""Column expressions over query and document text; all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_JAVA_SPECIAL = re.compile(r"([\\.\[\]{}()*+?^$|&/-])")


def quoted(text: str) -> str:
    """text as a literal inside a Java regular expression."""
    return _JAVA_SPECIAL.sub(r"\\\1", text)


def cleaned(c: Column) -> Column:
    """Null as "", white space at both ends removed."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def or_null(c: Column) -> Column:
    """"" as null."""
    return F.nullif(c, F.lit(""))


def first_match(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Label of the first (label, pattern) that occurs in the lower-cased text, else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(label)) for label, p in patterns])


def all_matches(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Labels of all (label, pattern) that occur in the lower-cased text, in order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(label)) for label, p in patterns]))


def consumed(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Distinct names of the (pattern, name) that occur, each match being blanked before the next pattern is tried.

    A fold over the patterns as an array: the plan holds the text expression once, however many patterns there are.
    """
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in patterns])
    start = F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("rest"), F.array().cast("array<string>").alias("names"))
    return F.array_distinct(
        F.aggregate(
            table, start,
            lambda s, x: F.when(
                F.regexp_like(s["rest"], x["p"]),
                F.struct(F.regexp_replace(s["rest"], x["p"], F.lit(" ")).alias("rest"), F.concat(s["names"], F.array(x["n"])).alias("names")),
            ).otherwise(s),
            lambda s: s["names"],
        )
    )


def _longest_first(aliases: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(aliases, key=lambda a: -len(a[0]))


def countries(text: Column) -> Column:
    return consumed(text, [(rf"\b{quoted(a)}\b", n) for a, n in _longest_first(K.COUNTRIES)])


def states(text: Column) -> Column:
    return consumed(text, [(rf"\b{quoted(a)}\b", n) for a, n in _longest_first(K.STATES)])


def sponsors(text: Column) -> Column:
    """Names with & or - count anywhere, the others as whole words."""
    return consumed(text, [(quoted(a) if set(a) & set("&-") else rf"\b{quoted(a)}\b", n) for a, n in _longest_first(K.SPONSORS)])


def drug_classes_named(text: Column) -> Column:
    return consumed(text, [(rf"(?<![a-z0-9]){quoted(a)}(?![a-z0-9])", n) for a, n in _longest_first(K.CLASS_WORDS)])


def statuses(text: Column) -> Column:
    return consumed(text, [(p, n) for n, p in K.STATUSES])


def study_type(text: Column) -> Column:
    return first_match(text, K.STUDY_TYPES)


def disease(text: Column) -> Column:
    return first_match(text, K.DISEASES)


def phase(text: Column) -> Column:
    return first_match(text, K.PHASES)


def one_status(text: Column) -> Column:
    return first_match(text, K.ONE_STATUS)


def short_population(text: Column) -> Column:
    return F.coalesce(first_match(text, K.SHORT_POPULATIONS), F.lit(""))


def setting_intent(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike(K.NEOADJUVANT), "neoadjuvant").when(low.rlike(K.ADJUVANT) | low.rlike(K.EARLY_INTENT), "adjuvant").when(low.rlike(K.METASTATIC), "metastatic")
    )


def matches_setting(text: Column, setting: str) -> Column:
    """Whether a population text fits a setting; for adjuvant also whatever is not metastatic."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if setting == "metastatic":
        return low.rlike(K.METASTATIC)
    if setting == "neoadjuvant":
        return low.rlike(K.NEOADJUVANT)
    return low.rlike(K.ADJUVANT) | low.rlike(K.NEOADJUVANT) | low.rlike(K.EARLY) | ~low.rlike(K.METASTATIC)


def drug_classes(*names: Column) -> Column:
    """Classes whose drugs occur in intervention names and aliases."""
    return all_matches(F.concat_ws(" || ", *[F.coalesce(n, F.lit("")) for n in names]), K.CLASS_PATTERNS)


def holds_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether any of the parts occurs in the text, upper and lower case alike."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in parts], F.lit(False))


def has_all(own: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), own)) == 0


def has_any(own: Column, wanted: Sequence[str]) -> Column:
    """True as well if nothing is wanted."""
    return F.arrays_overlap(own, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def asks_for_earlier_protocol(text: Column) -> Column:
    return holds_any(text, K.EARLIER_PROTOCOL)


def with_drugs(text: Column, classes: Column) -> Column:
    """The text with the drugs of its classes appended, but those it names."""
    drugs = F.create_map(*[F.lit(x) for name, names in K.CLASS_DRUGS.items() for x in (name, "|".join(names))])
    listed = F.flatten(F.transform(classes, lambda c: F.split(F.coalesce(drugs[c], F.lit("")), r"\|")))
    extra = F.array_distinct(F.filter(listed, lambda d: (d != "") & ~F.lower(text).contains(F.lower(d))))
    return F.when(F.size(extra) > 0, F.concat(text, F.lit(" "), F.array_join(extra, " "))).otherwise(text)


def with_aliases(text: Column, aliases: Column) -> Column:
    """The text with the canonical names of its aliases appended; aliases: array of struct(alias, canonical). Names in the text are not repeated."""
    hit = F.filter(aliases, lambda a: F.regexp_like(F.lower(text), F.concat(F.lit(r"\b\Q"), F.lower(a["alias"]), F.lit(r"\E\b"))))
    names = F.filter(F.transform(hit, lambda a: a["canonical"]), lambda n: ~F.lower(text).contains(F.lower(n)))
    distinct = F.aggregate(
        names, F.array().cast("array<string>"),
        lambda s, n: F.when(F.exists(s, lambda x: F.lower(x) == F.lower(n)), s).otherwise(F.concat(s, F.array(n))),
    )
    return F.when(F.size(distinct) > 0, F.concat(text, F.lit(" "), F.array_join(distinct, " "))).otherwise(text)


def criteria(text: Column) -> tuple[Column, Column]:
    """(inclusion, exclusion) parts of an eligibility text, each with its heading; an exclusion that comes first leaves inclusion empty."""
    text = F.coalesce(text, F.lit(""))
    inc, exc = F.instr(text, "Inclusion Criteria"), F.instr(text, "Exclusion Criteria")
    start = F.greatest(inc, F.lit(1))
    stop = F.when(exc > 0, exc).otherwise(F.length(text) + 1)
    including = F.when(stop > start, F.substring(text, start, stop - start)).otherwise("")
    excluding = F.when(exc > 0, F.substring(text, exc, F.length(text))).otherwise("")
    return cleaned(including), cleaned(excluding)


def protocol_title(phase_: Column, conditions: Column, intervention: Column, title: Column) -> Column:
    """phase — population — intervention from what there is, else the title, else "Untitled protocol"."""
    phase_, conditions, intervention, title = map(cleaned, (phase_, conditions, intervention, title))
    head = F.when(F.upper(phase_) == "N/A", "RWE").otherwise(or_null(phase_))
    population = F.coalesce(or_null(short_population(conditions)), or_null(short_population(title)))
    drug = or_null(F.substring(cleaned(F.regexp_extract(intervention, r"^([^/(]*)", 1)), 1, 50))
    joined = or_null(F.concat_ws(" — ", head, population, drug))
    return F.coalesce(joined, or_null(F.substring(title, 1, 80)), F.lit("Untitled protocol"))


def label_of(value: Column, labels: dict[str, str]) -> Column:
    """Display label, else the value itself, else "Unspecified"."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(table[value], or_null(value), F.lit("Unspecified"))


def shortened(text: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def week_change(this: Column, last: Column) -> Column:
    """Change in per cent with its sign; "—" if both are zero, "(new)" if only the last is."""
    change = F.try_divide((this - last) * 100.0, last)
    shown = F.format_string("%.1f%%", F.abs(change))
    return (
        F.when((F.coalesce(this, F.lit(0)) == 0) & (F.coalesce(last, F.lit(0)) == 0), "—").when(F.coalesce(last, F.lit(0)) == 0, "(new)")
        .otherwise(F.concat(F.when(change >= 0, "+").otherwise("−"), shown))
    )


def bar_percent(count: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(F.try_divide(count * 100.0, total) + 0.5).cast("int")).otherwise(0)


def age_text(ts: Column, now: Column) -> Column:
    """"just now", minutes, hours or days ago, else the date; "" without a time."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 60)
    return (
        F.when(ts.isNull(), "").when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 24 * 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .when(minutes < 30 * 24 * 60, F.concat(F.floor(minutes / (24 * 60)).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def confirms(text: Column) -> Column:
    """Whether a message tells to apply the proposed changes."""
    norm = cleaned(F.regexp_replace(F.regexp_replace(F.lower(cleaned(text)), r"[.!?]+$", ""), r"\s+", " "))
    return F.regexp_like(norm, F.lit("^(" + "|".join(f"({f})" for f in K.CONFIRMATIONS) + ")$"))


def ids_named(text: Column) -> Column:
    """Registry numbers in a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"\bNCT\d{8}\b"), 0)


def user_key(user: Column) -> Column:
    """A user id that is safe as a folder name; blank ids are "anonymous"."""
    return F.coalesce(or_null(F.substring(F.regexp_replace(cleaned(user), r"[^A-Za-z0-9._-]", "_"), 1, 128)), F.lit("anonymous"))


def unfenced(raw: Column) -> Column:
    """A model's reply without the code fence around it."""
    return cleaned(F.regexp_replace(F.regexp_replace(cleaned(raw), r"^```[^\n]*\n", ""), r"\n?```\s*$", ""))


def refined_reply(raw: Column) -> tuple[Column, Column, Column]:
    """(JSON text, changed fields, note) of a reply that ends in CHANGES: and NOTE: lines; the last of each counts."""
    text = unfenced(raw)
    head = F.regexp_replace(text, r"(?s)\nNOTE:(?!.*\nNOTE:).*$", "")
    note = cleaned(F.regexp_extract(text, r"(?s)^.*\nNOTE:(.*)$", 1))
    body = F.regexp_replace(head, r"(?s)\nCHANGES:(?!.*\nCHANGES:).*$", "")
    changes = F.regexp_extract(head, r"(?s)^.*\nCHANGES:(.*)$", 1)
    return cleaned(body), F.filter(F.transform(F.split(changes, ","), cleaned), lambda c: c != ""), note


def choices(text: Column) -> tuple[Column, Column]:
    """(text without the block, choices) of a message with a [CHOICES] block of "- " lines."""
    tag = r"(?is)\[CHOICES\]\s*(.*?)\s*\[/CHOICES\]"
    lines = F.transform(F.split(F.regexp_extract(text, tag, 1), "\n"), cleaned)
    named = F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: cleaned(F.substring(x, 3, 1_000_000)))
    return cleaned(F.regexp_replace(text, tag, "")), F.filter(named, lambda c: c != "")


def apply_directive(text: Column) -> tuple[Column, Column]:
    """(text without the tag, what to apply or null) of a message."""
    tag = r"(?i)\[APPLY_PROTOCOL_CHANGES\]\s*apply:\s*([^\n\[]+?)\s*\[/APPLY_PROTOCOL_CHANGES\]"
    found = F.regexp_like(text, F.lit(tag))
    return cleaned(F.regexp_replace(text, tag, "")), F.when(found, F.coalesce(or_null(cleaned(F.regexp_extract(text, tag, 1))), F.lit("all")))


def markup_escaped(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def field_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def change_class(this: Column, last: Column) -> Column:
    return F.when(this > last, "up").when(this < last, "down").otherwise("flat")


def kept_ids(ids: Column, most: int = 25) -> Column:
    """First `most` trimmed ids that are not empty."""
    return F.slice(F.filter(F.transform(ids, cleaned), lambda i: i != ""), 1, most)


def file_name(title: Column) -> Column:
    """A protocol's title as a file's name, "protocol" for a blank one."""
    return F.coalesce(or_null(cleaned(title)), F.lit("protocol"))


def with_population(text: Column, population: Column) -> Column:
    """The query with the population known so far in front, unless it names one itself."""
    return F.when(disease(text).isNull() & (cleaned(population) != ""), F.concat(cleaned(population), F.lit(" — "), text)).otherwise(text)


def bulleted(items: Column) -> Column:
    """A list of texts as lines with bullets, blank ones left out."""
    return F.array_join(F.transform(F.filter(F.transform(items, cleaned), lambda x: x != ""), lambda x: F.concat(F.lit("• "), x)), "\n")


def version_label(version: Column) -> Column:
    """v1 (original), v2, …"""
    return F.concat(F.lit("v"), version.cast("string"), F.when(version == 1, " (original)").otherwise(""))
