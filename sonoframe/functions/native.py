"""Twins of text functions as plain expressions, which stay in the JVM. Each takes and gives columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoframe.text.critical import DATE_WORDS, NEGATIONS
from sonoframe.text.numbers import UNIT_OF

_NUMERIC = r"^[0-9]+([.,][0-9]+)*$"


def scoring_words(text: Column) -> Column:
    """Words for scoring before numbers and units are brought to one spelling."""
    plain = F.lower(F.translate(text, "’‘`", "'''"))
    for pattern, by in ((r"(?<![0-9])[.,]|[.,](?![0-9])", " "), (r"[^\p{IsAlphabetic}\p{N}%'.,]", " "), (r"(?<=[0-9])(?=[^0-9.,' ])|(?<=%)(?=[^%' ])|(?<=\p{IsAlphabetic})(?=[^\p{IsAlphabetic}' ])", " ")):
        plain = F.regexp_replace(plain, pattern, by)
    return F.filter(F.transform(F.split(plain, " +"), lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")


def unify_percent(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), " (pour|per) cent(?= )", " %"), " (pourcent|percent)(?= )", " %"))


def spoken_decimals(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![^ ])([0-9]+) (?:virgule|point) ([0-9]+)(?![^ ])", "$1.$2")


def is_numeric(token: Column) -> Column:
    return token.rlike(_NUMERIC)


def canonical_number(token: Column) -> Column:
    """Thousands joined, a point for decimals, no leading zeros."""
    bare = lambda c: F.regexp_replace(c, "^0+(?=[0-9])", "")
    grouped = token.rlike(r"^[1-9][0-9]{0,2}([.,][0-9]{3}){2,}$") | token.rlike(r"^[1-9][0-9]{1,2}[.,][0-9]{3}$")
    single = token.rlike(r"^[0-9]+[.,][0-9]+$")
    joined = F.regexp_replace(token, "[.,]", "")
    return F.when(~is_numeric(token), token).when(single & ~grouped, bare(F.translate(token, ",", "."))).otherwise(bare(joined))


def canonical_unit(token: Column) -> Column:
    """The unit's one spelling, null for other words."""
    return F.create_map(*(F.lit(x) for pair in UNIT_OF.items() for x in pair))[token]


def negation_count(tokens: Column) -> Column:
    strong = F.size(F.filter(tokens, lambda t: t.isin(*sorted(NEGATIONS)) | t.endswith("n't")))
    weak = F.exists(tokens, lambda t: (t == "ne") | t.startswith("n'")).cast("int")
    return F.when(strong > 0, strong).otherwise(weak)


def date_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.isin(*sorted(DATE_WORDS)))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def split_elisions(tokens: Column) -> Column:
    return F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, "'"))), lambda p: p != "")


def fold_accents(text: Column) -> Column:
    folded = F.translate(F.lower(text), "àâäáãéèêëîïíôöóõùûüúçÿ", "aaaaaeeeeiiioooouuuucy")
    return F.replace(F.replace(folded, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def is_protected(word: Column) -> Column:
    lower = F.lower(word)
    return word.rlike("[0-9]") | lower.isin(*sorted(NEGATIONS)) | lower.isin(*sorted(DATE_WORDS)) | canonical_unit(lower).isNotNull()


def sanitize_id(text: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9_]", "-"), "-+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 60)


def clean_reference(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\s+", " "))


def vocabulary_prompt(terms: Column) -> Column:
    trimmed = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.size(trimmed) > 0, F.concat(F.array_join(trimmed, ", "), F.lit(".")))


def digits_one_by_one(text: Column, names: list[str]) -> Column:
    """Each digit's name, blanks between them."""
    named = F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("^[0-9]$")), lambda c: F.element_at(F.array(*map(F.lit, names)), c.cast("int") + 1))
    return F.array_join(named, " ")
