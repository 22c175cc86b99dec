"""Problem 1: texts that look the same and differ in their characters.

Characters that show a reader the same glyph are mapped to one of them; the mapped values are grouped in SQL under the
accent-sensitive Unicode collation, in which characters without a glyph don't count and composed and combining accents are
one, while other letters, accents, cases, raised digits and blanks stay apart. The shortest plain member of a class (ties:
the first in binary order) is its canonical form and is joined back to all rows.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.session import cut_lineage

#: Letters and signs of other alphabets and styles, each with the Latin one whose glyph it shares.
LOOK_ALIKES = (
    # Cyrillic
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ԍG АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW ӏl үy "
    # Greek
    "αa οo νv ρp υu ιi ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    # Armenian
    "ոn սu օo հh զq ցg ՕO ՍU "
    # small capitals and other Latin letters
    "ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs ɡg ɑa ıi ᴜu ꭓx"
)
#: Characters without a glyph.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"


@cache
def look_alike_table() -> dict[str, str]:
    """Every mapped character with its replacement, built from Unicode's decompositions and LOOK_ALIKES.

    Of the compatibility decompositions only those count that leave the glyph alone: wide, narrow, font and no-break
    variants, blanks of any width, ligatures, Roman numerals, and the micro sign. Raised, lowered, enclosed and fractional
    ones can be seen and stay.
    """
    table = dict(pair for pair in LOOK_ALIKES.split())
    for point in range(0x110000):
        char = chr(point)
        parts = unicodedata.decomposition(char).split()
        if unicodedata.category(char) == "Zs":
            table[char] = " "
        elif parts and parts[0] in ("<wide>", "<narrow>", "<font>", "<noBreak>") or parts and parts[0] == "<compat>" and (0x2160 <= point <= 0x217F or 0xFB00 <= point <= 0xFB06):
            table[char] = "".join(chr(int(x, 16)) for x in parts[1:])
    table["μ"] = "µ"
    table["\u2010"] = table["\u2011"] = "-"
    del table[" "]
    for char in [chr(p) for p in range(0x80, 0x2000)]:
        plain = unicodedata.normalize("NFD", char)
        if len(plain) > 1 and plain[0] in table:
            composed = unicodedata.normalize("NFC", table[plain[0]] + plain[1:])
            if len(composed) == 1:
                table[char] = composed
    return table


def look_alikes_mapped(text: Column) -> Column:
    """The text with every look-alike replaced; an expression without Python code.

    Only texts with a character that may be one are gone through.
    """
    table = look_alike_table()
    mapped = text
    for char, letters in table.items():  # ligatures and numerals
        if len(letters) > 1:
            mapped = F.replace(mapped, F.lit(char), F.lit(letters))
    single = {c: r for c, r in table.items() if len(r) == 1 and ord(c) < 0x10000}
    beyond = {c: r for c, r in table.items() if len(r) == 1 and ord(c) >= 0x10000}
    mapped = F.translate(mapped, "".join(single), "".join(single.values()))
    if beyond:
        rare = F.translate(mapped, "".join(beyond), "".join(beyond.values()))
        mapped = F.when(text.rlike("[\\x{1D400}-\\x{1FBFF}]"), rare).otherwise(mapped)
    low = "".join(f"\\x{{{ord(c):X}}}" for c in table if ord(c) < 0x100)
    return F.when(text.rlike(f"[{low}\\x{{100}}-\\x{{10FFFF}}]"), mapped).otherwise(text)


def _id(column: str) -> Column:
    """128 bits that stand for a value."""
    return F.unhex(F.md5(F.col(f"`{column}`").cast("string")))


def canonical_forms(values: DataFrame, column: str = "value") -> DataFrame:
    """(id, canonical) for each distinct value that isn't null; id is its MD5 digest.

    Members of a class have the same digits and blanks, as neither has another form that the collation calls equal; these are
    compared first, so that the collation decides between few values only. Each class is given its form where it is grouped.
    """
    once = values.select(F.col(f"`{column}`").alias("value")).filter("value is not null").distinct()
    mapped = once.select(_id("value").alias("id"), look_alikes_mapped(F.col("value")).alias("mapped"))
    keyed = mapped.select("id", "mapped", F.collate("mapped", "UNICODE").alias("class"), F.xxhash64(F.regexp_replace("mapped", "[^0-9 ]+", "")).alias("shape"))
    plain = F.translate("mapped", INVISIBLE, "")
    least = F.min(F.struct(F.octet_length(plain).alias("size"), plain.alias("plain"))).over(Window.partitionBy("shape", "class"))
    return keyed.select("id", least.getField("plain").alias("canonical"))


def _joined_back(df: DataFrame, columns: list[str], forms: DataFrame, names: list[str]) -> DataFrame:
    """df with the second column of ``forms`` (id, ...) for each of the columns, under the names."""
    out = df
    for i, (c, name) in enumerate(zip(columns, names)):
        out = out.withColumn(f"__id{i}", _id(c)).join(forms.toDF(f"__of{i}", name), F.col(f"__id{i}") == F.col(f"__of{i}"), "left").drop(f"__id{i}", f"__of{i}")
    return out


def _forms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Forms of the values of all the columns together, ready to be joined to each."""
    return cut_lineage(canonical_forms(df.select(F.explode(F.array(*(F.col(f"`{c}`") for c in columns))).alias("value"))))


def normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each of the columns in its canonical form, the same one for all of them together.

    Null stays null; a text of nothing but invisible characters becomes empty. Other columns, repeated rows and ties are
    left as they are. The form of a value depends on the look-alikes that stand in df, that two values have the same form
    doesn't. An empty table gives an empty table.
    """
    names = [f"__form{i}" for i in range(len(columns))]
    out = _joined_back(df, columns, _forms(df, columns), names)
    return out.select(*(F.col(names[columns.index(c)]).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def differing_only_in_characters(df: DataFrame, left: str, right: str) -> DataFrame:
    """The rows of df whose two columns have different characters and one canonical form."""
    unequal = df.filter(F.col(f"`{left}`") != F.col(f"`{right}`"))
    # only digests of the forms are joined back
    forms = _forms(unequal, [left, right]).select("id", _id("canonical").alias("form"))
    same = _joined_back(unequal, [left, right], forms, ["__left", "__right"]).filter(F.col("__left") == F.col("__right"))
    return same.drop("__left", "__right")
