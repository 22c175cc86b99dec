"""Text functions for DataFrames: Arrow batches in, Arrow arrays out. Null in any argument gives null.

Equal arguments are worked out once per batch: recordings of one sample repeat their texts.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

from sonoframe.session import spread
from sonoframe.text import critical, loops, numbers, postcorrect, scoring, sentences, spoken

_STEP = "array<struct<kind: string, reference: string, hypothesis: string>>"
COMPARISON = (
    "struct<wer: double, cer: double, reference_words: bigint, hypothesis_words: bigint, substitutions: bigint, deletions: bigint, insertions: bigint, "
    f"diff: {_STEP}, normalized_reference: string, normalized_hypothesis: string>"
)
FLAGS = "array<struct<kind: string, severity: string, expected: string, found: string, message: string>>"
OUTCOMES = "array<struct<kind: string, text: string, found: boolean>>"
STATUSES = "array<struct<word: string, correct: boolean, heard: string>>"
CORRECTED = "struct<text: string, changes: array<struct<`from`: string, `to`: string, distance: bigint>>>"
PLAN = "array<struct<text: string, spoken: string, start: bigint, end: bigint, paragraph_end: boolean>>"
SENTENCES = "array<struct<text: string, start: bigint, end: bigint, paragraph_end: boolean>>"


def _frozen(x):
    return tuple(map(_frozen, x)) if isinstance(x, list) else tuple(x.items()) if isinstance(x, dict) else x


def _applied(function: Callable, kind: pa.DataType, columns: tuple[pa.Array, ...]) -> pa.Array:
    seen, out = {}, []
    for row in zip(*(c.to_pylist() for c in columns)):
        if any(x is None for x in row):
            out.append(None)
            continue
        key = _frozen(list(row))
        if key not in seen:
            seen[key] = function(*row)
        out.append(seen[key])
    return pa.array(out, type=kind)


def on_batches(function: Callable, returns: str | DataType, arity: int) -> Callable[..., Column]:
    """A DataFrame function of a plain function of ``arity`` arguments."""
    spark_type: list[DataType] = []

    def build():
        kind = _parse_datatype_string(returns) if isinstance(returns, str) else returns
        arrow = to_arrow_type(kind)
        if arity == 1:

            def run(a: pa.Array) -> pa.Array:
                return _applied(function, arrow, (a,))
        elif arity == 2:

            def run(a: pa.Array, b: pa.Array) -> pa.Array:
                return _applied(function, arrow, (a, b))
        else:

            def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
                return _applied(function, arrow, (a, b, c))

        return F.arrow_udf(run, kind)

    def call(*columns: Column | str) -> Column:
        if not spark_type:
            spark_type.append(build())
        return spark_type[0](*columns)

    return call


def _pairs(terms: list[dict]) -> list[tuple[str, str]]:
    return [(t["text"], t["kind"] or "term") for t in terms]


normalize_words = on_batches(scoring.normalize_words, "array<string>", 1)
fold_numbers = on_batches(numbers.fold_numbers, "array<string>", 1)
simple_words = on_batches(scoring.simple_words, "array<string>", 1)
compare_texts = on_batches(scoring.compare_texts, COMPARISON, 2)
simple_wer = on_batches(scoring.simple_wer, "double", 2)
word_statuses = on_batches(lambda a, b: [{"word": w, "correct": c, "heard": h} for w, c, h in scoring.word_statuses(a, b)], STATUSES, 2)
critical_flags = on_batches(lambda a, b, terms: critical.analyze(a, b, _pairs(terms)), FLAGS, 3)
term_outcomes = on_batches(
    lambda a, b, terms: [{"kind": k, "text": t, "found": f} for k, t, f in critical.term_outcomes(_pairs(terms), critical.analyze(a, b, _pairs(terms)))], OUTCOMES, 3
)
key_words = on_batches(lambda terms: sorted(critical.key_words(_pairs(terms))), "array<string>", 1)
split_sentences = on_batches(lambda text: [vars(s) for s in sentences.split_sentences(text)], SENTENCES, 1)
spoken_text = on_batches(spoken.normalise, "string", 2)
plan_sentences = on_batches(lambda text, language: [vars(s) | {"spoken": spoken.normalise(s.text, language)} for s in sentences.split_sentences(text)], PLAN, 2)
max_repeat = on_batches(lambda text: dict(zip(("repeats", "size"), loops.max_repeat(loops.words(text)))), "struct<repeats: bigint, size: bigint>", 1)
has_loop = on_batches(loops.has_loop, "boolean", 2)
ending_missing = on_batches(loops.ending_missing, "boolean", 2)


def once(df: DataFrame, inputs: list[str], **made: Column) -> DataFrame:
    """df with columns made of ``inputs`` only, each worked out once for every distinct value of the inputs.

    For functions that cost more than a shuffle: texts repeat over runs and repetitions. Values are joined back by 128 bits of
    hash; null inputs have their own.
    """
    known = [x for c in inputs for x in (F.col(c), F.col(c).isNull())]
    keyed = df.withColumns({"__a": F.xxhash64(*known), "__b": F.xxhash64(F.lit(11), *known[::-1])})
    distinct = spread(keyed.select("__a", "__b", *inputs).distinct())
    worked = distinct.select("__a", "__b", *(c.alias(n) for n, c in made.items()))
    return keyed.join(worked, ["__a", "__b"], "left").select(*df.columns, *made)


def post_correct(text: Column | str, terms: list[str], preset: str = "strict") -> Column:
    """struct(text, changes). The vocabulary goes to the workers with the function; it is checked to be a word list."""
    if len(terms) > 100_000:
        raise ValueError("a vocabulary has at most 100,000 terms")
    rules = postcorrect.PRESETS[preset]

    def run(value: str) -> dict:
        corrected, changes = postcorrect.correct(value, terms, rules)
        return {"text": corrected, "changes": changes}

    return on_batches(run, CORRECTED, 1)(text)
