"""Problem 6: the whole corpus as ids of a public tokenizer.

The vocabulary file is named by a parameter and read on the driver; its bytes (1.6 MB, fixed) go to the workers as a
broadcast variable. Texts are encoded where they are read: one narrow stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm import bpe
from sonoframe.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _map_texts(df: DataFrame, text: str, tokenizer_path: str, out: T.StructField, to_column: Callable) -> DataFrame:
    """The rows of df with its text column replaced by ``out``, which ``to_column`` makes of an encoder and the pre-tokens."""
    kept = [f for f in df.schema.fields if f.name != text]
    vocabulary = df.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches):
        encoder = bpe.encoder_for(vocabulary.value)
        texts = ((batch.select(range(len(kept))), batch.column(len(kept)).to_pylist()) for batch in batches)
        for batch, numbers, per_text in encoder.partition(texts):
            column = to_column(encoder, numbers, per_text)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), column], [*(f.name for f in kept), out.name])

    narrow = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias("__text"))
    return spread(narrow).mapInArrow(run, T.StructType([*kept, out]))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", tokenizer_path: str = TOKENIZER) -> DataFrame:
    """One row ``key, out`` per row of df, ``out`` being the ids of the text without special tokens.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary text. Rows that come
    twice come out twice, null keys stay null, other columns are not read. An empty table gives an empty result.
    """

    def ids(encoder: bpe.Encoder, numbers: np.ndarray, per_text: np.ndarray) -> pa.Array:
        return bpe.ids_array(encoder.ids(numbers), encoder.sizes(numbers, per_text))

    narrow = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    field = T.StructField("__ids", T.ArrayType(T.IntegerType(), True), True)
    return _map_texts(narrow, "__text", tokenizer_path, field, ids).toDF(key, out)


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer_path: str = TOKENIZER) -> DataFrame:
    """df with its text column replaced by the number of its tokens (0 for null and empty texts)."""

    def count(encoder: bpe.Encoder, numbers: np.ndarray, per_text: np.ndarray) -> pa.Array:
        return pa.array(encoder.sizes(numbers, per_text), pa.int64())

    return _map_texts(df, text, tokenizer_path, T.StructField(out, T.LongType(), True), count)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", tokenizer_path: str = TOKENIZER) -> DataFrame:
    """encoded with its ids replaced by the text that they stand for; null ids give null, an empty list an empty text.

    Ids that aren't whole characters together, as cut lists may be, give replacement characters.
    """
    kept = [f for f in encoded.schema.fields if f.name != ids]
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches):
        pieces = bpe.token_bytes(vocabulary.value)
        for batch in batches:
            texts = [None if x is None else b"".join(map(pieces.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], [*(f.name for f in kept), out])

    narrow = encoded.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{ids}`"))
    return narrow.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType(), True)]))
