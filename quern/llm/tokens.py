"""Encoding a corpus with a public tokenizer (problem 8), and token counts."""

from __future__ import annotations

import hashlib
import os
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import by_slices
from quern.llm.bpe import MergeAutomaton, WordCodes, WordCounts, load_ranks, split_words

#: Where the public vocabularies lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
_MADE: dict = {}


def _here(shared: tuple, kind: type):
    """The word table of this worker, made once from the broadcast automaton of a vocabulary."""
    digest, tables = shared
    if (kind, digest) not in _MADE:
        _MADE[kind, digest] = kind(MergeAutomaton(*tables))
    return _MADE[kind, digest]


def _shared(df: DataFrame, ranks: str):
    """(digest, the automaton's table), built once in the driver; its size is that of the vocabulary (about 1 MB)."""
    tables = load_ranks(ranks).tables()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(pickle.dumps(tables)).hexdigest(), tables))


def encode(df: DataFrame, text: str, key: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids): the token ids of each text, one row per input row, no special tokens.

    Null and empty texts give an empty list. Texts that look like special tokens are ordinary text. Repeated
    rows are encoded each. Very long texts are encoded whole; a task holds a few MB of texts at a time. Nothing
    is shuffled. Other columns are not read, so their names cannot clash.
    """
    shared = _shared(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _here(shared.value, WordCodes)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [b"".join(map(codes.__getitem__, split_words(t))) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            return pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

        yield from by_slices(one, batches, 1)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str, keep: list[str], ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The ``keep`` columns and n_tokens of each text (0 for null and empty ones), one row per input row."""
    shared = _shared(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _here(shared.value, WordCounts)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [sum(map(counts.__getitem__, split_words(t))) if t else 0 for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], [*keep, "n_tokens"])

        yield from by_slices(one, batches, 0)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(text).alias("text"), *keep).mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode(df: DataFrame, ids: str, key: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, text): the labels of the ids' arcs, joined; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""
    shared = _shared(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _here(shared.value, WordCodes).automaton
        for batch in batches:
            texts = [automaton.decode(i or []).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
