"""Exact token counts of every prefix of every text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.llm.bpe import prefix_counter


def _rows(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            row = 0
            held: list = []
            size = 0
            for counts in counter.counts(batch.column(at)):
                held.append(counts)
                size += len(counts)
                if size > 1 << 20:
                    yield _batch(batch, row, held)
                    row += len(held)
                    held, size = [], 0
            if held:
                yield _batch(batch, row, held)

    return run


def _batch(batch: pa.RecordBatch, row: int, held: list) -> pa.RecordBatch:
    import numpy as np

    ends = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
    table = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
    part = batch.slice(row, len(held))
    return pa.RecordBatch.from_arrays([*part.columns, table], [*part.schema.names, "prefix_tokens"])


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs with prefix_tokens: at i the number of tokens of the first i code points.

    path is a byte-level BPE file of the tokenizers library; counts are the
    library's without added special tokens.  A null text counts as empty: one
    entry, 0.  All rows and columns stay (one named prefix_tokens is replaced);
    repeated rows get equal counts; an empty table gives an empty one.
    """
    docs = docs.drop("prefix_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_rows(path, docs.columns.index("text")), schema)


def tokens_of(counts: Column, chars: Column | int | None = None) -> Column:
    """Tokens of the first chars code points, of the whole text without chars."""
    if chars is None:
        return F.element_at(counts, -1).cast("long")
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.get(counts, F.least(chars, F.size(counts) - 1)).cast("long")


def longest_within(counts: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most budget tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(counts, lambda c, i: F.when(c <= budget, i))
    return F.array_max(fits).cast("long")
