"""Blocks of postings: the entries of a term in neighbouring chunks, with the bounds by which a search judges them.

Words become entries where the texts are: they are numbered, sorted as numbers and cut into blocks, an Arrow batch
of chunks at a time. No row is made for a posting, and none is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.stem import STOP_WORDS
from marginalia.operators.keywords import field_words

#: A block holds the chunks whose ids agree but for this many low bits.
BLOCK_BITS = 6
#: Words that are sorted at once, where more than one chunk has them.
_RUN = 1 << 19
#: Rows that are handed on at once.
_HANDED = 1 << 14

BLOCK = (
    "bucket int, term string, block long, chunks long, most long, top double, heavy double, "
    "size long, entries array<struct<id:bigint,position:int,weight:double>>"
)


def posting_blocks(chunks: DataFrame, english: bool, fields: tuple[tuple[str, float], ...]) -> DataFrame:
    """Rows ``BLOCK`` of chunks (id, bucket, the fields). A block whose chunks lie in several batches has a row for each."""
    listed = [f"_listed{n}" for n in range(len(fields) - 1)]
    words = [f"_words{n}" for n in range(len(fields))]
    staged = field_words(chunks, ["id", "bucket"], english, fields).select("id", "bucket", *listed, *words)
    weights = np.array([weight for _, weight in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([_sizes(batch.column(name)) for name in words])
            ends = np.cumsum(sizes.sum(axis=0))
            start = 0
            while start < len(batch):
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + _RUN, "right")))
                part = batch.slice(start, end - start)
                last = [part.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in listed]
                found = _sorted_blocks(
                    part.column("id"), part.column("bucket"), [part.column(name) for name in words],
                    sizes[:, start:end], np.array(last).reshape(len(listed), end - start), weights, english,
                )
                for at in range(0, len(found), _HANDED):
                    yield found.slice(at, _HANDED)
                start = end

    return staged.mapInArrow(run, BLOCK)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before in any of the columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the groups of neighbouring rows that agree in all columns."""
    marks = np.zeros(len(columns[0]), dtype=np.int64)
    marks[_changes(*columns)] = 1
    return np.cumsum(marks)


def _sorted_blocks(
    ids: pa.Array, buckets: pa.Array, words: list[pa.Array], sizes: np.ndarray, listed: np.ndarray, weights: np.ndarray, english: bool
) -> pa.RecordBatch:
    """The blocks of chunks that are sorted by bucket and id, by term and place of the chunk. ``sizes`` and ``listed`` are per field and chunk."""
    encoded = pa.concat_arrays([lists.flatten() for lists in words]).cast(pa.string()).dictionary_encode()
    by_term = pc.sort_indices(encoded.dictionary).to_numpy()
    code_of = np.empty(len(by_term), dtype=np.int64)
    code_of[by_term] = np.arange(len(by_term))
    terms = encoded.dictionary.take(pa.array(by_term))
    codes = code_of[encoded.indices.to_numpy()]

    # Per field and chunk the place of the first word among all of the chunk, and what to add to a place for the position.
    none = np.zeros((1, sizes.shape[1]), dtype=np.int64)
    begins = np.concatenate([none, np.cumsum(sizes[:-1], axis=0)])
    shifts = np.concatenate([none, np.cumsum(listed, axis=0)]) - begins + 1
    flat = sizes.ravel()
    chunk = np.repeat(np.tile(np.arange(sizes.shape[1]), len(words)), flat)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(flat) - flat - begins.ravel(), flat)
    if english:
        kept = ~np.isin(codes, np.flatnonzero(pc.is_in(terms, value_set=pa.array(sorted(STOP_WORDS), pa.string())).to_numpy(zero_copy_only=False)))
        codes, chunk, place = codes[kept], chunk[kept], place[kept]

    # Term, chunk and place are one number, so that what is sorted tells all.
    place_bits = int(sizes.sum(axis=0).max(initial=0)).bit_length()
    chunk_bits = sizes.shape[1].bit_length()
    keys = np.sort((((codes << chunk_bits) | chunk) << place_bits) | place)
    place = keys & ((1 << place_bits) - 1)
    chunk = (keys >> place_bits) & ((1 << chunk_bits) - 1)
    code = keys >> (place_bits + chunk_bits)

    field = np.zeros(len(keys), dtype=np.int64)
    for begin in begins[1:]:
        field += place >= begin[chunk]
    weight = weights[field]
    position = place + shifts[field, chunk]

    missing = ids.is_null().to_numpy(zero_copy_only=False)
    id_of = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    bucket_of = buckets.to_numpy(zero_copy_only=False)
    own = _changes(code, _groups(missing, bucket_of, id_of)[chunk])
    starts = _changes(code, _groups(missing, bucket_of, id_of >> BLOCK_BITS)[chunk])
    first = np.searchsorted(own, starts)
    count = np.diff(own, append=len(keys))
    whole = lambda kind, per, at: kind.reduceat(per, at) if len(at) else per[:0]
    at = chunk[starts]
    entries = pa.StructArray.from_arrays(
        [
            pa.array(id_of[chunk], mask=missing[chunk]),
            pa.array(position.astype(np.int32)),
            pa.array(weight),
        ],
        names=["id", "position", "weight"],
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket_of[at].astype(np.int32)),
            terms.take(pa.array(code[starts])),
            pa.array(id_of[at] >> BLOCK_BITS, mask=missing[at]),
            pa.array(np.diff(first, append=len(own))),
            pa.array(whole(np.maximum, count, first)),
            pa.array(whole(np.maximum, whole(np.add, weight, own), first)),
            pa.array(whole(np.maximum, weight, starts)),
            pa.array(np.diff(starts, append=len(keys))),
            pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), entries),
        ],
        names=["bucket", "term", "block", "chunks", "most", "top", "heavy", "size", "entries"],
    )
