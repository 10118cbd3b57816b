"""Cover density ranks of gathered hits, in one pass over Arrow batches.

The hits of a query in a chunk are a list of entries in position order. A unit of the query (a word or
a phrase) ends at some of them; an alternative is reached at an entry when each of its units has ended
by then, and its stretch begins where the earliest of their latest occurrences does. A stretch that
begins later than all before it is a cover. All rows of a query in a batch are worked on together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of a query as Python values: (alternative, negated, [(number of the key, offset)]).
Unit = tuple[int, bool, list[tuple[int, int]]]


def _starts(unit: Unit, keys: np.ndarray, positions: np.ndarray, first_of: np.ndarray) -> np.ndarray:
    """Per entry, where the occurrence of the unit that ends there starts, else -1. ``first_of`` is the
    first entry of the entry's row."""
    terms = unit[2]
    size, (last_key, last_offset) = len(terms), terms[-1]
    at = np.arange(len(keys))
    fits = (keys == last_key) & (at - first_of >= size - 1)
    for back, (key, offset) in enumerate(reversed(terms[:-1]), 1):
        earlier = np.maximum(at - back, 0)
        fits &= (keys[earlier] == key) & (positions[earlier] == positions - (last_offset - offset))
    return np.where(fits, at - size + 1, -1)


def cover_ranks(
    units: list[Unit], keys: np.ndarray, positions: np.ndarray, weights: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """The rank of each row, 0 for rows that do not satisfy the query.

    The entries of all rows stand one after the other, ``sizes`` per row, by position within a row.
    """
    rows = np.repeat(np.arange(len(sizes)), sizes)
    alternatives: dict[int, list[int]] = {}
    for number, unit in enumerate(units):
        alternatives.setdefault(unit[0], []).append(number)

    firsts = (np.cumsum(sizes) - sizes)[rows]
    present = np.zeros((len(units), len(sizes)), bool)
    for number, unit in enumerate(units):
        present[number, rows[_starts(unit, keys, positions, firsts) >= 0]] = True
    alive = {
        name: np.logical_and.reduce([present[n] != units[n][1] for n in members])
        for name, members in alternatives.items()
        if not all(units[n][1] for n in members)
    }

    # Words that are only asked not to occur are no part of any stretch.
    wanted = sorted({key for _, negated, terms in units if not negated for key, _ in terms})
    kept = np.isin(keys, wanted)
    keys, positions, weights, rows = keys[kept], positions[kept], weights[kept], rows[kept]
    sizes = np.bincount(rows, minlength=len(sizes))
    firsts = (np.cumsum(sizes) - sizes)[rows]

    latest = {}
    for number, unit in enumerate(units):
        if not unit[1]:
            found = np.maximum.accumulate(_starts(unit, keys, positions, firsts)) if len(keys) else keys
            latest[number] = np.where(found >= firsts, found, -1)
    start = np.full(len(keys), -1)
    for name, ok in alive.items():
        reached = np.minimum.reduce([latest[n] for n in alternatives[name] if not units[n][1]])
        start = np.maximum(start, np.where(ok[rows], reached, -1))

    before = np.concatenate([[-1], np.maximum.accumulate(start)[:-1]]) if len(start) else start
    cover = np.flatnonzero((start >= 0) & (start > np.where(before >= firsts, before, -1)))
    begins = start[cover]
    # Sums over all rows of a batch: with the usual precision, differences of them would lose digits.
    inverse = np.cumsum(1.0 / weights.astype(np.longdouble))
    held = inverse[cover] - inverse[begins] + 1.0 / weights[begins]
    count = cover - begins + 1
    noise = np.maximum(positions[cover] - positions[begins] - (count - 1), 0)
    gain = (count / held / (noise + 1)).astype(np.float64)
    return np.bincount(rows[cover], gain, len(sizes))


def rank_covers(found: DataFrame, id_type: str, query_type: str) -> DataFrame:
    """(query_id, id, keyword_rank) for rows (query_id, id, entries, keys, units) that satisfy their query.

    entries: array of (position, key number, weight); keys: the query's keys, which the numbers count
    from 0; units: as ``parse_queries`` gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch.columns, names=["query_id", "id", "entries", "keys", "units"])
            codes = pc.dictionary_encode(table.column("query_id").combine_chunks()).indices.to_numpy(zero_copy_only=False)
            ranks = np.zeros(len(table))
            order = np.argsort(codes, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                if len(group):
                    ranks[group] = _ranks_of(table.take(pa.array(group)))
            some = ranks > 0
            yield pa.RecordBatch.from_arrays(
                [*(table.column(n).combine_chunks().filter(pa.array(some)) for n in ("query_id", "id")), pa.array(ranks[some])],
                names=["query_id", "id", "keyword_rank"],
            )

    rows = found.select("query_id", "id", "entries", "keys", "units")
    return rows.mapInArrow(run, f"query_id {query_type}, id {id_type}, keyword_rank double")


def _ranks_of(table: pa.Table) -> np.ndarray:
    numbers = {key: n for n, key in enumerate(table.column("keys")[0].as_py())}
    units = [
        (unit["alternative"], unit["negated"], [(numbers[t["key"]], t["offset"]) for t in unit["terms"]])
        for unit in table.column("units")[0].as_py()
    ]
    entries = table.column("entries").combine_chunks()
    sizes = pc.list_value_length(entries).to_numpy(zero_copy_only=False)
    flat = entries.flatten()
    position, key, weight = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("position", "key_no", "weight"))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((position, rows))
    return cover_ranks(units, key[order], position[order], weight[order], sizes)
