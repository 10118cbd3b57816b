"""Exact cosine top-k for many query vectors at once.

Stored vectors and query vectors are each packed into matrices of bounded bytes. Packs are dealt out to
blocks, and every block of stored vectors meets every block of queries in a cell of a grid. A vector is
moved once per block of the other side, a matrix product scores a pair of packs, and a cell hands on at
most k hits per query. The hits of the cells are then ranked with a window. The store is scanned
once for its vectors, only ``id`` and the vector are read, and no vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.config import SearchDefaults
from marginalia.session import cut_lineage

#: Bytes of a pack's matrix, and rows of a pack of stored and of query vectors.
PACK_BYTES = 4 << 20
STORE_ROWS = 512
QUERY_ROWS = 2048
#: Bytes of the vectors of a block.
BLOCK_BYTES = 24 << 20
#: Hits of a cell: there are so many blocks of queries that k hits of each query are no more.
MOST_PENDING = 2_000_000
#: Query packs of a block.
_MOST_PACKS = 32
#: Cells per core that a search is cut into at least.
_CELLS_PER_CORE = 4
# Scores are compared at this many digits, so that the order of additions cannot decide a tie.
SCORE_DIGITS = 12


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return np.divide(matrix, norms[:, None], out=np.full_like(matrix, np.nan), where=norms[:, None] > 0)


def vector_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row positions, float64 matrix) of the non-null vectors; another length is an error."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.size != rows.size * dim:
        raise ValueError(f"vectors of {dim} values expected")
    return rows, flat.reshape(rows.size, dim)


class _TopHits:
    """The best hits per query that one task has seen."""

    def __init__(self, counts: np.ndarray, thresholds: np.ndarray) -> None:
        self.counts = counts
        self.floor = thresholds.astype(np.float64).copy()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0
        self.limit = max(200_000, 4 * int(counts.sum()))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` as they are computed; those that may count are rounded."""
        rows, queries = np.nonzero(scores >= self.floor - 10.0 ** (1 - SCORE_DIGITS))
        found = np.round(scores[rows, queries], SCORE_DIGITS)
        kept = found >= self.floor[queries]
        if kept.any():
            self.parts.append((queries[kept], ids[rows[kept]], found[kept]))
            self.pending += int(kept.sum())
        if self.pending > self.limit:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Cut to the k best per query; a later row must reach the k-th score to matter."""
        if not self.parts:
            return None
        queries, ids, scores = (np.concatenate(column) for column in zip(*self.parts))
        order = np.lexsort((ids, -scores, queries))
        queries, ids, scores = queries[order], ids[order], scores[order]
        rank = np.arange(queries.size) - np.searchsorted(queries, queries)
        keep = rank < self.counts[queries]
        last = rank == self.counts[queries] - 1
        self.floor[queries[last]] = np.maximum(self.floor[queries[last]], scores[last])
        kept = queries[keep], ids[keep], scores[keep]
        self.parts, self.pending = [kept], int(keep.sum())
        return kept


def _id_array(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), dtype=str)


def _packs(
    vectors: DataFrame, id_type: T.DataType, rows: int, extra: tuple[str, ...] = (), without_direction: float = np.nan
) -> DataFrame:
    """Rows (number, dim, ids, matrix, extra arrays) of unit vectors out of rows (id, vector, extra values).
    Vectors of zeros become ``without_direction``."""
    kinds = "".join(f", {name} array<{dict(vectors.dtypes)[name]}>" for name in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            dim = len(batch.column(1)[0])
            matrix = np.nan_to_num(unit_rows(vector_matrix(batch.column(1), dim)[1]), nan=without_direction)
            step = max(1, min(rows, PACK_BYTES // max(1, 8 * dim)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = [pa.array([part.column(n).to_pylist()], pa.list_(part.column(n).type)) for n in (0, *range(2, part.num_columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([dim], pa.int32()), lists[0], pa.array([matrix[at : at + step].tobytes()]), *lists[1:]],
                    names=["number", "dim", "ids", "matrix", *extra],
                )
                number += 1

    return vectors.mapInArrow(
        run, f"number long, dim int, ids array<{id_type.simpleString()}>, matrix binary{kinds}"
    )


def vector_search(
    store: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    threshold: float | None = None,
    *,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_vector_col: str = "query_embedding",
) -> DataFrame:
    """Rows (query_id, id, similarity, vector_rank): per query the k most similar stored vectors
    with similarity >= threshold, ties by id.

    The queries are evaluated once and written to the checkpoint folder.

    ``queries`` has ``query_id`` and the vector; columns ``match_count`` and
    ``similarity_threshold``, when present, override the arguments per query.
    """
    defaults = SearchDefaults()
    count = F.lit(k if k is not None else defaults.match_count)
    floor = F.lit(float(threshold if threshold is not None else defaults.similarity_threshold))
    if "match_count" in queries.columns:
        count = F.coalesce(F.col("match_count"), count)
    if "similarity_threshold" in queries.columns:
        floor = F.coalesce(F.col("similarity_threshold"), floor)
    asked = queries.select(
        "query_id",
        F.col(query_vector_col).cast("array<double>").alias("vector"),
        count.cast("long").alias("k"),
        floor.cast("double").alias("floor"),
    ).filter(F.col("vector").isNotNull())

    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", store.schema[id_col].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("k", T.LongType()),
        ]
    )
    asked = cut_lineage(asked)
    size = asked.agg(
        F.count("*").alias("n"), F.max("k").alias("k"), F.max(F.size("vector")).alias("dim")
    ).first()
    most, dim = size["k"] or 0, max(1, size["dim"] or 1)
    stored = store.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fitting = max(1, BLOCK_BYTES // (8 * dim))
    query_rows = max(1, min(fitting, _MOST_PACKS * QUERY_ROWS, MOST_PENDING // max(1, most)))
    query_blocks = max(1, -(-size["n"] // query_rows))
    cells = _CELLS_PER_CORE * store.sparkSession.sparkContext.defaultParallelism
    store_blocks = max(-(-store.count() // fitting), -(-cells // query_blocks))

    def in_cells(packs: DataFrame, own: int, others: int, cell: Column) -> DataFrame:
        block = F.pmod(F.xxhash64("number"), F.lit(own)).cast("long")
        placed = packs.withColumns({"block": block, "other": F.explode(F.sequence(F.lit(0), F.lit(others - 1)))})
        return placed.withColumn("cell", cell).drop("number", "block", "other")

    store_cells = in_cells(
        _packs(stored, schema["id"].dataType, STORE_ROWS),
        store_blocks,
        query_blocks,
        F.col("block") * query_blocks + F.col("other"),
    )
    query_cells = in_cells(
        _packs(asked, schema["query_id"].dataType, min(QUERY_ROWS, query_rows), ("k", "floor"), 0.0),
        query_blocks,
        store_blocks,
        F.col("other") * query_blocks + F.col("block"),
    )
    pairs = query_cells.groupBy("cell").cogroup(store_cells.groupBy("cell"))
    return _ranked(pairs.applyInArrow(_scorer(schema), schema), most)


def _ranked(hits: DataFrame, most: int) -> DataFrame:
    """Hits within each query's own limit. The largest limit, as a number, cuts before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return (
        hits.withColumn("vector_rank", F.row_number().over(order))
        .filter(F.col("vector_rank") <= most)
        .filter(F.col("vector_rank") <= F.col("k"))
        .drop("k")
    )


def _scorer(schema: T.StructType):
    """The packs of queries and the stored packs of a cell to the best hits per query."""
    kinds = [_arrow_type(schema[name].dataType) for name in ("query_id", "id")]
    result = pa.schema([("query_id", kinds[0]), ("id", kinds[1]), ("similarity", pa.float64()), ("k", pa.int64())])

    def matrices(packs: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        return [
            (_id_array(ids.values), np.frombuffer(matrix.as_buffer()).reshape(-1, dim.as_py()))
            for ids, matrix, dim in zip(packs.column("ids"), packs.column("matrix"), packs.column("dim"))
        ]

    def score(asked: pa.Table, stored: pa.Table) -> pa.Table:
        held = matrices(stored) if len(asked) else []
        found = []
        for row in range(len(asked) if held else 0):
            ids, ks, floors = (asked.column(name)[row].values for name in ("ids", "k", "floor"))
            dim = asked.column("dim")[row].as_py()
            weights = np.frombuffer(asked.column("matrix")[row].as_buffer()).reshape(-1, dim).T.copy()
            counts = ks.to_numpy()
            top = _TopHits(counts, floors.to_numpy())
            for own_ids, vectors in held:
                if vectors.shape[1] != dim:
                    raise ValueError(f"vectors of {vectors.shape[1]} values expected")
                top.add(own_ids, vectors @ weights)
            best = top.best()
            if best is not None and best[0].size:
                queries, own, scores = best
                columns = [ids.take(pa.array(queries)).cast(kinds[0]), pa.array(own, kinds[1]), pa.array(scores), pa.array(counts[queries])]
                found.append(pa.Table.from_arrays(columns, schema=result))
        return pa.concat_tables(found) if found else result.empty_table()

    return score


def _arrow_type(spark_type: T.DataType) -> pa.DataType:
    types = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    if spark_type not in types:
        raise TypeError(f"ids of type {spark_type.simpleString()} are not supported")
    return types[spark_type]


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vector columns as a plain expression, for joins that already pair few rows."""
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    return dot(left, right) / (F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def ask_matches(store: DataFrame, queries: DataFrame, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """Match-only answer: per query its hits with title, content, similarity and links, and their
    number. Contents are read for the hits only, after the ranking."""
    hits = vector_search(store, queries, k, threshold)
    counted = hits.withColumn("match_count", F.count("*").over(Window.partitionBy("query_id")))
    shown = store.select("id", "chunk_title", F.col("content").alias("chunk_content"), "github_url", "docs_url")
    return counted.join(shown, "id").select(
        "query_id",
        F.col("vector_rank").alias("rank"),
        "chunk_title",
        "chunk_content",
        "similarity",
        "github_url",
        "docs_url",
        "match_count",
    )
