"""Apply a diff to the stored chunks: every operator maps the old table to the new one.

The side that lists changes is small next to the store in a normal run, so the joins are left to
adaptive execution: it broadcasts the list below the size limit of the session and sorts both sides
beyond it. Rows that do not change keep all their columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import MOVING_PREFIX
from marginalia.schema import STORE, UPSERT_COLUMNS
from marginalia.session import cut_lineage

LOCATION = ["filepath", "chunk_id"]
_ID_BUCKETS = 65536


def _now(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


def delete_by_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti").select(*store.columns)


def resolve_moves(store: DataFrame, moves: DataFrame) -> DataFrame:
    """Final location of each move. Of several moves to one place the smallest id wins; a place
    held by a row that does not move stays held. Losers are parked under ``__moving__<id>``."""
    first = Window.partitionBy(*LOCATION).orderBy("id")
    ranked = moves.withColumn("_n", F.row_number().over(first))
    held = (
        store.select("id", *LOCATION)
        .join(moves.select("id"), "id", "left_anti")
        .select(*LOCATION, F.lit(True).alias("_held"))
    )
    placed = F.col("_held").isNull() & (F.col("_n") == 1)
    parked = F.concat(F.lit(MOVING_PREFIX), F.col("id").cast("string"))
    return ranked.join(held, LOCATION, "left").select(
        "id",
        F.when(placed, F.col("filepath")).otherwise(parked).alias("filepath"),
        F.col("chunk_id").cast("int").alias("chunk_id"),
        "source_type",
        F.when(placed, F.col("github_url")).alias("github_url"),
    )


def apply_moves(store: DataFrame, moves: DataFrame, now: Column | None = None) -> DataFrame:
    """Set filepath, chunk_id, source_type and github_url by id; null new values keep the old."""
    changed = ["filepath", "chunk_id", "source_type", "github_url"]
    resolved = resolve_moves(store, moves).select(
        "id", *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_moved")
    )
    joined = store.join(resolved, "id", "left")
    for name in changed:
        joined = joined.withColumn(name, F.coalesce(f"_new_{name}", name))
    if "updated_at" in store.columns:
        joined = joined.withColumn(
            "updated_at", F.when(F.col("_moved"), _now(now)).otherwise(F.col("updated_at"))
        )
    return joined.select(*store.columns)


def number_rows(rows: DataFrame, keys: list[str], start: int) -> DataFrame:
    """Add dense unique ids after ``start``.

    Rows are numbered inside hash buckets, then shifted by the sizes of the buckets before; neither
    step sees all rows in one task, and a repeated task gives the same ids.
    """
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(_ID_BUCKETS)))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    return (
        bucketed.withColumn("_n", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")  # at most _ID_BUCKETS rows
        .withColumn("id", F.col("_offset") + F.col("_n") + F.lit(start))
        .drop("_bucket", "_n", "_offset")
    )


def upsert_chunks(
    store: DataFrame, new: DataFrame, now: Column | None = None, last_id: int | None = None
) -> DataFrame:
    """Insert new chunks; on a (filepath, chunk_id) conflict overwrite all but id and created_at.

    New ids follow ``last_id``, by default the largest id of ``store``; a caller that passes a part
    of its chunks must pass the largest id of all.
    """
    start = last_id if last_id is not None else store.agg(F.max("id")).first()[0] or 0
    known = store.select(*LOCATION, F.col("id").alias("_id"), "created_at")
    keys = new.select(*LOCATION).distinct().join(known, LOCATION, "left")
    fresh = number_rows(
        keys.filter(F.col("_id").isNull()).select(*LOCATION), LOCATION, start
    ).withColumn("created_at", _now(now))
    ids = keys.filter(F.col("_id").isNotNull()).select(*LOCATION, F.col("_id").alias("id"), "created_at")
    untouched = store.join(new.select(*LOCATION), LOCATION, "left_anti")
    return untouched.select(*store.columns).unionByName(_incoming(store, new, ids.unionByName(fresh), now))


def _incoming(store: DataFrame, new: DataFrame, ids: DataFrame, now: Column | None) -> DataFrame:
    """New chunks in the shape of ``store``; ``ids`` has id and created_at by location."""
    incoming = new.join(ids, LOCATION).withColumn("updated_at", _now(now))
    types = {f.name: f.dataType for f in STORE.fields}
    missing = [c for c in UPSERT_COLUMNS if c not in incoming.columns]
    incoming = incoming.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in missing])
    # By name of the type: whether array values may be null must not matter.
    wanted = dict(store.dtypes)
    return incoming.select(*[F.col(c).cast(wanted[c]).alias(c) for c in store.columns])


def delete_missing(store: DataFrame, files: DataFrame, valid: DataFrame) -> DataFrame:
    """Drop the rows of the listed files whose (filepath, chunk_id) is not listed as valid."""
    listed = files.select("filepath").distinct().withColumn("_listed", F.lit(True))
    kept = valid.select(*LOCATION).distinct().withColumn("_valid", F.lit(True))
    return (
        store.join(listed, "filepath", "left")
        .join(kept, LOCATION, "left")
        .filter(F.col("_listed").isNull() | F.col("_valid"))
        .select(*store.columns)
    )


def reorder_chunks(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Set chunk_id by id."""
    new = updates.select("id", F.col("chunk_id").cast("int").alias("_new"))
    return (
        store.join(new, "id", "left")
        .withColumn("chunk_id", F.coalesce("_new", "chunk_id"))
        .select(*store.columns)
    )


def location_conflicts(store: DataFrame) -> DataFrame:
    return store.groupBy(*LOCATION).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def check_unique_location(store: DataFrame) -> None:
    conflict = location_conflicts(store).first()
    if conflict is not None:
        raise ValueError(f"{conflict['rows']} chunks at {conflict['filepath']}:{conflict['chunk_id']}")


def next_state(
    store: DataFrame,
    moves: DataFrame,
    deletes: DataFrame,
    new: DataFrame,
    now: Column | None = None,
    last_id: int | None = None,
) -> DataFrame:
    """Deletes, moves and upserts as one new state, so a move may take the place of a deleted row.

    Places are settled on ids and locations alone and written to the checkpoint folder; the rows
    themselves are joined once.
    """
    kept = delete_by_ids(store.select("id", *LOCATION, "created_at"), deletes)
    alive = moves.join(deletes.select("id"), "id", "left_anti")
    resolved = resolve_moves(kept, alive).select(
        "id",
        F.struct("filepath", "chunk_id", "source_type", "github_url").alias("_to"),
    )
    placed = kept.join(resolved, "id", "left").select(
        "id",
        F.coalesce("_to.filepath", "filepath").alias("filepath"),
        F.coalesce("_to.chunk_id", "chunk_id").alias("chunk_id"),
        "created_at",
        "_to",
    )
    asked = new.select(*LOCATION).distinct().withColumn("_new", F.lit(True))
    places = cut_lineage(placed.join(asked, LOCATION, "full_outer"))
    start = last_id if last_id is not None else places.agg(F.max("id")).first()[0] or 0
    fresh = number_rows(places.filter("id is null").select(*LOCATION), LOCATION, start)
    ids = places.filter("_new and id is not null").select(*LOCATION, "id", "created_at")
    incoming = _incoming(store, new, ids.unionByName(fresh.withColumn("created_at", _now(now))), now)

    stay = places.filter("_new is null").select("id", "_to", F.col("_to").isNotNull().alias("_moved"))
    rows = store.join(stay, "id")
    for name in ("filepath", "chunk_id", "source_type", "github_url"):
        rows = rows.withColumn(name, F.coalesce(F.col("_to")[name], F.col(name)))
    rows = rows.withColumn("updated_at", F.when(F.col("_moved"), _now(now)).otherwise(F.col("updated_at")))
    return rows.select(*store.columns).unionByName(incoming)
