"""Postings of a chunk store, kept in step with it.

The postings are immutable segments. A refresh looks at the buckets that the store has replaced since
the last one, compares their chunks with those that the segments hold, and writes one new segment with
the postings of chunks that are new or have changed, and the tombstones of those that are gone. A
manifest, published once per version as the store's are, lists the segments of each bucket. A bucket with
many segments is merged: its next segment holds all its chunks and stands alone.

In a segment the postings of a term lie in blocks of neighbouring chunk ids. A block names how many
chunks hold the term, how often at most, and with which weights at most; so a search for the k best
chunks of a query can tell from these bounds which blocks to open: first those with the highest bounds,
then all whose bound is not below the k-th best rank found. The others cannot hold a better chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.stem import stem_terms
from marginalia.operators.keywords import (
    FIELD_WEIGHTS,
    MOST_BROADCAST,
    RANK_DIGITS,
    best_hits,
    hit_limit,
    is_plain,
    needed_keys,
    parse_queries,
    query_terms,
    rank_hits,
    sum_ranks,
    with_keys,
)
from marginalia.operators.posting_blocks import BLOCK, BLOCK_BITS, posting_blocks
from marginalia.session import cut_lineage, settings, shuffles_removed, write_once
from marginalia.sources.store import ChunkStore

#: A bucket that has so many segments is merged by its next change.
MERGE_AT = 8
#: Blocks of a query that are opened before the others are judged.
FIRST_BLOCKS = 64
#: Characters of the texts of which one task makes postings.
TASK_CHARS = 16_000_000

_MANIFEST = "bucket int, segment string, data string, buckets int"
_BLOCKS = f"{BLOCK}, segment string"
_CHUNKS = "id long, digest string, segment string, bucket int"
_GONE = "id long, segment string, bucket int"


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the version it made (the current one if nothing changed), the buckets it wrote and the chunks that came and went."""

    version: int
    buckets: tuple[int, ...]
    added: int
    gone: int


class PostingIndex:
    def __init__(
        self,
        store: ChunkStore,
        english: bool = True,
        fields: tuple[tuple[str, float], ...] = FIELD_WEIGHTS,
        merge_at: int = MERGE_AT,
        name: str = "postings",
    ) -> None:
        """An index over ``fields`` in the store's folder; indexes of other fields need other names."""
        self.store, self.spark, self.folder = store, store.spark, store.folder
        self.english, self.fields, self.merge_at, self.name = english, fields, merge_at, name

    def version(self) -> int:
        taken = [name.removeprefix("version=") for name in self.folder.names(f"{self.name}/manifest")]
        return max((int(name) for name in taken if name.isdigit()), default=0)

    def _manifest(self, version: int) -> list:
        """One row per bucket and segment; a bucket that is indexed and empty has one without a segment."""
        if not version:
            return []
        path = self.folder.path(f"{self.name}/manifest/version={version}")
        return self.spark.read.schema(_MANIFEST).parquet(path).collect()

    def segments(self, version: int | None = None) -> dict[int, list[str]]:
        """Bucket to its segments, oldest first."""
        found: dict[int, list[str]] = {}
        for row in self._manifest(self.version() if version is None else version):
            found.setdefault(row["bucket"], [])
            if row["segment"]:
                found[row["bucket"]].append(row["segment"])
        return {bucket: sorted(names) for bucket, names in found.items()}

    def _read(self, kind: str, schema: str, segments: dict[int, list[str]]) -> DataFrame:
        listed = [f"segment={name}/bucket={bucket}" for bucket, names in segments.items() for name in names]
        base = f"{self.name}/{kind}"
        # A segment without rows of a kind in a bucket has no directory.
        known = {
            f"{segment}/{bucket}"
            for segment in {part.split("/")[0] for part in listed}
            for bucket in self.folder.names(f"{base}/{segment}")
        }
        paths = [self.folder.path(f"{base}/{part}") for part in listed if part in known]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder.path(base)).parquet(*paths)

    def _without_gone(self, rows: DataFrame, segments: dict[int, list[str]]) -> DataFrame:
        """Rows (bucket, id, segment, ...) that no later segment of their bucket has a tombstone for."""
        several = {bucket: names for bucket, names in segments.items() if len(names) > 1}
        if not several:
            return rows
        last = (
            self._read("gone", _GONE, several)
            .groupBy(F.col("bucket").alias("_bucket"), F.col("id").alias("_id"))
            .agg(F.max("segment").alias("_until"))
        )
        if last.count() <= MOST_BROADCAST:
            last = F.broadcast(last)
        overtaken = (F.col("bucket") == F.col("_bucket")) & (F.col("id") == F.col("_id"))
        return rows.join(last, overtaken & (F.col("segment") < F.col("_until")), "left_anti")

    def refresh(self) -> Refresh:
        """Bring the index in step with the store's current version."""
        while True:
            version = self.version()
            done = self._refresh(version)
            if done is not None:
                return done

    def _refresh(self, version: int) -> Refresh | None:
        manifest = self._manifest(version)
        covered = {row["bucket"]: row["data"] for row in manifest}
        segments = self.segments(version)
        at = self.store.version()
        current = self.store.directories(at)
        changed = sorted(b for b in current if current[b] != covered.get(b))
        if covered and len(covered) != len(current):
            # The store is laid out anew.
            segments, covered, changed = {}, {}, sorted(current)
        if not changed:
            return Refresh(version, (), 0, 0)

        kept = {b: segments.get(b, []) for b in changed if len(segments.get(b, [])) < self.merge_at}
        merged = {b: [] for b in changed if b not in kept}
        fields = [name for name, _ in self.fields]
        digest = F.sha2(F.to_json(F.struct(*fields)), 256)
        bucket = self.store.bucket_of(F.col("filepath"), len(current))
        same = ["bucket", "id", "digest"]
        stored = self.store.read(at, changed).select("id", *fields, bucket.alias("bucket"))
        rows = stored.withColumn("digest", digest)
        chars = F.aggregate(
            F.array(*[F.coalesce(F.length(name), F.lit(0)).cast("long") for name in fields]), F.lit(0).cast("long"), lambda a, b: a + b
        )
        # What is new is told by narrow rows, written once; texts are read again, out of files that do not change.
        held = write_once(rows.select(*same, chars.alias("chars")))
        followed = any(kept.values())
        known = self._without_gone(self._read("chunks", _CHUNKS, kept), kept).select(*same)
        added = held.join(known, same, "left_anti") if followed else held
        gone = known.join(held.select(same), same, "left_anti") if followed else known

        segment = f"{version + 1:09d}-{uuid.uuid4().hex[:8]}"
        path = lambda kind: self.folder.path(f"{self.name}/{kind}/segment={segment}")
        written = lambda kind, schema: self.spark.read.schema(schema).parquet(path(kind))
        if followed:
            added = write_once(added)
        with shuffles_removed(self.spark):
            added.select("id", "digest", "bucket").write.partitionBy("bucket").parquet(path("chunks"))
            gone.select("id", "bucket").write.partitionBy("bucket").parquet(path("gone"))
            counts = [written(kind, "id long").count() for kind in ("chunks", "gone")]
            size = added.agg(F.sum("chars")).first()[0] or 0
            texts = _those_of(rows, added.select(*same), counts[0]).drop("digest") if followed else stored
            blocks = self._blocks(texts, size, len(changed))
            blocks.write.partitionBy("bucket").option("compression", "zstd").parquet(path("blocks"))
            terms = written("blocks", "term string").distinct()
            if self.english:
                terms = terms.withColumn("stem", stem_terms(F.col("term")))
            terms.write.parquet(path("terms"))

        listed = {b: names for b, names in segments.items() if b not in changed}
        listed |= {b: [*names, segment] for b, names in (kept | merged).items()}
        entries = [
            (b, name, current[b], len(current)) for b in current for name in (listed.get(b) or [None])
        ]
        scratch = self.folder.scratch(f"{self.name}/manifest")
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.parquet(self.folder.path(scratch))
        if not self.folder.publish(scratch, f"{self.name}/manifest/version={version + 1}"):
            return None  # another refresh came first; its state is compared anew
        return Refresh(version + 1, tuple(changed), *counts)

    def _blocks(self, chunks: DataFrame, chars: int, buckets: int) -> DataFrame:
        """Chunks are dealt out by bucket and, where the texts of a bucket are many, by block, so that a bucket is
        no single task and a task writes few buckets. Texts are moved, postings are not: all of a block's are made in one task."""
        tasks = max(1, -(-chars // TASK_CHARS))
        slices = -(-tasks // buckets)
        tasks = tasks if slices == 1 else slices * buckets
        block = F.shiftright("id", BLOCK_BITS)
        place = F.pmod(F.col("bucket") * slices + F.pmod(F.xxhash64(block), F.lit(slices)), F.lit(tasks)).cast("int")
        placed = chunks.repartitionById(tasks, place).sortWithinPartitions("bucket", "id")
        return posting_blocks(placed, self.english, self.fields)

    def blocks(self, version: int | None = None) -> DataFrame:
        """The blocks of all segments; their entries may include chunks that are gone."""
        return self._read("blocks", _BLOCKS, self.segments(version))

    def postings(self, version: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Rows (id, term, position, weight): what ``build_postings`` of all stored chunks gives; and the columns ``keep`` of the block."""
        segments = self.segments(version)
        rows = self._read("blocks", _BLOCKS, segments).select(
            "bucket", "segment", *keep, "term", F.explode("entries").alias("e")
        )
        flat = rows.select("bucket", "segment", *keep, "e.id", "term", "e.position", "e.weight")
        return self._without_gone(flat, segments).select("id", *keep, "term", "position", "weight")

    def vocabulary(self, version: int | None = None) -> DataFrame | None:
        """Distinct terms with their stems, for an English index. Terms whose chunks are all gone may be among them."""
        if not self.english:
            return None
        names = sorted({name for listed in self.segments(version).values() for name in listed})
        if not names:
            return self.spark.createDataFrame([], "term string, stem string")
        paths = [self.folder.path(f"{self.name}/terms/segment={name}") for name in names]
        return self.spark.read.schema("term string, stem string").parquet(*paths).distinct()

    def search(self, queries: DataFrame, k: int | None = None, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """The hits of ``keyword_search`` over all postings, with posting_rows: how many entries were read for the query.

        Entries are counted before those of chunks that are gone are left out.
        """
        # Blocks are dealt out by number; what is joined to them and made of their entries stays where they are.
        with shuffles_removed(self.spark), settings(self.spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
            return cut_lineage(self._search(queries, k, first_blocks))

    def _search(self, queries: DataFrame, k: int | None, first_blocks: int) -> DataFrame:
        segments = self.segments()
        parsed = cut_lineage(
            with_keys(parse_queries(queries, self.english)).withColumn("_plain", is_plain(F.col("units")))
        )
        terms = cut_lineage(query_terms(parsed, self.vocabulary()))
        # Of few queries all that there is one row of for each of their words goes to every task.
        few = max(parsed.count(), terms.count()) <= MOST_BROADCAST
        given = F.broadcast if few else lambda rows: rows
        # Only blocks of the asked terms are moved and read again.
        asked = self._read("blocks", _BLOCKS, segments).join(given(terms.select("term").distinct()), "term", "left_semi")
        blocks = write_once(asked)
        place = ["query_id", "bucket", "block"]
        bounds = write_once(_bounds(blocks.drop("entries").repartition("bucket", "block").join(given(terms), "term"), given(parsed)))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "bucket", "block")
        numbered = bounds.withColumn("_n", F.row_number().over(order))
        first = write_once(numbered.filter(F.col("_n") <= first_blocks).select(*place, "size"))
        ranked = write_once(self._opened(first, blocks, terms, parsed, segments, given))
        reached = (
            best_hits(ranked, queries, k)
            .groupBy("query_id")
            .agg(F.count("*").alias("_found"), F.min("keyword_rank").alias("_least"))
        )
        # The k-th best rank so far, where there are k hits. Ranks are rounded, so a bound that is smaller
        # by no more than that may still be reached.
        full = F.col("_found") >= hit_limit(queries, k)
        floor = queries.join(reached, "query_id", "left").select(
            "query_id", F.when(full, F.col("_least") - 10.0**-RANK_DIGITS).otherwise(0.0).alias("_floor")
        )
        rest = write_once(
            bounds.join(given(floor), "query_id")
            .filter(F.col("bound") >= F.col("_floor"))
            .join(first, place, "left_anti")
            .select(*place, "size")
        )
        every = ranked.unionByName(self._opened(rest, blocks, terms, parsed, segments, given))
        read = first.unionByName(rest).groupBy("query_id").agg(F.sum("size").alias("posting_rows"))
        return best_hits(every, queries, k).join(read, "query_id")

    def _opened(
        self,
        chosen: DataFrame,
        blocks: DataFrame,
        terms: DataFrame,
        parsed: DataFrame,
        segments: dict[int, list[str]],
        given: Callable[[DataFrame], DataFrame],
    ) -> DataFrame:
        """Rows (query_id, id, keyword_rank) of the chunks in the chosen blocks (query_id, bucket, block)."""
        asked = chosen.select("query_id", "bucket", "block").join(given(terms), "query_id").repartition("block")
        own = ["block", "query_id", "key_no", "bucket", "segment"]
        opened = blocks.repartition("block").join(asked, ["term", "bucket", "block"]).select(*own, F.explode("entries").alias("e"))
        flat = opened.select(*own, "e.id", "e.position", "e.weight")
        live = self._without_gone(flat, segments).drop("bucket", "segment")
        plain, others = parsed.filter("_plain"), parsed.filter("not _plain")
        sums = sum_ranks(live.join(given(plain), "query_id", "left_semi"), ("block",))
        covers = rank_hits(live.join(given(others), "query_id", "left_semi"), others, within=("block",))
        return sums.unionByName(covers)


def _those_of(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The rows (bucket, id, digest, ...) that have one of the ``count`` keys; a missing id is a key as well."""
    named = keys.select(F.col("bucket").alias("_bucket"), F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    alike = (
        (F.col("bucket") == F.col("_bucket")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    )
    return rows.join(F.broadcast(named) if count <= MOST_BROADCAST else named, alike, "left_semi")


def _bounds(asked: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows (query_id, bucket, block, bound, size): no chunk of the block has a higher rank.

    A plain query's rank is a sum of weights. Of any other, each cover of an alternative ends at another entry
    of its words, so there are no more covers than entries; and where its units are single words, one
    occurrence of the rarest lies in at most as many covers as there are units. A cover counts for no more
    than the highest weight in it.
    """
    per_key = asked.groupBy("query_id", "bucket", "block", "key_no").agg(
        F.sum("most").alias("most"), F.sum("top").alias("top"), F.max("heavy").alias("heavy"), F.sum("size").alias("size")
    )
    gathered = per_key.groupBy("query_id", "bucket", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("key_no", "most"))).alias("_most"),
        F.sum("top").alias("_top"),
        F.max("heavy").alias("_heavy"),
        F.sum("size").alias("size"),
    )
    numbers = F.transform(
        needed_keys(F.col("units")),
        lambda keys: F.transform(keys, lambda key: (F.array_position(F.col("keys"), key) - 1).cast("int")),
    )
    single = F.forall("units", lambda u: F.size(u["terms"]) == 1)
    asked_for = parsed.select("query_id", "_plain", numbers.alias("_needed"), single.alias("_single"))

    def covers(needed: Column) -> Column:
        counts = F.transform(F.array_distinct(needed), lambda n: F.element_at(F.col("_most"), n))
        every = F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n)
        rarest = F.size(needed) * F.array_min(counts)
        whole = (F.size(needed) > 0) & F.forall(counts, lambda n: n.isNotNull())
        return F.when(whole, F.when(F.col("_single"), F.least(every, rarest)).otherwise(every)).otherwise(0)

    number = F.aggregate(F.transform("_needed", covers), F.lit(0).cast("long"), lambda total, n: total + n)
    bound = F.when(F.col("_plain"), F.col("_top")).otherwise(number * F.col("_heavy"))
    return (
        gathered.join(asked_for, "query_id")
        .select("query_id", "bucket", "block", bound.alias("bound"), "size")
        .filter("bound > 0")
    )
