"""The chunk store: Parquet directories per commit and bucket, and a list of the current ones.

A run writes only the buckets it changes, into a directory of its own, and then publishes one manifest
that names for every bucket the directory to read. A manifest's version is taken by the first writer that
publishes it. A writer that comes second looks at what was committed since the version it started
from: when other buckets changed, it puts its own on top and takes the next version; when a bucket
that it replaces changed too, its write is refused and nothing is lost. Readers follow the highest
version, so they never see a half-written state. Manifests keep the number of buckets, so a full
write may lay the store out anew with more of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.schema import STORE
from marginalia.session import shuffles_removed
from marginalia.sources.folder import Folder
from marginalia.sources.lease import Lease, acquire, check_free

_MANIFEST = "bucket int, data string, buckets int, fence long"


class CommitConflict(RuntimeError):
    """Another writer has changed what this one read or replaces."""


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 4096) -> None:
        """``buckets`` is the layout of full writes; writes of some buckets keep the stored layout."""
        self.spark = spark
        self.folder = Folder(spark, root)
        self.root = self.folder.root
        self.wanted_buckets = buckets
        self._seen: int | None = None

    def lease(self, holder: str, **options) -> Lease:
        """The right to write, for one holder at a time; see ``lease.acquire``."""
        return acquire(self.folder, holder, **options)

    @property
    def buckets(self) -> int:
        """Buckets of the current version, or those wanted for the first one."""
        return self._layout(self.version())

    def _layout(self, version: int) -> int:
        stored = self._manifest(version).select("buckets").first() if version else None
        return stored["buckets"] if stored else self.wanted_buckets

    def bucket_of(self, filepath: Column, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(filepath), F.lit(buckets or self.buckets)).cast("int")

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(self.folder.path(f"manifest/version={version}"))

    def version(self) -> int:
        taken = [name.removeprefix("version=") for name in self.folder.names("manifest")]
        return max((int(name) for name in taken if name.isdigit()), default=0)

    def directories(self, version: int | None = None) -> dict[int, str | None]:
        """Bucket to the directory of its rows, none for an empty bucket. One entry per bucket."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return {row["bucket"]: row["data"] for row in self._manifest(version).collect()}

    def changed_buckets(self, since: int, version: int) -> set[int]:
        """Buckets that two versions read from different directories."""
        before, after = self.directories(since), self.directories(version)
        return {bucket for bucket in before.keys() | after.keys() if before.get(bucket) != after.get(bucket)}

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Stored chunks of a version (default: the current one), of all or of the given buckets."""
        if version is None:
            version = self._seen = self.version()
        wanted = None if buckets is None else set(buckets)
        listed = [
            self.folder.path(f"data/{data}/bucket={bucket}")
            for bucket, data in self.directories(version).items()
            if data is not None and (wanted is None or bucket in wanted)
        ]
        if not listed:
            return self.spark.createDataFrame([], STORE)
        return self.spark.read.schema(STORE).parquet(*listed)

    def read_file(self, filepath: str) -> DataFrame:
        """Chunks of one file, out of its bucket alone."""
        bucket = self.spark.range(1).select(self.bucket_of(F.lit(filepath))).first()[0]
        return self.read(buckets=[bucket]).filter(F.col("filepath") == filepath)

    def read_checksums(self, checksums: DataFrame) -> DataFrame:
        return self.read().join(checksums.select("checksum").distinct(), "checksum", "left_semi")

    def buckets_of(self, files: DataFrame) -> list[int]:
        """Buckets that hold the given file paths."""
        distinct = files.select(self.bucket_of(F.col("filepath")).alias("bucket")).distinct()
        return sorted(row["bucket"] for row in distinct.collect())

    def write(
        self,
        state: DataFrame,
        buckets: Iterable[int] | None = None,
        base: int | None = None,
        whole: bool = False,
        lease: Lease | None = None,
    ) -> int:
        """Write a new version and make it current.

        ``buckets`` lists those that ``state`` replaces; the others keep their data. Without it
        everything is replaced. ``base`` is the version that ``state`` was made from, by default the
        one that this object read last. A commit since then is a CommitConflict if it changed one of
        the buckets, or, with ``whole``, if it changed anything: for states that depend on all rows, as
        new ids do. While another holds the store's lease, writes are refused; so is a ``lease`` that was lost.
        """
        if base is None:
            base = self.version() if self._seen is None else self._seen
        check_free(self.folder, lease)
        count = self.wanted_buckets if buckets is None else self._layout(base)
        rows = state.select(*STORE.fieldNames(), self.bucket_of(F.col("filepath"), count).alias("bucket"))
        touched = set(range(count)) if buckets is None else set(buckets)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(sorted(touched)))
        data = f"v={base + 1}-{uuid.uuid4().hex[:8]}"
        path = self.folder.path(f"data/{data}")
        # Rebalancing splits a large bucket over several tasks and files.
        with shuffles_removed(self.spark):
            rows.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        written = {int(name.removeprefix("bucket=")) for name in self.folder.names(f"data/{data}") if "=" in name}
        entries = {bucket: data if bucket in written else None for bucket in touched}
        return self._commit(entries, count, base, whole or buckets is None, lease)

    def _commit(self, entries: dict[int, str | None], count: int, base: int, whole: bool, lease: Lease | None) -> int:
        while True:
            current = self.version()
            fence = check_free(self.folder, lease)
            if current != base:
                changed = self.changed_buckets(base, current)
                if whole or self._layout(current) != count or changed & entries.keys():
                    raise CommitConflict(f"version {current} has changed what version {base} was read for")
            kept = self.directories(current) if self._layout(current) == count else {}
            listed = dict.fromkeys(range(count), None) | kept | entries
            manifest = self.spark.createDataFrame(
                [(bucket, data, count, fence) for bucket, data in listed.items()], _MANIFEST
            )
            written = self.folder.scratch("manifest")
            manifest.coalesce(1).write.parquet(self.folder.path(written))
            if self.folder.publish(written, f"manifest/version={current + 1}"):
                self._seen = current + 1
                return current + 1
