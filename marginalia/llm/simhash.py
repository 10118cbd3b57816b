"""Near-duplicate groups by SimHash and Golay keys.

A fingerprint of 64 bits is cut into three segments, each padded to a word of the binary Golay code
(23, 12). The code is perfect: every word lies within distance 3 of one codeword, whose 12 message
bits are its index. The keys of a segment are the indices to which it and its 23 neighbours decode:
one key if the word is within 2 of its codeword, else six. Two segments that differ in one bit share a
key, as each is among the neighbours of the other; it is enough that one side offers all its keys and
the other only its own index.

At most three differing bits are spread over three segments. Either one segment is equal, and then of
the other two one differs in at most one bit: key (equal segment, index of another). Or each segment
differs in exactly one bit; then of each segment one half is equal: key (index of the first segment,
equal halves of the two others). Equal keys are candidates; the join verifies their distance. A key
that many fingerprints share is not joined: its fingerprints are compared in blocks, and a block pair
gives back a spanning forest of its links instead of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.storage import cut
from marginalia.llm.text import space_words

MAX_DISTANCE = 3
SHINGLE = 3
SEED = 42
#: (lowest bit, width) of the segments and of the halves of the last two.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALVES = (((22, 10), (32, 11)), ((43, 10), (53, 11)))
#: A key with more fingerprints than this is compared in blocks of BLOCK.
HOT_KEY = 64
BLOCK = 2048
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of the whole text, repeats counted."""
    words = space_words(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    shifted = zip(*[words[i:] for i in range(shingle)])
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(s), seed) for s in shifted), np.uint64, len(words) - shingle + 1
    )
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row per row of ``docs``, fp as a signed long. Texts without words have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            column = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(remainder of each low 12 bits, remainder of each high 11 bits, error pattern of each remainder)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    low = np.array([remainder(w) for w in range(1 << 12)], np.int64)
    high = np.array([remainder(w << 12) for w in range(1 << 11)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    flips = [0, *(1 << i for i in range(23))]
    for a in flips:
        for b in flips:
            for c in flips:
                word = a ^ b ^ c
                errors[low[word & 0xFFF] ^ high[word >> 12]] = word
    return low, high, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 message bits) of the codeword nearest to each 23-bit word."""
    low, high, errors = _code()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Indices of each word and of its neighbours, sorted; -1 in place of repeats."""
    flips = np.array([0, *(1 << i for i in range(23))], np.int64)
    keys = np.sort(golay_index(words[:, None] ^ flips[None, :]), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def _part(fps: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    return ((fps >> np.uint64(at[0])) & np.uint64((1 << at[1]) - 1)).astype(np.int64)


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, probe): keys by which fingerprints meet. A fingerprint's own keys have probe False."""
    segments = [_part(fps, s) for s in SEGMENTS]
    halves = [[_part(fps, h) for h in pair] for pair in HALVES]
    own = [golay_index(s) for s in segments]
    near = [golay_keys(s) for s in segments]
    rows, keys, probes = [], [], []
    number = np.arange(len(fps))

    def add(kind: int, exact: np.ndarray, golay: int) -> None:
        base = (np.int64(kind) << 56) | (exact << 12)
        rows.append(number)
        keys.append(base | own[golay])
        probes.append(np.zeros(len(fps), bool))
        at, column = np.nonzero(near[golay] >= 0)
        rows.append(at)
        keys.append(base[at] | near[golay][at, column])
        probes.append(np.ones(len(at), bool))

    kind = 0
    for equal in range(3):
        for other in range(3):
            if equal != other:
                add(kind, segments[equal], other)
                kind += 1
    for first in halves[0]:
        for second in halves[1]:
            add(kind, first << 11 | second, 0)
            kind += 1
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(probes)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(fps), 2048):
                part = fps[start : start + 2048]
                rows, keys, probes = join_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[rows]), pa.array(keys), pa.array(probes)], names=["fp", "key", "probe"]
                )

    return distinct.select("fp").mapInArrow(run, "fp long, key long, probe boolean")


def _forest(nodes: np.ndarray, pairs: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join two parts, out of links (row, columns) in turn."""
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for row, columns in pairs:
        for column in columns.tolist():
            a, b = root(row), root(column)
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append((int(nodes[row]), int(nodes[column])))
    return kept


def _compare_blocks(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between two blocks of fingerprints (or inside one)."""
    nodes = np.unique(np.concatenate([left, right]))
    rows, others = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    wide = nodes.view(np.uint64)

    def links() -> Iterator[tuple[int, np.ndarray]]:
        for row in rows.tolist():
            apart = np.bitwise_count(wide[others] ^ wide[row])
            near = others[apart <= distance]
            yield row, near[near != row]

    return _forest(nodes, links())


def links(distinct: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within ``distance``.

    ``distinct`` has one row per fingerprint, in fp. Pairs that meet under a rare key are all given;
    of pairs that meet only under hot keys, a spanning forest of each block pair is.
    """
    if distance > MAX_DISTANCE:
        raise ValueError(f"the keys find distances up to {MAX_DISTANCE}")
    keyed = cut(_keyed(distinct), "simhash-keys")
    hot = cut(
        keyed.filter("not probe")
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > HOT_KEY)
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
        "simhash-hot",
    )
    rare = keyed.join(hot, "key", "left_anti")
    own = rare.filter("not probe").select("key", F.col("fp").alias("b"))
    asking = rare.filter("probe").select("key", F.col("fp").alias("a"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = asking.join(own, (asking["key"] == own["key"]) & (asking["a"] != own["b"]) & (apart <= distance))
    return pairs.select("a", "b").unionByName(_hot_links(keyed.join(hot, "key"), distance))


def _hot_links(keyed: DataFrame, distance: int) -> DataFrame:
    """Links under hot keys. Rows of a key are dealt to blocks by their own hash; every pair of an asking
    block and an own block is one small group."""
    block = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    dealt = keyed.withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meeting = dealt.withColumn("other", other).select(
        "key",
        F.when(F.col("probe"), F.col("block")).otherwise(F.col("other")).alias("x"),
        F.when(F.col("probe"), F.col("other")).otherwise(F.col("block")).alias("y"),
        "fp",
        "probe",
    )

    def run(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy()
        probe = group.column("probe").to_numpy()
        found = _compare_blocks(fps[probe], fps[~probe], distance)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return meeting.groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node with a link.

    Turns of two steps: each node tells its larger neighbours of its smallest neighbour, then its
    smaller ones. The number of turns grows with the logarithm of the longest path. Every step
    aggregates before it joins; results are cut to the shared folder.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = cut(both.distinct(), "components")
    state = None
    while True:
        directed = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = directed.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        current = cut(small, "components")
        digest = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")
        ).first()
        if digest == state or digest[0] == digest[2] and _is_star(current):
            break
        state = digest
    roots = current.groupBy("v").agg(F.count("*")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _is_star(edges: DataFrame) -> bool:
    """Whether no node that others point to points to another."""
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE
) -> DataFrame:
    """One row per row of ``docs``: key, fp (signed long), component_id, the smallest key reachable over
    links of fingerprints with at most ``distance`` differing bits.

    Equal fingerprints, those of empty and null texts included, are one node. Null keys get a
    component and never name one, unless all its keys are null. Repeated rows give repeated rows; an
    empty table gives none. Other columns are not read.
    """
    marked = cut(fingerprints(docs, key, text), "simhash-fingerprints")
    distinct = marked.select("fp").distinct()
    found = cut(components(links(distinct, distance)), "simhash-components")
    named = (
        marked.groupBy("fp")
        .agg(F.min(key).alias("first"))
        .join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    )
    named = cut(named, "simhash-named")
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = named.join(ids, "component").select("fp", "component_id")
    return marked.join(labels, "fp").select(key, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest key.

    A key that different texts have stands for several documents: each is judged by its own text, and of
    several that are linked the one with the smallest hash stays. Rows that repeat key and text give
    one row, the one with the smallest hash of all columns. Rows without a key pass as they are, and no other row goes
    because of them.
    """
    place = [F.col(key).alias("key"), F.xxhash64(text).alias("hash")]
    keyed = docs.filter(F.col(key).isNotNull()).select(F.struct(*place).alias("__own"), F.col(text).alias("__text"))
    groups = near_duplicates(keyed, "__own", "__text")
    # Rows that go, or of which only one stays: few as a rule, so that most rows are not moved to drop them.
    judged = groups.groupBy("__own").agg(
        F.first(F.col("__own") == F.col("component_id")).alias("__stays"), F.count("*").alias("__rows")
    )
    noted = cut(judged.filter("not __stays or __rows > 1"), "simhash-noted").select(
        F.col("__own.key").alias("__key"), F.col("__own.hash").alias("__hash"), "__stays"
    )
    packed = docs.select(F.struct("*").alias("__row"), *[c.alias(n) for c, n in zip(place, ("__own", "__text"))])
    same = (F.col("__own") == F.col("__key")) & (F.col("__text") == F.col("__hash"))
    others = packed.join(noted, same, "left_anti").select("__row.*")
    repeated = (
        packed.join(noted.filter("__stays"), same)
        .groupBy("__key", "__hash")
        .agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    )
    return others.unionByName(repeated.select("__row.*"))
