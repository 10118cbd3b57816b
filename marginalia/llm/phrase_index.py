"""Benchmark decontamination with a positional inverted index.

Training texts are indexed in segments of some megabytes: a segment numbers its words through all of
its documents, leaving one number free between two of them, and stores for each term the ascending
list of its positions. A phrase stands where the lists of its words, each shifted by the word's place,
meet; the intersection starts at the rarest word of the corpus and ends as soon as nothing is left.
Proximity matches take, from the rarest term's positions, the shortest stretches that hold all terms.

Test items come in blocks. A block meets only the lists of its own terms, segment by segment, so a
group holds one segment's positions at most, however often a phrase occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.storage import cut, new_path
from marginalia.llm.text import WORD_BYTES, plain_words

WINDOW = 13
SEGMENT_BYTES = 16 << 20
ITEM_BLOCK = 256

_POSTINGS, _EXTENTS = 0, 1


@dataclass(frozen=True)
class PhraseIndex:
    """postings: term, segment, n, positions (differences, 32-bit little-endian).
    extents: segment, start, n_words and the key of each document."""

    postings: DataFrame
    extents: DataFrame


def _words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and the number of words of each text."""
    parts = [t.encode().translate(WORD_BYTES) if t else b"" for t in texts]
    joined = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = joined != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(
        pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])]
    )
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    return words, np.diff(np.searchsorted(starts, bounds))


def _segment(number: int, keys: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
    words, counts = _words_of(texts)
    firsts = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]).astype(np.int64)
    gaps = np.repeat(np.arange(len(counts)), counts)
    encoded = words.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    places = (order + gaps[order]).astype(np.int32)
    sizes = np.bincount(codes, minlength=len(encoded.dictionary))
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    steps = np.diff(places, prepend=np.int32(0)).astype("<i4")
    steps[begins[:-1]] = places[begins[:-1]]
    lists = pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer((begins * 4).astype(np.int32)), pa.py_buffer(steps)]
    )
    n, m = len(sizes), len(counts)
    segments = lambda rows: pa.array(np.full(rows, number, np.int64))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, _POSTINGS, np.int32)),
            segments(n),
            encoded.dictionary,
            pa.array(sizes.astype(np.int32)),
            lists,
            pa.nulls(n, keys.type),
            pa.nulls(n, pa.int32()),
        ],
        names=_COLUMNS,
    )
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(m, _EXTENTS, np.int32)),
            segments(m),
            pa.nulls(m, pa.string()),
            pa.array(counts.astype(np.int32)),
            pa.nulls(m, pa.binary()),
            keys,
            pa.array(firsts.astype(np.int32)),
        ],
        names=_COLUMNS,
    )


_COLUMNS = ["kind", "segment", "term", "n", "positions", "doc", "start"]


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES
) -> PhraseIndex:
    """Index all words of all texts and store the index in the shared folder.

    Null and empty texts have an extent of no words. Repeated rows and keys are documents of their own.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1)
            held, size, first = [], 0, 0
            for row, text in enumerate(texts):
                held.append(text.as_py())
                size += len(held[-1] or "") + 1
                if size >= segment_bytes or row + 1 == len(texts):
                    yield from _segment(number, batch.column(0).slice(first, len(held)), held)
                    number, first, held, size = number + 1, row + 1, [], 0

    schema = f"kind int, segment long, term string, n int, positions binary, doc {kind}, start int"
    path = new_path(spark, "phrase-index")
    rows = docs.select(key, text).mapInArrow(run, schema)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    return PhraseIndex(
        stored.filter(F.col("kind") == _POSTINGS).select("term", "segment", "n", "positions"),
        stored.filter(F.col("kind") == _EXTENTS).select(
            "segment", "start", F.col("n").alias("n_words"), F.col("doc").alias(key)
        ),
    )


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, name, size, place, term): the words of each row of ``items``; ``item`` numbers the rows, name
    is the key as a string, empty for null. Rows without words give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = plain_words(text)
                rows += [(number, name, len(words), i, w.decode()) for i, w in enumerate(words)]
                number += 1
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["item", "name", "size", "place", "term"]
            )

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    schema = "item long, name string, size int, place int, term string"
    return cut(items.select(name, text).mapInArrow(run, schema), "phrase-items")


def _plan(index: PhraseIndex, words: DataFrame, window: int) -> DataFrame:
    """The words with their number of occurrences in the index, of words that occur."""
    terms = words.select("term").distinct()
    frequencies = index.postings.join(terms, "term").groupBy("term").agg(F.sum("n").alias("frequency"))
    width = F.least(F.col("size"), F.lit(window))
    return cut(words.join(frequencies, "term").withColumn("width", width), "phrase-plan")


def _meet(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Values of the ascending list ``few`` that stand in the ascending list ``many``."""
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return few[many[at] == few] if len(many) else few[:0]


def _phrases(lists: dict[int, np.ndarray], rarity: dict[int, int], size: int, width: int) -> np.ndarray:
    """Ascending starts, as segment positions, of all windows of ``width`` words of one item.

    ``lists``: positions by the word's place in the item. A window that lacks a list does not occur.
    """
    found = []
    for first in range(size - width + 1):
        places = range(first, first + width)
        if any(p not in lists for p in places):
            continue
        order = sorted(places, key=rarity.__getitem__)
        starts = lists[order[0]] - (order[0] - first)
        for place in order[1:]:
            if not len(starts):
                break
            starts = _meet(starts, lists[place] - (place - first))
        found.append(starts)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _stretches(lists: list[np.ndarray], reach: int) -> list[tuple[int, int]]:
    """Shortest stretches (begin, end) of at most ``reach`` positions that hold a position of every list.

    The lists are ascending, rarest first; a stretch is looked for around the rarest list's positions only.
    """
    anchors = lists[0]
    begins = []
    for positions in lists:
        low = np.searchsorted(positions, anchors - reach + 1)
        high = np.searchsorted(positions, anchors, side="right")
        begins += [positions[a:b] for a, b in zip(low.tolist(), high.tolist()) if a < b]
    if not begins:
        return []
    begin = np.unique(np.concatenate(begins))
    end = begin.copy()
    for positions in lists:
        at = np.searchsorted(positions, begin)
        inside = at < len(positions)
        begin, end, at = begin[inside], end[inside], at[inside]
        end = np.maximum(end, positions[at])
    near = end - begin < reach
    begin, end = begin[near], end[near]
    shortest = np.append(end[1:] > end[:-1], True) if len(end) else np.zeros(0, bool)
    return list(zip(begin[shortest].tolist(), (end[shortest] + 1).tolist()))


def _merged(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Disjoint stretches covered by windows that begin at the ascending ``starts``."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > width)
    begins = starts[np.concatenate([[0], breaks + 1])]
    ends = starts[np.concatenate([breaks, [len(starts) - 1]])] + width
    return list(zip(begins.tolist(), ends.tolist()))


def _search(index: PhraseIndex, plan: DataFrame, find: Callable) -> DataFrame:
    """(segment, name, begin, end) that ``find`` gives for every segment and item; begin and end count
    the positions of the segment."""
    blocks = max(1, -(-plan.agg(F.count_distinct("item")).first()[0] // ITEM_BLOCK))
    uses = cut(
        plan.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
        .groupBy("block", "term", "frequency")
        .agg(F.collect_list(F.struct("item", "name", "size", "width", "place")).alias("uses")),
        "phrase-uses",
    )

    def run(group: pa.Table) -> pa.Table:
        items: dict[int, tuple] = {}
        rows = zip(*[group.column(c).to_pylist() for c in ("frequency", "uses", "positions")])
        for frequency, uses, packed in rows:
            positions = np.cumsum(np.frombuffer(packed, "<i4"), dtype=np.int64)
            for use in uses:
                item = items.setdefault(use["item"], (use["name"], use["size"], use["width"], {}, {}))
                item[3][use["place"]] = positions
                item[4][use["place"]] = frequency
        found = []
        for name, size, width, lists, rarity in items.values():
            found += [(name, a, b) for a, b in find(lists, rarity, size, width)]
        segment = group.column("segment")[0].as_py()
        names, begins, ends = zip(*found) if found else ((), (), ())
        return pa.table(
            {
                "segment": pa.array([segment] * len(names), pa.int64()),
                "name": pa.array(names, pa.string()),
                "begin": pa.array(begins, pa.int32()),
                "end": pa.array(ends, pa.int32()),
            }
        )

    return (
        index.postings.join(uses, "term")
        .select("segment", "block", "frequency", "uses", "positions")
        .groupBy("segment", "block")
        .applyInArrow(run, "segment long, name string, begin int, end int")
    )


def phrase_matches(index: PhraseIndex, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """(segment, name, begin, end): stretches of documents covered by windows of ``window`` consecutive
    words of an item, or by the whole item if it has fewer."""
    plan = _plan(index, words, window)
    # Places of words that stand in a window all of whose words occur.
    ahead = Window.partitionBy("item").orderBy("place").rangeBetween(0, window - 1)
    whole = (F.count("*").over(ahead) == F.col("width")) & (F.col("place") + F.col("width") <= F.col("size"))
    behind = Window.partitionBy("item").orderBy("place").rangeBetween(-(window - 1), 0)
    used = plan.withColumn("whole", whole).withColumn("used", F.max("whole").over(behind)).filter("used")
    return _search(
        index,
        used.drop("whole", "used"),
        lambda lists, rarity, size, width: _merged(_phrases(lists, rarity, size, width), width),
    )


def proximity_matches(index: PhraseIndex, words: DataFrame, reach: int) -> DataFrame:
    """(segment, name, begin, end): shortest stretches of at most ``reach`` words that hold every distinct
    word of an item, in any order. Stretches that reach from one document into the next are among them;
    ``documents_hit`` leaves them out."""
    plan = _plan(index, words, 1)

    def find(lists: dict, rarity: dict, size: int, width: int) -> list[tuple[int, int]]:
        if len(lists) < size:
            return []
        return _stretches([lists[p] for p in sorted(lists, key=rarity.__getitem__)], reach)

    return _search(index, plan, find)


def documents_hit(index: PhraseIndex, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per indexed document: key, n_words, n_hit (words inside a match), items (sorted names)."""
    kind = index.extents.schema[key].dataType.simpleString()

    def run(extents: pa.Table, hits: pa.Table) -> pa.Table:
        order = np.argsort(extents.column("start").to_numpy(), kind="stable")
        extents = extents.take(pa.array(order))
        starts, n_words = (extents.column(c).to_numpy() for c in ("start", "n_words"))
        # A document without words starts where the next position is free; it never owns a match.
        owners = np.flatnonzero(n_words > 0)
        n_hit = np.zeros(len(starts), np.int64)
        names: list[set] = [set() for _ in range(len(starts))]
        begins = hits.column("begin").to_numpy()
        ends = hits.column("end").to_numpy()
        labels = hits.column("name").to_pylist()
        done = 0
        for at in np.argsort(begins, kind="stable").tolist():
            document = owners[np.searchsorted(starts[owners], begins[at], side="right") - 1]
            if ends[at] > starts[document] + n_words[document]:
                continue  # a proximity match that reaches into the next document
            names[document].add(labels[at])
            n_hit[document] += max(0, ends[at] - max(done, begins[at]))
            done = max(done, ends[at])
        return pa.table(
            {
                key: extents.column(key),
                "n_words": pa.array(n_words.astype(np.int64)),
                "n_hit": pa.array(n_hit),
                "items": pa.array([sorted(n) for n in names], pa.list_(pa.string())),
            }
        )

    return (
        index.extents.groupBy("segment")
        .cogroup(matches.groupBy("segment"))
        .applyInArrow(run, f"`{key}` {kind}, n_words long, n_hit long, items array<string>")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, items (names of the items with a window in the
    document, sorted) and contaminated: a word is hit, and at least one in ``share`` is.

    Null and empty texts have no words and are clean. Rows of ``items`` that repeat a key count as one
    item, whose windows are those of all its rows; a null key is named by the empty string. Empty
    tables give no rows, or rows without hits. Other columns are not read.
    """
    index = build_index(docs, key, text)
    matches = phrase_matches(index, item_words(items, item_key, item_text), window)
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return documents_hit(index, matches, key).withColumn("contaminated", dirty)


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose key belongs to a contaminated row."""
    dirty = contamination(docs, items, key, text).filter("contaminated")
    lost = cut(dirty.select(F.col(key).alias("__lost")).distinct(), "contaminated")
    packed = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__own"))
    return packed.join(lost, F.col("__own").eqNullSafe(F.col("__lost")), "left_anti").select("__row.*")
