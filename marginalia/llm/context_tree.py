"""Language model scores by context-tree weighting.

A text is its words, A-Z lower-cased, joined by single spaces, and one end. A byte is eight binary
decisions; a decision is predicted in its place in the byte (the bits before it) and in the context of
the bytes before, from none to ``DEPTH``. Every context counts its zeros and ones; the Krichevsky-
Trofimov estimate gives their probability, and a context mixes its own estimate with those of its
longer contexts, half and half, by how well each told the training texts. The mixture over all depths
gives the probability of the next bit.

Texts are packed into blocks of some megabytes. A block tells the corpus which words and byte strings
(context and next byte) it holds and how often in training texts; counts are summed by word and by
string, the model is worked out per pair of latest context bytes, and each block gets back the counts
and probabilities it asked for. Nothing that grows with the corpus is broadcast: the table of the two
shortest contexts has 65,535 entries at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.storage import cut, new_path

DEPTH = 5
BLOCK_BYTES = 32 << 20
#: Bytes of texts that are worked on at once, and positions that are counted at once: the hash table of
#: the byte strings among them should fit into a processor's cache.
_TEXTS = 1 << 20
_PIECE = 1 << 19
#: Rows of an Arrow batch of counts.
_BATCH = 1 << 16
_END = b"\n"
_BLOCKS, _WORDS, _GRAMS = 0, 1, 2
#: Added to every count of the base model.
BASE_COUNT = 0.1


def normalized(text: str | None) -> bytes:
    """Words, A-Z lower-cased, joined by single spaces, and the end."""
    return b" ".join((text or "").encode().lower().split()) + _END


def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, gram) of every byte of the texts, a piece at a time. Each text stands after ends."""
    pad = _END * DEPTH
    buffer = np.frombuffer(b"".join(part for text in texts for part in (pad, text)), np.uint8)
    lengths = np.array([len(t) + DEPTH for t in texts], np.int64)
    real = np.ones(len(buffer), bool)
    starts = np.cumsum(lengths) - lengths
    real[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    for first in range(DEPTH, len(buffer), _PIECE):
        last = min(first + _PIECE, len(buffer))
        gram = buffer[first - 1 : last - 1].astype(np.int64)
        for back in range(2, DEPTH + 1):
            gram <<= 8
            gram |= buffer[first - back : last - back]
        gram <<= 8
        gram |= buffer[first:last]
        inside = real[first:last]
        yield owner[first:last][inside], gram[inside]


def _words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(text number, word) of every word of normalised texts; ends are not among them."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    between = (joined == 32) | (joined == 10)
    stops = np.flatnonzero(between)
    sizes = np.diff(stops, prepend=-1) - 1
    is_end = joined[stops] == 10
    owner = np.cumsum(is_end) - is_end
    some = sizes > 0
    offsets = np.zeros(int(some.sum()) + 1, np.int32)
    np.cumsum(sizes[some], out=offsets[1:])
    words = pa.Array.from_buffers(
        pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined[~between])]
    )
    return owner[some], words


def _batches(texts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Tuples that end with a text, in lists of about a piece."""
    held, size = [], 0
    for item in texts:
        held.append(item)
        size += len(item[-1]) + DEPTH
        if size >= _TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


class _WordCounts:
    """Counts by word; parts are summed whenever they have grown long."""

    def __init__(self):
        self.table = pa.table({"key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        self.parts: list[pa.Table] = []
        self.waiting = 0

    def add(self, values: pa.Array, weight: int) -> None:
        found = pc.value_counts(values)
        counts = found.field("counts").to_numpy(zero_copy_only=False) * weight
        self.parts.append(pa.table({"key": found.field("values"), "n": pa.array(counts, pa.int64())}))
        self.waiting += len(found)
        if self.waiting > (1 << 20) + self.table.num_rows:
            self.sum()

    def sum(self) -> pa.Table:
        grouped = pa.concat_tables([self.table, *self.parts]).group_by("key", use_threads=False)
        self.table = grouped.aggregate([("n", "sum")]).rename_columns(["key", "n"])
        self.parts, self.waiting = [], 0
        return self.table

    def sorted(self) -> Iterator[tuple[pa.Array, pa.Array]]:
        found = self.sum().sort_by("key").combine_chunks()
        for first in range(0, len(found), _BATCH):
            part = found.slice(first, _BATCH).combine_chunks()
            yield part.column("key").chunk(0), part.column("n").chunk(0)


class _GramCounts:
    """Counts by gram in sorted runs, kept apart by the latest context byte: a merge takes no more memory
    than the runs of one byte."""

    def __init__(self):
        self.runs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.waiting: dict[int, int] = {}

    def add(self, grams: np.ndarray, weight: int) -> None:
        keys, counts = np.unique(grams, return_counts=True)
        counts = (counts * weight).astype(np.int32)
        latest = keys >> (8 * DEPTH)
        stops = np.append(np.flatnonzero(np.diff(latest)) + 1, len(keys))
        first = 0
        for stop in stops.tolist():
            byte = int(latest[first])
            self.runs.setdefault(byte, []).append((keys[first:stop].copy(), counts[first:stop].copy()))
            self.waiting[byte] = self.waiting.get(byte, 0) + stop - first
            if self.waiting[byte] > max(1 << 14, len(self.runs[byte][0][0])):
                self.merge(byte)
            first = stop

    def merge(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        runs = self.runs[byte]
        if len(runs) > 1:
            keys = np.concatenate([k for k, _ in runs])
            counts = np.concatenate([c for _, c in runs])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            runs[:] = [(keys[first], np.add.reduceat(counts[order], first, dtype=np.int32))]
        self.waiting[byte] = 0
        return runs[0]

    def sorted(self) -> Iterator[tuple[pa.Array, pa.Array]]:
        for byte in sorted(self.runs):
            keys, counts = self.merge(byte)
            del self.runs[byte]
            for first in range(0, len(keys), _BATCH):
                part = slice(first, first + _BATCH)
                yield pa.array(keys[part]), pa.array(counts[part].astype(np.int64))


_NAMES = ["kind", "block", "word", "gram", "n", "keys", "held", "texts"]


class _Block:
    """What a block holds, gathered text by text; the texts themselves are kept compressed."""

    def __init__(self, number: int, key_type: pa.DataType):
        self.number, self.key_type, self.size = number, key_type, 0
        self.keys: list = []
        self.held: list[bool] = []
        self.words, self.grams = _WordCounts(), _GramCounts()
        self.waiting: list[tuple[bool, bytes]] = []
        self.waiting_bytes = 0
        self.stream = zstandard.ZstdCompressor(level=3).compressobj()
        self.packed: list[bytes] = []

    def add(self, key, held: bool, text: bytes) -> None:
        self.keys.append(key)
        self.held.append(held)
        self.packed.append(self.stream.compress(text))
        self.waiting.append((held, text))
        self.size += len(text)
        self.waiting_bytes += len(text)
        if self.waiting_bytes >= _TEXTS:
            self.count()

    def count(self) -> None:
        """Count words and grams of the texts that wait; held out ones count nothing, but are asked for."""
        for weight, texts in ((1, [t for h, t in self.waiting if not h]), (0, [t for h, t in self.waiting if h])):
            if not texts:
                continue
            self.words.add(_words(texts)[1], weight)
            self.words.add(pa.array([_END.decode()] * len(texts)), weight)
            for _, gram in _grams(texts):
                self.grams.add(gram, weight)
        self.waiting, self.waiting_bytes = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.count()
        types = dict(
            zip(
                _NAMES[2:],
                (pa.string(), pa.int64(), pa.int64(), pa.list_(self.key_type), pa.list_(pa.bool_()), pa.binary()),
            )
        )

        def batch(kind: int, size: int, **columns) -> pa.RecordBatch:
            arrays = [pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, self.number, np.int64))]
            arrays += [columns[c] if c in columns else pa.nulls(size, types[c]) for c in _NAMES[2:]]
            return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

        # In order they take half the space.
        for kind, name, counts in ((_WORDS, "word", self.words), (_GRAMS, "gram", self.grams)):
            for keys, numbers in counts.sorted():
                yield batch(kind, len(keys), **{name: keys, "n": numbers})
        self.words = self.grams = None
        self.packed.append(self.stream.flush())
        yield batch(
            _BLOCKS,
            1,
            keys=pa.array([self.keys], types["keys"]),
            held=pa.array([self.held], types["held"]),
            texts=pa.array([b"".join(self.packed)], pa.binary()),
        )
        pa.default_memory_pool().release_unused()


@dataclass(frozen=True)
class Blocks:
    """texts: block, keys, held, texts (compressed). words: block, word, n. grams: block, gram, n."""

    texts: DataFrame
    words: DataFrame
    grams: DataFrame


def build_blocks(docs: DataFrame, key: str, text: str, held: str, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Pack the rows as they are read, and write what the blocks hold and ask for to the shared folder."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            for name, out, content in zip(batch.column(0), batch.column(1), batch.column(2)):
                if block is None:
                    block = _Block(number, batch.schema.field(0).type)
                block.add(name.as_py(), out.as_py(), normalized(content.as_py()))
                if block.size >= block_bytes:
                    yield from block.rows()
                    block, number = None, number + 1
        if block is not None:
            yield from block.rows()

    schema = (
        f"kind int, block long, word string, gram long, n long, keys array<{kind}>, held array<boolean>, texts binary"
    )
    path = new_path(spark, "context-tree")
    found = docs.select(key, held, text).mapInArrow(run, schema)
    # Not partitioned by kind: that would sort all counts. A reader takes the columns of its kind only.
    found.write.option("compression", "zstd").parquet(path)

    def part(of: int, *columns: str) -> DataFrame:
        stored = spark.read.schema(schema).parquet(path)
        return stored.filter(F.col("kind") == of).select("block", *columns)

    return Blocks(
        part(_BLOCKS, "keys", "held", "texts"), part(_WORDS, "word", "n"), part(_GRAMS, "gram", "n")
    )


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for z >= 0.5, by Stirling's series at z + 8."""
    shifted = z + 8.0
    series = 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5)
    product = z.copy()
    for i in range(1, 8):
        product *= z + i
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


@dataclass(frozen=True)
class _Level:
    """Contexts of one depth for one bit place: per gram the context's place, and per context its counts,
    KT logarithm, sum of the longer contexts' logarithms and own weighted logarithm."""

    place: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    kt: np.ndarray
    longer: np.ndarray
    weighted: np.ndarray


def _levels(grams: np.ndarray, counts: np.ndarray, bit_place: int, shortest: int) -> list[_Level]:
    """Levels from DEPTH down to ``shortest``, deepest first."""
    byte = grams & 0xFF
    bit = byte >> (7 - bit_place) & 1
    node = 1 << bit_place | byte >> (8 - bit_place)
    found: list[_Level] = []
    for depth in range(DEPTH, shortest - 1, -1):
        context = (grams >> (8 * (DEPTH - depth + 1))) << 8 | node
        _, first, place = np.unique(context, return_index=True, return_inverse=True)
        size = len(first)
        ones = np.bincount(place, counts * bit, size)
        zeros = np.bincount(place, counts * (1 - bit), size)
        kt = log_kt(zeros, ones)
        if found:
            deeper = found[-1]
            # Any gram of a longer context names its shorter one.
            owner = np.zeros(len(deeper.kt), np.int64)
            owner[deeper.place] = place
            longer = np.bincount(owner, deeper.weighted, size)
            weighted = np.logaddexp(kt, longer) - np.log(2)
        else:
            longer = weighted = kt
        found.append(_Level(place, zeros, ones, kt, longer, weighted))
    return found


def _mix(levels: list[_Level], bit: np.ndarray) -> np.ndarray:
    """Per gram the probability of its bit, mixed from the deepest level to the last."""
    mixed = None
    for level in levels:
        said = np.where(bit == 1, level.ones[level.place], level.zeros[level.place])
        own = (said + 0.5) / (level.zeros + level.ones + 1.0)[level.place]
        if mixed is None:
            mixed = own
        else:
            trust = 1 / (1 + np.exp(np.clip(level.longer - level.kt, -700, 700)))[level.place]
            mixed = trust * own + (1 - trust) * mixed
    return mixed


def _summary(group: pa.Table) -> pa.Table:
    """Of the contexts of two bytes of one group: counts and weighted logarithm by latest byte and node."""
    grams, counts = group.column("gram").to_numpy(), group.column("n").to_numpy()
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for bit_place in range(8):
        level = _levels(grams, counts, bit_place, 2)[-1]
        one = np.zeros(len(level.kt), np.int64)
        one[level.place] = grams
        node = 1 << bit_place | (one & 0xFF) >> (8 - bit_place)
        for column, values in zip(columns, (one >> (8 * DEPTH), node, level.zeros, level.ones, level.weighted)):
            column.append(values)
    names = ("latest", "node", "zeros", "ones", "weighted")
    return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(names, columns)})


@dataclass(frozen=True)
class ShortContexts:
    """Tables by latest byte and node for contexts of one byte, by node alone for the empty context:
    how far the own estimate is trusted, and its probability of a one."""

    trust_one: np.ndarray
    one_one: np.ndarray
    trust_none: np.ndarray
    one_none: np.ndarray


def short_contexts(rows: np.ndarray) -> ShortContexts:
    """From rows (latest byte, node, zeros, ones, sum of weighted logarithms of contexts of two bytes)."""
    zeros, ones, longer = np.zeros((3, 256, 256))
    at = rows[:, 0].astype(int), rows[:, 1].astype(int)
    zeros[at], ones[at], longer[at] = rows[:, 2], rows[:, 3], rows[:, 4]
    kt = log_kt(zeros.ravel(), ones.ravel()).reshape(256, 256)
    weighted = np.logaddexp(kt, longer) - np.log(2)
    sums = [part.sum(axis=0) for part in (zeros, ones, weighted)]
    kt_none = log_kt(sums[0], sums[1])

    def trust(own: np.ndarray, others: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(others - own, -700, 700)))

    return ShortContexts(
        trust(kt, longer),
        (ones + 0.5) / (zeros + ones + 1),
        trust(kt_none, sums[2]),
        (sums[1] + 0.5) / (sums[0] + sums[1] + 1),
    )


def gram_logarithms(grams: np.ndarray, counts: np.ndarray, short: ShortContexts) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context. ``grams`` holds all grams that share
    their two latest context bytes with one of them."""
    total = np.zeros(len(grams))
    byte, latest = grams & 0xFF, grams >> (8 * DEPTH)
    for bit_place in range(8):
        bit = byte >> (7 - bit_place) & 1
        node = 1 << bit_place | byte >> (8 - bit_place)
        mixed = _mix(_levels(grams, counts, bit_place, 2), bit)
        for trust, one in (
            (short.trust_one[latest, node], short.one_one[latest, node]),
            (short.trust_none[node], short.one_none[node]),
        ):
            mixed = trust * np.where(bit == 1, one, 1 - one) + (1 - trust) * mixed
        total += np.log10(mixed)
    return total


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, logarithm) for all grams of (gram, n), n summed over training texts."""
    shared = F.shiftright("gram", 8 * (DEPTH - 1)).alias("shared")
    keyed = grams.select("gram", "n", shared)
    summary = (
        keyed.groupBy("shared")
        .applyInArrow(_summary, "latest long, node long, zeros double, ones double, weighted double")
        .groupBy("latest", "node")
        .agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted"))
    )
    # At most 256 bytes x 255 nodes.
    rows = np.array([tuple(r) for r in summary.collect()], float).reshape(-1, 5)
    short = short_contexts(rows)

    def run(group: pa.Table) -> pa.Table:
        found = gram_logarithms(group.column("gram").to_numpy(), group.column("n").to_numpy(), short)
        return pa.table({"gram": group.column("gram"), "logarithm": pa.array(found)})

    return keyed.groupBy("shared").applyInArrow(run, "gram long, logarithm double")


def _unpacked(packed: bytes) -> Iterator[bytes]:
    """The texts of a block with their ends, decompressed as they are asked for."""
    held: list[bytes] = []
    for chunk in zstandard.ZstdDecompressor().read_to_iter(packed):
        *ends, rest = chunk.split(_END)
        for end in ends:
            held += (end, _END)
            yield b"".join(held)
            held = []
        held.append(rest)


def _score_block(block: pa.Table, answers: pa.Table, key: str) -> pa.Table:
    is_word = pc.is_valid(answers.column("word"))
    told = answers.filter(is_word).combine_chunks()
    words = told.column("word").combine_chunks()
    counts = told.column("value").to_numpy()
    end = words.index(_END.decode()).as_py()
    end_count = counts[end] if end >= 0 else 0.0
    told = answers.filter(pc.invert(is_word))
    del answers
    order = np.argsort(told.column("gram").to_numpy())
    grams, logarithms = told.column("gram").to_numpy()[order], told.column("value").to_numpy()[order]
    del told, order
    pa.default_memory_pool().release_unused()
    keys = block.column("keys").combine_chunks().flatten()
    held = block.column("held").combine_chunks().flatten()
    n = len(keys)
    n_bytes, n_tokens, n_known = np.zeros((3, n), np.int64)
    logs, scores = np.zeros((2, n))
    done = 0
    for texts in _batches((t,) for t in _unpacked(block.column("texts")[0].as_py())):
        plain = [text for (text,) in texts]
        part = slice(done, done + len(plain))
        owner, found = _words(plain)
        coded = found.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.where(place >= 0, counts[place], 0.0) if len(counts) else np.zeros(len(place))
        own = known[coded.indices.to_numpy(zero_copy_only=False)]
        n_bytes[part] = [len(text) for text in plain]
        n_tokens[part] = 1 + np.bincount(owner, minlength=len(plain))
        n_known[part] = (end_count > 0) + np.bincount(owner, own > 0, len(plain)).astype(np.int64)
        logs[part] = np.log10(end_count + BASE_COUNT) + np.bincount(owner, np.log10(own + BASE_COUNT), len(plain))
        for owner, gram in _grams(plain):
            coded = pa.array(gram).dictionary_encode()
            asked = coded.dictionary.to_numpy()
            # In ascending order the look-ups stay in the cache.
            ranked = np.argsort(asked)
            found_at = np.empty(len(asked), np.int64)
            found_at[ranked] = np.searchsorted(grams, asked[ranked])
            told = logarithms[found_at][coded.indices.to_numpy(zero_copy_only=False)]
            scores[part] += np.bincount(owner, told, len(plain))
        done += len(texts)
    return pa.table(
        {
            key: keys,
            "held_out": held,
            "n_bytes": pa.array(n_bytes),
            "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(n_known),
            "logs": pa.array(logs),
            "score": pa.array(scores),
        }
    )


def score_texts(
    docs: DataFrame, held: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte. The boolean column ``held`` names the rows that nothing is learned from.

    base_score is the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))); score is the log10
    probability that the context tree gives the text with its end. Null and empty texts are an end
    alone. Without training rows every bit has probability one half. Repeated rows count as often as
    they stand; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    blocks = build_blocks(docs, key, text, held, block_bytes)
    counts = cut(
        blocks.words.filter("n > 0").groupBy("word").agg(F.sum("n").alias("value")), "context-words"
    )
    total, distinct = counts.agg(F.coalesce(F.sum("value"), F.lit(0)), F.count("*")).first()
    grams = cut(blocks.grams.groupBy("gram").agg(F.sum("n").alias("n")), "context-grams")
    logarithms = cut(gram_scores(grams), "context-logarithms")
    word_answers = blocks.words.select("block", "word").join(counts, "word")
    gram_answers = blocks.grams.select("block", "gram").join(logarithms, "gram")
    answers = word_answers.select(
        "block", "word", F.lit(None).cast("long").alias("gram"), F.col("value").cast("double").alias("value")
    ).unionByName(
        gram_answers.select(
            "block", F.lit(None).cast("string").alias("word"), "gram", F.col("logarithm").alias("value")
        )
    )
    scored = (
        blocks.texts.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            lambda block, own: _score_block(block, own, key),
            f"`{key}` {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, logs double, score double",
        )
    )
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(total + BASE_COUNT * (distinct + 1)))
    return scored.select(
        key,
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
