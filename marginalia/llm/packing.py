"""Pack tokenised documents into sequences of one length by best-fit decreasing.

A document longer than a sequence is first cut into full windows; what is left over is a piece shorter
than a window. A task holds the pieces of some millions of tokens, sorts them from long to short and
puts each into the tightest open window that takes it; a segment tree over the room that is left,
from none to a whole window, finds that window. Windows that stay too empty, as where all pieces are a
little longer than half a window, are emptied into the others, and the last piece that goes into a
window is cut to fill it. What the emptiest window holds goes on into the task's next round, so that a
task leaves one window that is not filled, however many documents it reads.

Nothing is shuffled: a document's tokens stay in the task that has read it. A task's memory is that of
one round of pieces, of one batch of texts and of the words whose tokens it remembers.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from marginalia.llm.text import or_empty

WINDOW = 2048
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Bytes of a token: ids are written as little-endian unsigned 32-bit numbers.
WIDTH = 4
#: Tokens of a round: 1,024 windows of 2,048.
ROUND_TOKENS = 1 << 21
#: Windows with at most this share of room are left as they are.
SLACK = 0.01
#: Words and runs of at most so many bytes are remembered with their tokens, and how many of each.
MOST_WORD_BYTES = 48
MOST_WORDS = 1_000_000
#: Rows of an Arrow batch of the result end at about so many bytes of tokens.
BATCH_BYTES = 4 << 20


# The steps of word_bpe_49k.json before its merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ("NFC", "Replace", "Lowercase")

#: The same split for words of printable ASCII and letters of Latin-1 after lower-casing, which NFC leaves alone.
_LATIN = "a-zß-öø-ÿ"
_RUNS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")


class _Memory(dict):
    """Values of the keys met lately. ``older`` holds what was met before."""

    def __init__(self, most: int):
        self.most = most
        self.older: dict = {}

    def keep(self, key, value):
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Runs(_Memory):
    """Tokens of a run of letters, a digit or a run of other signs."""

    def __init__(self, tokenizer: Tokenizer, most: int):
        super().__init__(most)
        self.model = tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256)}

    def __missing__(self, run: str) -> bytes:
        tokens = self.older.pop(run, None)
        if tokens is None:
            ids = [token.id for token in self.model.tokenize(run.translate(self.alphabet))]
            tokens = struct.pack(f"<{len(ids)}I", *ids)
        return self.keep(run, tokens) if len(run) <= MOST_WORD_BYTES else tokens


class Encoder(_Memory):
    """Tokens of texts. Where the vocabulary breaks texts at white space and drops it, as word_bpe_49k.json
    does, they are those of the words, one after the other, which are remembered; plain words go to the
    merges right away. With any other vocabulary a text is encoded as a whole."""

    def __init__(self, vocabulary: str):
        super().__init__(MOST_WORDS)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        steps = json.loads(self.tokenizer.to_str())
        normalizers = (steps["normalizer"] or {}).get("normalizers", [])
        splits = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = tuple(n["type"] for n in normalizers) == _NORMALIZERS and (
            splits[0].get("pattern") == {"Regex": _SPLIT} and splits[0]["invert"]
        )
        if self.by_word:
            self.runs = _Runs(self.tokenizer, MOST_WORDS)

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        tokens = self.older.pop(word, None)
        if tokens is None:
            text = word.decode()
            if len(word) <= MOST_WORD_BYTES and _SIMPLE.fullmatch(text) and "<|" not in text:
                tokens = b"".join([self.runs[run] for run in _RUNS.findall(text.lower())])
            else:
                tokens = self.encoded(text)
        return self.keep(word, tokens) if len(word) <= MOST_WORD_BYTES else tokens

    def tokens(self, text: str) -> bytes:
        if not self.by_word:
            return self.encoded(text)
        return b"".join(map(self.__getitem__, text.encode().split()))


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    """One per Python worker: the words stay known from task to task."""
    return Encoder(vocabulary)


class RoomTree:
    """Open windows by the room that is left in them, 0 to ``most``.

    A leaf counts the windows with its room, an inner node those below it, so the tightest window
    with enough room is found by going up until a right neighbour has any and down to its first one.
    """

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, needed: int) -> tuple[int, int] | None:
        """Room and number of the tightest window with at least ``needed``, which is taken out."""
        counts, at = self.counts, self.leaves + needed
        if at >= 2 * self.leaves:
            return None
        if not counts[at]:
            while at > 1 and (at & 1 or not counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.counts[at] += by
            at >>= 1


@dataclass(slots=True)
class Piece:
    document: int
    start: int
    tokens: bytes

    @property
    def length(self) -> int:
        return len(self.tokens) // WIDTH

    def cut(self, length: int) -> tuple[Piece, Piece]:
        at = length * WIDTH
        return (
            Piece(self.document, self.start, self.tokens[:at]),
            Piece(self.document, self.start + length, self.tokens[at:]),
        )


def best_fit(pieces: Iterable[Piece], window: int) -> list[list[Piece]]:
    """Windows by best-fit decreasing. Pieces are at most ``window`` long; equal ones keep their order."""
    tree, filled = RoomTree(window), []
    for piece in sorted(pieces, key=lambda p: -p.length):
        found = tree.take(piece.length)
        if found is None:
            filled.append([])
            found = window, len(filled) - 1
        room, number = found
        filled[number].append(piece)
        tree.put(room - piece.length, number)
    return filled


def top_up(filled: list[list[Piece]], window: int, slack: int) -> list[list[Piece]]:
    """Windows with more than ``slack`` room are filled from the emptiest of them; the last piece that a
    window takes is cut. At most the last window is left with more room."""
    room = {n: window - sum(p.length for p in pieces) for n, pieces in enumerate(filled)}
    short = sorted((n for n in room if room[n] > slack), key=lambda n: (room[n], n))
    done = [pieces for n, pieces in enumerate(filled) if room[n] <= slack]
    while short:
        first = filled[short[0]]
        while len(short) > 1 and room[short[0]]:
            giver = filled[short[-1]]
            piece = giver.pop()
            if piece.length > room[short[0]]:
                piece, rest = piece.cut(room[short[0]])
                giver.append(rest)
            room[short[0]] -= piece.length
            first.append(piece)
            if not giver:
                short.pop()
        done.append(first)
        short.pop(0)
    return done


class Packer:
    """Pieces to numbered windows, round by round."""

    def __init__(self, window: int, round_tokens: int):
        self.window, self.round_tokens = window, round_tokens
        self.slack = int(window * SLACK)
        self.held: list[Piece] = []
        self.size, self.sequence = 0, 0

    def add(self, document: int, tokens: bytes) -> Iterator[tuple[int, int, Piece]]:
        """The sequences that are complete with this document: (sequence, offset, piece)."""
        length = len(tokens) // WIDTH
        whole = length - length % self.window
        for start in range(0, whole, self.window):
            part = tokens[start * WIDTH : (start + self.window) * WIDTH]
            yield from self._numbered([Piece(document, start, part)])
        if length > whole:
            self.held.append(Piece(document, whole, tokens[whole * WIDTH :]))
            self.size += length - whole
            if self.size >= self.round_tokens:
                yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple[int, int, Piece]]:
        windows = top_up(best_fit(self.held, self.window), self.window, self.slack)
        self.held, self.size = [], 0
        if not last and windows:
            self.held = windows.pop()
            self.size = sum(p.length for p in self.held)
        for pieces in windows:
            yield from self._numbered(pieces)

    def _numbered(self, pieces: list[Piece]) -> Iterator[tuple[int, int, Piece]]:
        offset = 0
        for piece in pieces:
            yield self.sequence, offset, piece
            offset += piece.length
        self.sequence += 1


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    vocabulary: str | None = None,
    end: int = END,
    round_tokens: int = ROUND_TOKENS,
) -> DataFrame:
    """One row per piece: key, start (tokens of its document before it), length, ids (its tokens as
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id and offset in the sequence.

    A document's tokens are those of ``vocabulary`` (a file of the tokenizers library; word_bpe_49k.json
    without one) followed by ``end``. Each token lies in one piece, pieces of a sequence
    follow each other without a gap, and a sequence has at most ``window`` tokens. Sequences are
    numbered by the task that reads their documents; numbers are not dense.

    A null text is empty; an empty text gives the end alone. Rows that repeat a key are documents of their own, null
    keys stay null. Other columns of ``docs`` are not read. An empty table gives no rows. Reruns
    over the same files, split alike, agree.
    """
    kind = docs.schema[key].dataType.simpleString()
    ending = end.to_bytes(WIDTH, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        packer = Packer(window, round_tokens)
        return _batches(_packed(batches, encoder, ending, packer))

    rows = docs.select(
        F.col(key).alias("doc"), or_empty(text).alias("text"), F.spark_partition_id().alias("part")
    )
    schema = f"doc {kind}, start long, length long, ids binary, doc_tokens long, part int, sequence long, offset long"
    return rows.mapInArrow(run, schema).select(
        F.col("doc").alias(key),
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.shiftleft(F.col("part").cast("long"), 33) + F.col("sequence")).alias("sequence_id"),
        "offset",
    )


def _packed(
    batches: Iterator[pa.RecordBatch], encoder: Encoder, ending: bytes, packer: Packer
) -> Iterator[tuple]:
    """Rows of the result, with the keys as Arrow scalars. Only documents with a held piece are remembered."""
    known: dict[int, tuple] = {}
    document = 0

    def row(sequence: int, offset: int, piece: Piece) -> tuple:
        key, doc_tokens, part = known[piece.document]
        return key, piece.start, piece.length, piece.tokens, doc_tokens, part, sequence, offset

    for batch in batches:
        for key, text, part in zip(*batch.columns):
            tokens = encoder.tokens(text.as_py()) + ending
            known[document] = key, len(tokens) // WIDTH, part.as_py()
            for done in packer.add(document, tokens):
                yield row(*done)
            if len(known) > 2 * len(packer.held) + 1024:
                known = {p.document: known[p.document] for p in packer.held}
            document += 1
    for done in packer.flush():
        yield row(*done)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "start", "length", "ids", "doc_tokens", "part", "sequence", "offset"]
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        kinds = (held[0][0].type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(values), kind) for values, kind in zip(zip(*held), kinds)], names=names
        )

    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
