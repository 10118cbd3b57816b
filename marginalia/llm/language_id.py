"""Language identification by compression.

Each language has a dictionary of raw content, pieces of its training texts. A text is encoded with
the dictionary of every language in turn; the smallest encoding names the language. Texts are encoded
in chunks, so that a long text is measured against the dictionaries and not against itself. All
dictionaries end with the same lead, which also stands before every chunk: it costs the same in every
language, and keeps the encoder from storing short chunks as they are, which would make all sizes equal.
"""

from __future__ import annotations

from collections.abc import Iterator
import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.sampling import lowest
from marginalia.llm.storage import cut
from marginalia.llm.text import or_empty

#: Texts of each language that give a piece, in the order of a hash of the text, and characters of a
#: piece. A dictionary has at most PIECES * PIECE_CHARS characters.
PIECES = 256
PIECE_CHARS = 400
CHUNK_BYTES = 2048
LEVEL = 6
#: An answer is rejected when the second best encoding is larger by less than this share.
MARGIN = 0.01

#: Fixed text of letters in no order, long enough to be worth a match.
LEAD = b"".join(bytes([97 + (i * i * 7 + i * 11 + i // 5) % 26]) for i in range(192)) + b" "

_NO_LETTERS = re.compile(r"[\W\d_]+")


def normalized(text: str | None) -> bytes:
    """Lower-case letters and single spaces, as UTF-8; empty for texts without a letter."""
    plain = _NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return plain.encode() if any(map(str.isalpha, plain)) else b""


class Encoder:
    """Encoded sizes of a text by language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.compressors = {}
        for language, content in dictionaries.items():
            raw = zstandard.ZstdCompressionDict(content + b" " + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.compressors[language] = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False
            )

    def sizes(self, content: bytes) -> dict[str, int]:
        chunks = [LEAD + content[i : i + CHUNK_BYTES] for i in range(0, len(content), CHUNK_BYTES)]
        return {
            language: sum(len(compressor.compress(chunk)) for chunk in chunks)
            for language, compressor in self.compressors.items()
        }

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); ``und`` for texts without a letter. Of equal sizes the language that
        comes first in the dictionaries wins. The score is the share of the language in weights 2^(-8 x bytes more / root of
        the text's length), between 0 and 1."""
        content = normalized(text)
        if not content or not self.compressors:
            return "und", 0.0, 0.0
        ranked = sorted(((size, language) for language, size in self.sizes(content).items()), key=lambda r: r[0])
        best, language = ranked[0]
        unit = 8 * math.log(2) / math.sqrt(len(content))
        weight = sum(math.exp(-unit * (size - best)) for size, _ in ranked)
        margin = (ranked[1][0] - best) / ranked[1][0] if len(ranked) > 1 else 1.0
        return language, 1 / weight, margin


def learn(
    docs: DataFrame,
    trained: Column,
    text: str = "text",
    lang: str = "lang",
    pieces: int = PIECES,
    piece_chars: int = PIECE_CHARS,
) -> dict[str, bytes]:
    """Dictionaries by language, from the rows that ``trained`` names and whose language is known; the
    language of most rows comes first.

    Of each language ``pieces`` distinct texts give a piece from a place that their hash names. The driver
    holds one dictionary of bounded size per language.
    """
    content = or_empty(text)
    rows = docs.filter(trained & F.col(lang).isNotNull() & (F.length(content) > 0)).select(
        F.col(lang).alias("__lang"), content.alias("__text"), F.xxhash64(content).alias("__hash")
    )
    chosen = cut(
        lowest(rows.select("__lang", "__hash").distinct(), "__lang", "__hash", pieces), "language-sample"
    )
    first = F.pmod(F.xxhash64("__hash"), F.greatest(F.length("__text") - piece_chars, F.lit(1))).cast("int") + 1
    found = (
        rows.join(F.broadcast(chosen), ["__lang", "__hash"])
        .select("__lang", "__hash", F.substring("__text", first, F.lit(piece_chars)).alias("__piece"))
        .groupBy("__lang", "__hash")
        .agg(F.min("__piece").alias("__piece"))
        .orderBy("__lang", "__hash")
        .collect()
    )
    parts: dict[str, list[bytes]] = {}
    for language, _, piece in found:
        parts.setdefault(language, []).append(normalized(piece))
    counts = rows.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").collect()
    return {row["__lang"]: b" ".join(p for p in parts[row["__lang"]] if p) for row in counts}


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", margin: float = MARGIN
) -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score, margin, rejected (no letter, or margin too narrow).

    Null, empty and letterless texts, and all texts where nothing was learned, are ``und`` with score 0.
    Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dictionaries)
        for batch in batches:
            rows = [encoder.judge(t.as_py()) for t in batch.column(1)]
            names, scores, margins = zip(*rows) if rows else ((), (), ())
            rejected = [n == "und" or m < margin for n, m in zip(names, margins)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(margins, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=[key, "lang_pred", "score", "margin", "rejected"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, lang_pred string, score double, margin double, rejected boolean"
    return docs.select(key, text).mapInArrow(run, schema)
