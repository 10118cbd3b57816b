"""Split texts to a token budget: greedy packing of lines, hard cuts of over-long lines.

The packing is sequential within one text: it goes from part to part over the running token counts of the
lines, an Arrow batch of texts at a time. Only counts go there, only those of texts over the budget,
and no rows move between partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.rows import explode_array
from marginalia.functions.text import content_checksum, is_blank, trim_space
from marginalia.functions.tokens import (
    CHARS_PER_TOKEN,
    TokenizerFactory,
    estimate_tokens,
    sanitize_special_tokens,
)
from marginalia.operators.sections import chunk_sections, with_section_title, with_sections

_RANGES = "array<array<struct<first:int,last:int,hard:boolean>>>"


def line_ranges(
    tokens: np.ndarray, blank: np.ndarray, limit: int, newline_tokens: int = 1
) -> tuple[list[int], list[int], list[bool]]:
    """First and last line of the parts of one text, and whether a part is one line over the limit.

    Blank lines at the start and after an over-long line belong to no part. The end of a part is found
    by a binary search in the running sums, so the time grows with the lines and parts alone.
    """
    count = len(tokens)
    sums = np.concatenate([[0], np.cumsum(tokens.astype(np.int64) + newline_tokens)])
    hard = np.flatnonzero(tokens > limit)
    filled = np.flatnonzero(~blank | (tokens > limit))
    firsts, lasts, over = [], [], []

    def part(first: int, last: int, is_hard: bool) -> None:
        firsts.append(first)
        lasts.append(last)
        over.append(is_hard)

    at, is_open = 0, False
    while at < count:
        if not is_open:
            place = int(filled.searchsorted(at))
            if place == len(filled):
                break
            at = int(filled[place])
        place = int(hard.searchsorted(at))
        next_hard = int(hard[place]) if place < len(hard) else count
        if at == next_hard:
            part(at, at, True)
            at, is_open = at + 1, False
            continue
        end = int(sums.searchsorted(sums[at] + limit + newline_tokens, "right")) - 1
        end = max(at + 1, min(end, next_hard))
        part(at, end - 1, False)
        at, is_open = end, True
    return firsts, lasts, over


def _packed_lines(newline_tokens: int):
    """UDF (per text its lines as (tokens, blank) or null, limit) -> per text its ranges or null."""

    @F.arrow_udf(_RANGES)
    def packed(texts: pa.Array, limits: pa.Array) -> pa.Array:
        lines = texts.flatten()
        entries = lines.flatten()
        tokens = entries.field("tokens").to_numpy(zero_copy_only=False)
        blank = entries.field("blank").to_numpy(zero_copy_only=False).astype(bool)
        sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
        limit = limits.to_numpy(zero_copy_only=False)
        missing = lines.is_null().to_numpy(zero_copy_only=False)
        firsts, lasts, over, counts, start = [], [], [], [], 0
        for n, size in enumerate(sizes.tolist()):
            found = ([], [], []) if missing[n] else line_ranges(
                tokens[start : start + size], blank[start : start + size], int(limit[owner[n]]), newline_tokens
            )
            start += size
            counts.append(len(found[0]))
            for held, own in zip((firsts, lasts, over), found):
                held.extend(own)
        parts = pa.StructArray.from_arrays(
            [pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(over, pa.bool_())],
            names=["first", "last", "hard"],
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        inner = pa.ListArray.from_arrays(offsets, parts, mask=pa.array(missing) if len(missing) else None)
        outer = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32))
        return pa.ListArray.from_arrays(outer, inner)

    return packed


def hard_pieces(line: Column, limit: Column) -> Column:
    """Pieces of ``limit`` estimated tokens each; blank pieces are dropped."""
    width = (F.greatest(limit, F.lit(1)) * CHARS_PER_TOKEN).cast("int")
    count = F.ceil(F.length(line) / width).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda n: F.substring(line, n * width + 1, width),
    )
    return F.filter(cut, lambda piece: ~is_blank(piece))


def _measured_texts(tokenizer: TokenizerFactory):
    """UDF (texts, limit, total limit) -> per text null when it fits, else its lines with their
    token counts and, for lines over the limit, their pieces."""

    @F.pandas_udf("array<array<struct<tokens:int,pieces:array<string>>>>")
    def measured(
        batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.Series]:
        model = tokenizer()

        def line_of(line: str, limit: int) -> dict:
            tokens = model.encode(line) if line else []
            pieces = []
            if len(tokens) > limit:
                step = max(1, limit)
                pieces = [model.decode(tokens[at : at + step]) for at in range(0, len(tokens), step)]
            return {"tokens": len(tokens), "pieces": [piece for piece in pieces if piece.strip()]}

        def text_of(text: str, limit: int, total: int):
            if not text or len(model.encode(text)) <= total:
                return None
            return [line_of(line, limit) for line in text.split("\n")]

        for texts, limits, totals in batches:
            yield pd.Series(
                [
                    None if row is None else [text_of(text, int(n), int(m)) for text in row]
                    for row, n, m in zip(texts, limits, totals)
                ],
                dtype=object,
            )

    return measured


def split_texts(
    df: DataFrame,
    texts_col: str,
    limit: Column,
    total_limit: Column | None = None,
    tokenizer: TokenizerFactory | None = None,
    newline_tokens: int = 1,
) -> DataFrame:
    """Add ``parts``: for each text of the array column null when it has at most ``total_limit``
    tokens (default ``limit``), else an array of (text, first, last) with 0-based line numbers."""
    total_limit = limit if total_limit is None else total_limit
    sized = df.withColumns({"_limit": limit.cast("int"), "_total": total_limit.cast("int")})
    if tokenizer is None:
        over = F.transform(
            F.col(texts_col), lambda text: F.when(estimate_tokens(text) > F.col("_total"), text)
        )
        sized = sized.withColumn("_over", over)
        measure = lambda lines, i: F.transform(
            lines, lambda line: F.struct(estimate_tokens(line).alias("tokens"), is_blank(line).alias("blank"))
        )
        pieces = lambda row, i: hard_pieces(F.get(row["_lines"], i), F.col("_limit"))
    else:
        clean = F.transform(F.col(texts_col), sanitize_special_tokens)
        sized = (
            sized.withColumn("_clean", clean)
            .withColumn("_measured", _measured_texts(tokenizer)("_clean", "_limit", "_total"))
            .withColumn(
                "_over",
                F.zip_with("_clean", "_measured", lambda text, m: F.when(m.isNotNull(), text)),
            )
        )
        measure = lambda lines, i: F.zip_with(
            lines,
            F.get(F.col("_measured"), i),
            lambda line, m: F.struct(m["tokens"].alias("tokens"), is_blank(line).alias("blank")),
        )
        pieces = lambda row, i: F.get(row["_measured"], i)["pieces"]

    def parts_of(row: Column) -> Column:
        def texts(part: Column) -> Column:
            joined = F.array_join(
                F.slice(row["_lines"], part["first"] + 1, part["last"] - part["first"] + 1), "\n"
            )
            return F.transform(
                F.when(part["hard"], pieces(row, part["first"])).otherwise(F.array(joined)),
                lambda text: F.struct(
                    text.alias("text"), part["first"].alias("first"), part["last"].alias("last")
                ),
            )

        return F.flatten(F.transform(row["_ranges"], texts))

    zipped = ["_lines", "_ranges"] + ([] if tokenizer is None else ["_measured"])
    return (
        sized.withColumn("_lines", F.transform("_over", lambda text: F.split(text, "\n", -1)))
        .withColumn("_sizes", F.transform("_lines", measure))
        .withColumn("_ranges", _packed_lines(newline_tokens)("_sizes", "_limit"))
        .withColumn("parts", F.transform(F.arrays_zip(*zipped), parts_of))
        .drop("_limit", "_total", "_over", "_clean", "_measured", "_lines", "_sizes", "_ranges")
    )


def _part_rows(df: DataFrame, text_col: str) -> DataFrame:
    """Explode ``_parts`` of titled sections; sections that fit stay as they are."""
    whole = F.array(
        F.struct(F.col(text_col).alias("text"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    )
    title = trim_space(F.coalesce(F.col("chunk_title"), F.lit("")))
    numbered = F.concat(
        F.coalesce(F.nullif(title, F.lit("")), F.lit("chunk")),
        F.lit("_"),
        (F.col("_part") + 1).cast("string"),
    )
    kept = [c for c in df.columns if c not in (text_col, "_parts", "checksum")]
    return (
        explode_array(
            df.withColumn("_split", F.col("_parts").isNotNull()),
            [*kept, "_split"],
            F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(whole),
            "_part",
            "_piece",
        )
        .withColumns(
            {
                "chunk_content": F.col("_piece.text"),
                "chunk_title": F.when(F.col("_split"), numbered).otherwise(F.col("chunk_title")),
                "checksum": content_checksum(F.col("_piece.text")),
            }
        )
        .drop("_split", "_piece")
    )


def enforce_token_limit(
    df: DataFrame,
    limit: int,
    tokenizer: TokenizerFactory | None = None,
    key: str = "filepath",
) -> DataFrame:
    """Replace chunks over the limit by parts titled ``<title>_<i>`` and renumber ``chunk_id``.

    Works on chunks that are rows already, so the numbering is a window over each file; for
    documents ``chunk_documents`` gives the same rows without a shuffle. A limit below 1 changes
    nothing.
    """
    if limit < 1:
        return df
    sized = split_texts(
        df.withColumn("_texts", F.array("chunk_content")), "_texts", F.lit(limit), tokenizer=tokenizer
    ).drop("_texts")
    rows = _part_rows(sized.withColumn("_parts", F.get("parts", F.lit(0))).drop("parts"), "chunk_content")
    order = Window.partitionBy(key).orderBy("chunk_id", "_part")
    return rows.withColumn("chunk_id", F.row_number().over(order) - 1).select(*df.columns)


def chunk_documents(
    df: DataFrame,
    limit: int,
    content_col: str = "content",
    tokenizer: TokenizerFactory | None = None,
) -> DataFrame:
    """Sections of each document, split to the token limit, numbered from 0 within the document.

    Both steps happen inside the document's row, so the numbering needs no window and no shuffle.
    """
    if limit < 1:
        return chunk_sections(df, content_col)
    kept = [c for c in df.columns if c != content_col]
    sized = split_texts(
        with_sections(df, content_col, "_sections"), "_sections", F.lit(limit), tokenizer=tokenizer
    )
    # A split section shifts the sections after it by its number of extra parts.
    extra = F.filter(
        F.transform(
            "parts",
            lambda p, i: F.struct(i.alias("i"), F.greatest(F.coalesce(F.size(p), F.lit(1)) - 1, F.lit(0)).alias("n")),
        ),
        lambda x: x["n"] > 0,
    )
    rows = (
        explode_array(
            sized.withColumn("_extra", extra),
            [*kept, "_extra"],
            F.arrays_zip("_sections", "parts"),
            "_section_no",
            "_row",
        )
        .withColumn(
            "chunk_id",
            F.col("_section_no")
            + F.aggregate(
                F.col("_extra"),
                F.lit(0),
                lambda total, x: total + F.when(x["i"] < F.col("_section_no"), x["n"]).otherwise(0),
            ),
        )
        .withColumn("chunk_content", F.col("_row._sections"))
        .withColumn("_parts", F.col("_row.parts"))
        .drop("_extra", "_section_no", "_row")
    )
    titled = with_section_title(rows, "chunk_content")
    return (
        _part_rows(titled, "chunk_content")
        .withColumn("chunk_id", F.col("chunk_id") + F.col("_part"))
        .select(*kept, "chunk_id", "chunk_content", "chunk_title", "checksum")
    )
