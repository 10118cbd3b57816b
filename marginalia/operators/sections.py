"""Cut documents into sections at level-2 headings.

A document is one row, so all of its sections are found inside that row: one regex pass trims the
lines, one split cuts before headings, array functions roll sections without content into the next
one. The plan is scan, project, generate; nothing is shuffled, and a document that is much larger
than the rest costs its own length only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.rows import explode_array
from marginalia.functions.text import (
    SPACE_NO_NEWLINE,
    content_checksum,
    front_matter_title,
    heading_title,
    trim_lines,
)

_EOL = "(?=\\n|\\z)"
_TOC = f"[^\\n]*\\[!toc\\]{_EOL}"
# A heading line: exactly two hashes, then a space or the end, and no [!toc] mark.
_HEADING = f"(?!{_TOC})##(?:[{SPACE_NO_NEWLINE}][^\\n]*)?{_EOL}"
_BEFORE_HEADING = f"\\n(?={_HEADING})"
_CONTENT_LINE = f"(?:\\A|\\n)(?!title)(?!{_HEADING})[^\\n]"
_LAST_TITLE_LINE = f"\\A(?:(?s:.*)\\n)?(title[^\\n]*|{_HEADING}){_EOL}"


def with_section_title(df: DataFrame, section_col: str, title_col: str = "chunk_title") -> DataFrame:
    """Title of a section: its last heading or ``title`` line, ``Intro`` when that is empty."""
    line = F.col("_title_line")
    title = F.when(line.startswith("##"), heading_title(line)).when(
        line != "", front_matter_title(line)
    )
    return (
        df.withColumn("_title_line", F.regexp_extract(F.col(section_col), _LAST_TITLE_LINE, 1))
        .withColumn(title_col, title)
        .withColumn(title_col, F.coalesce(F.nullif(F.col(title_col), F.lit("")), F.lit("Intro")))
        .drop("_title_line")
    )


def with_sections(df: DataFrame, content_col: str, sections_col: str) -> DataFrame:
    """Add the array of section texts of each document.

    The intermediate arrays are columns of their own: a lambda would compute them once per element.
    """
    previous = lambda n: F.get(F.col("_closing"), n - 1)
    flagged = F.transform(
        F.col("_pieces"),
        lambda text, i: F.struct(i.alias("i"), text.rlike(_CONTENT_LINE).alias("full")),
    )
    # Pieces with content close a section that began right after the previous such piece.
    closing = F.transform(F.filter(flagged, lambda piece: piece["full"]), lambda piece: piece["i"])
    joined = F.transform(
        F.col("_closing"),
        lambda last, n: F.array_join(
            F.slice(
                F.col("_pieces"),
                F.coalesce(previous(n), F.lit(-1)) + 2,
                last - F.coalesce(previous(n), F.lit(-1)),
            ),
            "\n",
        ),
    )
    return (
        df.withColumn("_pieces", F.split(trim_lines(F.col(content_col)), _BEFORE_HEADING, -1))
        .withColumn("_closing", closing)
        .withColumn(sections_col, joined)
        .drop("_pieces", "_closing")
    )


def chunk_sections(df: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per section: the input columns without the content, plus ``chunk_id`` (0-based),
    ``chunk_content``, ``chunk_title`` and ``checksum``."""
    kept = [F.col(c) for c in df.columns if c != content_col]
    cut = explode_array(
        with_sections(df, content_col, "_sections"), kept, F.col("_sections"), "chunk_id", "chunk_content"
    )
    return with_section_title(cut, "chunk_content").withColumn(
        "checksum", content_checksum(F.col("chunk_content"))
    )
