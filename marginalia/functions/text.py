"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the web platform trims it, without and with the newline.
SPACE_NO_NEWLINE = (
    "\\t\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
)
SPACE = "\\n" + SPACE_NO_NEWLINE
SPACE_CHARS = "\n\t\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Pairs that may wrap a title, in the order they are stripped.
WRAPPING_PAIRS = (('"', '"'), ("'", "'"), ("\\[", "\\]"), ("\\(", "\\)"), ("“", "”"), ("‘", "’"))

# File extension -> language label of a prompt; the first match wins.
LANGUAGE_OF_EXTENSION = (
    ("py", "python"),
    ("ts|tsx", "typescript"),
    ("js|jsx", "javascript"),
    ("rs", "rust"),
    ("go", "go"),
    ("java", "java"),
    ("cpp|cc|cxx", "cpp"),
    ("c", "c"),
)


def trim_space(col: Column) -> Column:
    """Trim every Unicode space at both ends (``F.trim`` alone only trims U+0020)."""
    return F.trim(col, F.lit(SPACE_CHARS))


def trim_lines(col: Column) -> Column:
    """Trim each line of a text; CRLF becomes LF."""
    return F.array_join(F.transform(F.split(col, "\n", -1), trim_space), "\n")


def is_blank(col: Column) -> Column:
    return ~col.rlike(f"[^{SPACE}]")


def clean_title(col: Column) -> Column:
    """Strip wrapping quotes and brackets, each pair at most once, outside in."""
    result = trim_space(F.coalesce(col, F.lit("")))
    for start, end in WRAPPING_PAIRS:
        result = F.regexp_replace(result, f"(?s)\\A{start}[{SPACE}]*+(.*?)[{SPACE}]*{end}\\z", "$1")
    return result


def source_title(title: Column, fallback: Column) -> Column:
    """Clean title, or the fallback (the file path) when nothing is left."""
    cleaned = clean_title(F.coalesce(title, fallback))
    return F.when(cleaned != "", cleaned).otherwise(F.coalesce(fallback, F.lit("")))


def heading_title(line: Column) -> Column:
    return clean_title(F.regexp_replace(line, f"\\A#+[{SPACE}]*", ""))


def front_matter_title(line: Column) -> Column:
    pattern = f"title[{SPACE}]*:[{SPACE}]*([^\\n\\r\\u2028\\u2029]+)"
    return F.when(line.rlike(pattern), clean_title(F.regexp_extract(line, pattern, 1))).otherwise(
        F.lit("Intro")
    )


def content_checksum(col: Column) -> Column:
    """Hex SHA-256 of the UTF-8 text: the identity of a chunk."""
    return F.sha2(col, 256)


def normalize_source_type(col: Column) -> Column:
    return (
        F.when(col.isin("doc", "mdx"), F.lit("doc"))
        .when(col.isin("code", "typescript", "python", "rust"), F.lit("code"))
        .otherwise(F.lit(None).cast("string"))
    )


def language_of_path(path: Column) -> Column:
    lowered = F.lower(F.coalesce(path, F.lit("")))
    result = None
    for extensions, language in LANGUAGE_OF_EXTENSION:
        hit = lowered.rlike(f"\\.(?:{extensions})\\z")
        result = F.when(hit, language) if result is None else result.when(hit, language)
    return result.otherwise("typescript")


def slice_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines [start, end] of a text, 1-based and inclusive."""
    return F.array_join(
        F.slice(F.split(content, "\n", -1), start, F.greatest(end - start + 1, F.lit(0))), "\n"
    )


def message_text(content: Column, parts: Column | None = None) -> Column:
    """Text of a chat message: the text parts when there are any, else the content."""
    plain = F.coalesce(content, F.lit(""))
    if parts is None:
        return plain
    texts = F.transform(
        F.filter(parts, lambda p: (p["type"] == "text") & F.coalesce(p["text"] != "", F.lit(False))),
        lambda p: p["text"],
    )
    return F.when(parts.isNotNull(), F.array_join(texts, "")).otherwise(plain)


def word_tokens(col: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def one_decimal(value: Column) -> Column:
    """A number with one decimal, rounded by its exact binary value (``format_string`` rounds the
    shortest decimal form, so 76.35, which is a little less, would become 76.4). Below 2**10."""
    # Scaled by a power of two the value is an exact integer that fits 63 bits.
    one = F.when(F.abs(value) < 8, F.lit(2**57)).otherwise(F.lit(2**53))
    scaled = (F.abs(value) * one.cast("double")).cast("bigint").cast("decimal(20,0)")
    unit = one.cast("decimal(20,0)")
    tenths = F.call_function("div", scaled * F.lit(20) + unit, unit * F.lit(2))
    return F.concat(
        F.when(value < 0, "-").otherwise(""),
        F.call_function("div", tenths, F.lit(10)).cast("string"),
        F.lit("."),
        (tenths % 10).cast("string"),
    )
