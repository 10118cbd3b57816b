"""WARC archives: write captures as records, read archives, assemble transactions.

A capture is a request, a response (or a revisit, when an earlier page has the same payload) and a
metadata record. Request and metadata name the response in WARC-Concurrent-To. Archives are written by
the text writer: a WARC record of UTF-8 text ends with the two line breaks that it puts between rows.
They are read as binary files and cut into records by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.storage import cut, new_path
from marginalia.llm.text import or_empty

#: Captures of an archive at most, and bytes of their payloads if there are several; an archive is read by
#: one task. Longer payloads go to archives of fewer captures: payloads are told apart by the power of
#: ``LENGTH_STEP`` that bounds them.
ARCHIVE_CAPTURES = 1000
ARCHIVE_BYTES = 128 << 20
LENGTH_STEP = 16
#: Bytes of an archive that are decompressed at once.
PIECE_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
#: Bytes of blocks that the reader hands on at once.
BATCH_BYTES = 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_BREAK = "\r\n"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8, by parts of 20 bits."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(
        F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def _record_id(page: Column, url: Column, digest: Column) -> Column:
    """A UUID of what the record captures."""
    name = F.md5(F.concat_ws("\n", or_empty(page.cast("string")), or_empty(url), digest))
    parts = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: Column | str, fields: dict[str, Column], block: Column) -> Column:
    """A record without its closing line breaks; fields that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(_BREAK, *lines), F.lit(_BREAK * 2), block)


def first_captures(pages: DataFrame, key: str, url: str, html: str, revisit_bytes: int) -> DataFrame:
    """(digest, first, first_url): of each payload of at least ``revisit_bytes`` bytes that several rows
    have, the smallest key and its URL."""
    content = or_empty(html)
    return cut(
        pages.filter(F.octet_length(content) >= revisit_bytes)
        .groupBy(base32_sha1(content).alias("__first_digest"))
        .agg(
            F.min(key).alias("__first"),
            F.min_by(url, F.when(F.col(key).isNotNull(), F.struct(key, url))).alias("__first_url"),
            F.count("*").alias("__n"),
        )
        .filter("__n > 1 and __first is not null")
        .drop("__n"),
        "warc-first",
    )


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    revisit_bytes: int = 0,
    archive_captures: int = ARCHIVE_CAPTURES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write three records for every row of ``pages`` to gzip archives in ``path``.

    An archive holds up to ``archive_captures`` rows with up to ``archive_bytes`` bytes of html, or one row.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes, the smallest key is a response, as
    are rows that repeat that key; others, also those without a key, are revisits of it without a
    payload. Smaller payloads, and equal payloads of which no row has a key, are responses. A null html
    is an empty payload; a null URL leaves the target out; line breaks in a URL are percent-encoded.
    """
    rows = pages.select(
        F.col(key).alias("__key"),
        F.col(url).alias("__url"),
        or_empty(html).alias("__html"),
        base32_sha1(or_empty(html)).alias("__digest"),
    )
    first = first_captures(pages, key, url, html, revisit_bytes)
    # Written before, so that both sides of the join are dealt out for it and a hot payload can be split.
    joined = rows.join(first, F.col("__digest") == F.col("__first_digest"), "left")
    again = F.col("__first").isNotNull() & ~F.col("__key").eqNullSafe(F.col("__first"))
    own = _record_id(F.col("__key"), F.col("__url"), F.col("__digest"))
    target = _one_line(F.col("__url"))
    rest = F.regexp_extract("__url", r"://[^/?#]*([^#]*)", 1)
    host = _one_line(or_empty(F.regexp_extract("__url", r"://([^/?#]*)", 1)))
    asked = F.concat(
        F.lit("GET "),
        F.when(or_empty(rest).startswith("/"), _one_line(rest)).otherwise(
            F.concat(F.lit("/"), _one_line(or_empty(rest)))
        ),
        F.lit(f" HTTP/1.1{_BREAK}Host: "),
        host,
        F.lit(_BREAK * 2),
    )
    length = F.octet_length("__html").cast("string")
    answered = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}Content-Length: "),
        length,
        F.lit(_BREAK * 2),
        F.when(again, F.lit("")).otherwise(F.col("__html")),
    )
    described = F.concat_ws(
        _BREAK,
        F.concat(F.lit("page-id: "), F.col("__key").cast("string")),
        F.concat(F.lit("payload-length: "), length),
        F.when(again, F.concat(F.lit("refers-to-page-id: "), F.col("__first").cast("string"))),
        F.lit(""),
    )
    earlier = F.when(again, _record_id(F.col("__first"), F.col("__first_url"), F.col("__digest")))

    def part_id(name: str) -> Column:
        return F.replace(own, F.lit("<urn:uuid:"), F.lit(f"<urn:{name}:"))

    request = _record(
        "request",
        {
            "WARC-Record-ID": part_id("request"),
            "WARC-Concurrent-To": own,
            "WARC-Target-URI": target,
            "Content-Type": F.lit("application/http; msgtype=request"),
        },
        asked,
    )
    response = _record(
        F.when(again, "revisit").otherwise("response"),
        {
            "WARC-Record-ID": own,
            "WARC-Target-URI": target,
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("__digest")),
            "WARC-Profile": F.when(again, F.lit(REVISIT_PROFILE)),
            "WARC-Refers-To": earlier,
            "Content-Type": F.lit("application/http; msgtype=response"),
        },
        answered,
    )
    metadata = _record(
        "metadata",
        {
            "WARC-Record-ID": part_id("metadata"),
            "WARC-Concurrent-To": own,
            "WARC-Target-URI": target,
            "Content-Type": F.lit("application/warc-fields"),
        },
        described,
    )
    # The longest payload, in bytes, of archives of so many captures; longer ones come one by one.
    bounds, captures = [], archive_captures
    while captures > 1:
        bounds.append((captures, archive_bytes // captures))
        captures //= LENGTH_STEP
    bounds.append((1, None))
    size = F.octet_length("__html")
    tier = F.coalesce(*(F.when(size <= most, F.lit(n)) for n, most in bounds if most is not None), F.lit(1))
    lengths = rows.select(tier.alias("captures")).groupBy("captures").count().collect()
    mode = "errorifexists"
    for held in sorted((r["captures"] for r in lengths), reverse=True) or [archive_captures]:
        joined.filter(tier == held).select(
            F.concat_ws(_BREAK * 2, request, response, metadata).alias("value")
        ).write.mode(mode).option("lineSep", _BREAK * 2).option("compression", "gzip").option(
            "maxRecordsPerFile", held
        ).text(path)
        mode = "append"


def _pieces(content: bytes) -> Iterator[bytes]:
    """An archive, decompressed piece by piece; gzip archives may have many members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    stream = zlib.decompressobj(31)
    while at < len(view):
        fed: bytes | memoryview = view[at : at + PIECE_BYTES]
        at += len(fed)
        while len(fed) and not stream.eof:
            if piece := stream.decompress(fed, PIECE_BYTES):
                yield piece
            fed = stream.unconsumed_tail
        while not stream.eof and (piece := stream.decompress(b"", PIECE_BYTES)):
            yield piece
        if stream.eof:
            at -= len(stream.unused_data)
            stream = zlib.decompressobj(31)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of every record of an archive; gzip archives may have many members.
    What is decompressed at once is a record and a piece of the next."""
    pieces, held, at, passed = _pieces(content), bytearray(), 0, 0

    def more() -> bool:
        nonlocal at, passed
        if (piece := next(pieces, None)) is None:
            return False
        del held[:at]
        passed, at = passed + at, 0
        held.extend(piece)
        return True

    while True:
        while len(held) - at >= 2 or more():
            if len(held) - at >= 2:
                if held[at : at + 2] != b"\r\n":
                    break
                at += 2
        if at >= len(held):
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not more():
                raise ValueError(f"the header at byte {passed + at} does not end")
        version, *lines = bytes(held[at:end]).split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {passed + at}")
        fields = {}
        for line in lines:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        at = end + 4
        size = int(fields["content-length"])
        while len(held) - at < size:
            if not more():
                raise ValueError(f"the archive ends inside the record at byte {passed + at}")
        yield fields, bytes(held[at : at + size])
        at += size


_RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
    "claimed_digest string, digest string, payload_bytes long, block binary"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``. Of HTTP blocks, payload_bytes and digest (base32
    SHA-1) are those of what follows the HTTP header. A record that does not parse fails the job."""
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string()] * 7 + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for fields, block in parse_records(archive.as_py()):
                    payload = block
                    if fields.get("content-type", "").startswith("application/http"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    rows.append(
                        (
                            fields.get("warc-record-id"),
                            fields.get("warc-type"),
                            fields.get("warc-concurrent-to"),
                            fields.get("warc-refers-to"),
                            fields.get("warc-target-uri"),
                            fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                            len(payload),
                            block,
                        )
                    )
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return files.option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, _RECORDS)


def metadata_field(block: Column, name: str) -> Column:
    found = F.regexp_extract(block.cast("string"), rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: its fields, then request and metadata (structs, null where
    no record is concurrent to it). Of several requests or metadata records of one capture, which only
    rows that repeat key, URL and payload give, one is taken."""

    part = F.struct(F.col("record_id").alias("id"), "target_uri", "block")
    kinds = ("request", "metadata")
    beside = (
        records.filter(F.col("type").isin(*kinds))
        .groupBy(F.col("concurrent_to").alias("record_id"))
        .agg(*[F.min(F.when(F.col("type") == kind, part)).alias(kind) for kind in kinds])
    )
    captures = records.filter(F.col("type").isin("response", "revisit"))
    return captures.join(beside, "record_id", "left")


def archived_captures(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0
) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them and assemble the transactions.

    One row per row of ``pages``: the columns of ``assemble`` and, from the metadata, the key, page_bytes
    and refers_to_page. What a response says of its payload is compared with the payload that was read.
    An empty table gives no rows.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, key, url, html, revisit_bytes)
    kind = pages.schema[key].dataType.simpleString()
    block = F.col("metadata.block")
    captures = assemble(read_archives(pages.sparkSession, path))
    intact = (F.col("type") == "revisit") | F.col("claimed_digest").eqNullSafe(F.col("digest"))
    return captures.withColumn(
        "claimed_digest",
        F.when(intact, F.col("claimed_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))),
    ).select(
        metadata_field(block, "page-id").cast(kind).alias(key),
        F.when(F.col("type") == "revisit", metadata_field(block, "payload-length").cast("long"))
        .otherwise(F.col("payload_bytes"))
        .alias("page_bytes"),
        metadata_field(block, "refers-to-page-id").cast(kind).alias("refers_to_page"),
        *captures.columns,
    )
