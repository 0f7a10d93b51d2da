"""Documents as a source of pages: a row for each page, or one for a file or page that can't be taken, never a failed job.

The size limit is a filter on the scan's own column, so that the content of larger files isn't read. Nothing is rendered:
sizes are those that files state, in pixels or points, and a page of a PDF in compressed objects is found by inflating them.

Defined results: unknown and cut files are one row with a code and without pages; files of no bytes have none, since
Spark's reader passes over them (``sniffed_documents`` tells them from a listing); a page without a valid size is a row
of its own, and the other pages stay; a folder without files has no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.runtime import prepare

SCHEMA = "path string, kind string, page int, pages int, width double, height double, status string, error_code string"
NUMBER = rb"(-?[0-9.]+)"
BOX = re.compile(rb"/MediaBox\s*\[\s*" + rb"\s+".join([NUMBER] * 4))
PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
#: What one compressed object may grow to.
INFLATED = 64 << 20


def _box(part: bytes) -> tuple[float, float] | None:
    try:
        left, low, right, high = map(float, BOX.search(part).groups())
    except (AttributeError, ValueError):
        return None
    return abs(right - left), abs(high - low)


def pdf_pages(data: bytes) -> list[tuple[float, float]]:
    """(width, height) in points of each page; a page without a box of its own has the first box of the others' nodes."""
    parts = re.split(rb"\bendobj\b", data)
    for head, body in re.findall(rb"(<<[^\0]{0,400}?/ObjStm[^\0]{0,400}?)stream\r?\n(.*?)endstream", data, re.S):
        if b"/FlateDecode" in head:
            try:
                parts += re.split(rb"(?=<<)(?<=[\s>])(?=<<\s*/(?:Type|Parent|MediaBox|Contents|Resources))", zlib.decompressobj().decompress(body, INFLATED))
            except zlib.error:
                continue
    inherited = next((b for p in parts if not PAGE.search(p) and (b := _box(p))), (0.0, 0.0))
    return [_box(p) or inherited for p in parts if PAGE.search(p)]


def png_size(data: bytes) -> tuple[float, float] | None:
    return struct.unpack(">II", data[16:24]) if len(data) >= 24 and data[12:16] == b"IHDR" else None


def jpeg_size(data: bytes) -> tuple[float, float] | None:
    """From the first frame header; its segments are walked by their lengths."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _rows(data: bytes, most_pages: int, most_side: int, most_pixels: int) -> list[tuple]:
    """(kind, page, pages, width, height, error) of one file."""
    if data.startswith(b"%PDF-"):
        if b"/Encrypt" in data:
            return [("pdf", None, None, None, None, "ENCRYPTED_PDF")]
        pages = pdf_pages(data)
        if not pages or len(pages) > most_pages:
            return [("pdf", None, len(pages), None, None, "PDF_PAGE_LIMIT" if pages else "INVALID_PDF")]
        return [("pdf", n, len(pages), w, h, None if w > 0 and h > 0 else "PDF_PAGE_RENDER_FAILED") for n, (w, h) in enumerate(pages, 1)]
    kind = "png" if data.startswith(b"\x89PNG\r\n\x1a\n") else "jpeg" if data.startswith(b"\xff\xd8\xff") else None
    if not kind:
        return [("unknown", None, None, None, None, "UNSUPPORTED")]
    size = png_size(data) if kind == "png" else jpeg_size(data)
    if not size or min(size) <= 0:
        return [(kind, None, None, None, None, "CORRUPTED_IMAGE")]
    return [(kind, 1, 1, *map(float, size), "IMAGE_TOO_LARGE" if max(size) > most_side or size[0] * size[1] > most_pixels else None)]


def document_pages(spark: SparkSession, path: str, most_bytes: int = 25 << 20, most_pages: int = 20, most_side: int = 12_000, most_pixels: int = 40_000_000) -> DataFrame:
    """A row a page of the files in ``path``, or a row with an error code, in no order."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):  # a file at a time
                rows = _rows(content.as_py() or b"", most_pages, most_side, most_pixels)
                kind, page, n, width, height, error = map(list, zip(*rows, strict=True))
                columns = [[name.as_py()] * len(rows), kind, page, n, width, height, ["failed" if e else "ok" for e in error], error]
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], SCHEMA_NAMES)

    taken = files.filter(F.col("length") <= most_bytes).select("path", "content").mapInArrow(pages, SCHEMA)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("pages", "int"), ("width", "double"), ("height", "double"))]
    large = files.filter(F.col("length") > most_bytes).select("path", F.lit("unknown").alias("kind"), *nothing, F.lit("failed").alias("status"), F.lit("DOCUMENT_TOO_LARGE").alias("error_code"))
    return taken.unionByName(large)


SCHEMA_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
