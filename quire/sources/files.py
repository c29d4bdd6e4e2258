"""Documents from files: bytes, image sniffing, wrapping of images into PDF, parsing of document JSON."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.schema import DOCUMENT

#: First bytes of image formats.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "bmp": "424D", "gif": "47494638", "tiff_le": "49492A00", "tiff_be": "4D4D002A"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, kind) of every file below a path; kind is pdf, an image format or null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", kind_of(F.col("content")).alias("kind"))


def image_kind(content: Column) -> Column:
    """Image format by the first bytes, null if none fits."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for name, magic in MAGIC.items():
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def kind_of(content: Column) -> Column:
    return F.when(F.hex(F.substring(content, 1, 5)) == "255044462D", "pdf").otherwise(image_kind(content))


def accept(files: DataFrame) -> DataFrame:
    """Files that are PDF or images; anything else raises."""
    bad = F.raise_error(F.concat(F.lit("neither PDF nor image: "), F.col("path"))).cast("string")
    return files.withColumn("kind", F.coalesce("kind", bad))


def jpeg_size(data: bytes) -> tuple[int, int, int]:
    """(width, height, components) from a JPEG's frame header."""
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            raise ValueError("damaged JPEG")
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w, n = struct.unpack_from(">HHB", data, at + 5)
            return w, h, n
        at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack_from(">H", data, at + 2)[0]
    raise ValueError("JPEG without a frame")


def jpeg_to_pdf(data: bytes, dpi: int = 200) -> bytes:
    """A one-page PDF that holds the JPEG as it is, a pixel being 1/dpi inch."""
    w, h, n = jpeg_size(data)
    pw, ph = w * 72 / dpi, h * 72 / dpi
    space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n]
    draw = b"q %.4f 0 0 %.4f 0 0 cm /I Do Q" % (pw, ph)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] /Resources << /XObject << /I 4 0 R >> >> /Contents 5 0 R >>" % (pw, ph),
        b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /%s /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n" % (w, h, space.encode(), len(data)) + data + b"\nendstream",
        b"<< /Length %d >>\nstream\n" % len(draw) + draw + b"\nendstream",
    ]
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    return out + b"xref\n0 6\n0000000000 65535 f \n" + table + b"trailer << /Size 6 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % len(out)


def as_pdf(files: DataFrame) -> DataFrame:
    """``content`` of JPEG files wrapped into PDF, PDF as it is; other images need a decoder and give null."""

    @F.udf("binary")
    def wrap(data):  # user functions run over all rows, whatever the condition around them
        return jpeg_to_pdf(bytes(data)) if data is not None and bytes(data[:3]) == b"\xff\xd8\xff" else None

    return files.withColumn("content", F.when(F.col("kind") == "pdf", F.col("content")).when(F.col("kind") == "jpeg", wrap("content")))


def parse_documents(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``document`` (known fields, typed) and ``raw`` (all of the JSON as a variant).

    Unknown keys and explicit nulls live on in ``raw``; absent block lists become empty.
    """
    known = F.from_json(F.col(text), DOCUMENT)
    pages = F.transform(
        F.coalesce(known["pdf_info"], F.slice(known["pdf_info"], 1, 0)),
        lambda p: p.withField("para_blocks", F.coalesce(p["para_blocks"], F.from_json(F.lit("[]"), F.lit(_blocks())))).withField(
            "discarded_blocks", F.coalesce(p["discarded_blocks"], F.from_json(F.lit("[]"), F.lit(_blocks())))
        ),
    )
    return df.withColumn("document", known.withField("pdf_info", pages)).withColumn("raw", F.parse_json(F.col(text)))


def _blocks() -> str:
    from quire.schema import BLOCK

    return f"array<{BLOCK}>"


def dump_document(raw: Column) -> Column:
    """The variant as JSON text, every key kept."""
    return F.to_json(raw)
