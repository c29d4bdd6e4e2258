"""WARC archives as a PySpark Python data source.

Writing: every task writes gzip-free WARC/1.1 records to a file of its own and
reports it; the commit on the driver renames the files of successful tasks and
notes them in a manifest of the job, so retried tasks leave nothing behind and a
folder holds the records of all writes to it (``overwrite`` removes earlier ones).

Reading: partitions are byte ranges cut at record boundaries that the manifests
note (a ``.warc`` file that none lists is one range).  ``rec_type`` and header predicates
are pushed down; a record's headers are parsed first, and a record that fails
them is skipped by its Content-Length without its payload being read or decoded.
A query that selects no payload column doesn't read payloads at all
(option ``payload=false``).

Files are opened through ``pyarrow.fs``, so local and object-store URIs work
alike.  Defined cases: null html is an empty payload; equal payloads under 100
bytes are all responses; ties go to the smallest page_id; rows with a null or
repeated page_id are pages of their own, in the order of ids, nulls last, so one row
of equal payloads is the response, and ``refers_to`` is null if its id is; empty
tables give an archive without files; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from quire.llm.ids import GIVEN, keyed
from quire.session import Scratch, ship, table

QUERY = "op5_warc"
ORACLE_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

SCHEMA = "file string, position long, rec_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length long, headers map<string,string>, payload binary"
LEAST_BYTES = 100
PIECE_BYTES = 16 << 20
MANIFEST = "_manifest-"
#: Fixed value: the profile of revisits whose payload equals that of the record they name.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def record(rec_type: str, record_id: str, uri: str, date: str, payload: bytes, extra: dict[str, str] | None = None) -> bytes:
    """One WARC/1.1 record; line ends inside header values become spaces."""
    clean = lambda v: " ".join(str(v).split())
    heads = {"WARC-Type": rec_type, "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": "text/html; charset=utf-8", **(extra or {}), "Content-Length": str(len(payload))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in heads.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


@dataclass
class Wrote(WriterCommitMessage):
    temporary: str
    name: str
    cuts: list[int]
    size: int


class WarcWriter(DataSourceArrowWriter):
    """Rows (rec_type, record_id, target_uri, date, headers map, payload) to one file a task."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        token = uuid.uuid4().hex
        temporary, at, cuts, last = f"{root}/.{self.job}-{token}", 0, [0], 0
        with fs.open_output_stream(temporary) as out:
            for batch in iterator:
                for r in batch.to_pylist():
                    data = record(r["rec_type"], r["record_id"], r["target_uri"] or "", r["date"], r["payload"] or b"", dict(r["headers"] or {}))
                    if at - last >= PIECE_BYTES:
                        cuts.append(at)
                        last = at
                    out.write(data)
                    at += len(data)
        return Wrote(temporary, f"part-{token}.warc", cuts, at)

    def commit(self, messages) -> None:
        from pyarrow.fs import FileSelector

        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        before = [i.path for i in fs.get_file_info(FileSelector(root)) if i.base_name.startswith(MANIFEST) or i.base_name.endswith(".warc")]
        done = []
        for m in messages:
            if m is not None and m.size:
                fs.move(m.temporary, f"{root}/{m.name}")
                done.append({"name": m.name, "cuts": m.cuts, "size": m.size})
            elif m is not None:
                fs.delete_file(m.temporary)
        with fs.open_output_stream(f"{root}/{MANIFEST}{self.job}.json") as out:
            out.write(json.dumps(done).encode())
        for path in before if self.overwrite else ():
            fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.temporary)


class Piece(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        super().__init__(f"{name}:{start}")
        self.name, self.start, self.end = name, start, end


#: Columns that a header line alone decides, and the header of each (fixed values of the format).
HEADER_OF = {"rec_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


_IDS = frozenset(("warc-record-id", "warc-refers-to"))


def _bare(uri: str | None) -> str | None:
    """A record id without the angle brackets it is written in."""
    return uri[1:-1] if uri and uri[0] == "<" and uri[-1] == ">" else uri


def _headers(stream) -> dict[str, str] | None:
    """The next record's header lines, keys in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := stream.readline()).strip():
        key, _, value = line.decode("utf-8", "replace").partition(":")
        found[key.strip().lower()] = value.strip()
    return found


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, (EqualTo, In, IsNotNull)) else ""
            if name in HEADER_OF and isinstance(f, EqualTo):
                self.wanted.append((HEADER_OF[name], frozenset([f.value])))
            elif name in HEADER_OF and isinstance(f, In):
                self.wanted.append((HEADER_OF[name], frozenset(f.value)))
            elif name in HEADER_OF and isinstance(f, IsNotNull):
                self.wanted.append((HEADER_OF[name], None))
            else:
                yield f

    def partitions(self):
        from pyarrow.fs import FileSelector

        fs, root = _fs(self.path)
        infos, found = fs.get_file_info(FileSelector(root)), []
        for i in infos:
            if i.base_name.startswith(MANIFEST):
                with fs.open_input_stream(i.path) as f:
                    found += json.loads(f.read())
        listed = {f["name"] for f in found}
        found += [{"name": i.base_name, "cuts": [0], "size": i.size} for i in infos if i.base_name.endswith(".warc") and i.base_name not in listed]
        pieces = [Piece(f["name"], a, b) for f in found for a, b in zip(f["cuts"], [*f["cuts"][1:], f["size"]], strict=True)]
        return pieces or [Piece("", 0, 0)]

    def read(self, piece: Piece):
        if not piece.name:
            return
        fs, root = _fs(self.path)
        with fs.open_input_file(f"{root}/{piece.name}") as raw:
            raw.seek(piece.start)
            stream = io.BufferedReader(_Raw(raw), 1 << 16)
            at = piece.start
            while at < piece.end:
                stream_at = at
                heads = _headers(stream)
                if heads is None:
                    return
                length = int(heads.get("content-length", 0))
                bare = lambda k: _bare(heads.get(k)) if k in _IDS else heads.get(k)  # noqa: B023, E731
                keep = all((heads.get(k) is not None) if want is None else bare(k) in want for k, want in self.wanted)
                body = stream.tell()
                payload = stream.read(length) if keep and self.payload else None
                at = stream.seek(body + length + 4)
                if keep:
                    get = heads.get
                    yield (piece.name, stream_at, get("warc-type"), bare("warc-record-id"), get("warc-target-uri"), bare("warc-refers-to"), get("warc-payload-digest"), length, heads, payload)


class _Raw(io.RawIOBase):
    """A pyarrow file with the raw interface that BufferedReader seeks and reads through."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class WarcSource(DataSource):
    """``spark.read.format("quire_warc").load(path)`` and ``df.write.format("quire_warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "quire_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and turns on filter pushdown for Python sources, without
    which Spark refuses a source that takes filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Pages with ``digest``, ``again`` (is it a revisit?) and the ``first`` of equal payloads of at least 100 bytes.

    Only digests held twice are kept for the join, so a payload copied a million
    times costs one row there, and the join's skewed side can be split.
    """
    rows, renumbered = keyed(pages.select("page_id", "url", "html"), scratch, "page_id")
    page = F.concat(F.lit("urn:page:"), F.coalesce(F.col(GIVEN).cast("string"), F.lit("none")), *([F.lit(":row:"), F.col("page_id").cast("string")] if renumbered else []))
    hashed = rows.select("page_id", page.alias("record_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    equal = hashed.where(F.length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.min(F.struct("page_id", "record_id", "url")).alias("first"), F.count("*").alias("n"))
    first = scratch.save(equal.where("n > 1").select("digest", "first"), "first")
    return hashed.join(first, "digest", "left").withColumn("again", F.coalesce(F.col("first.page_id") != F.col("page_id"), F.lit(False)))


def write_archive(pages: DataFrame, path: str, scratch: Scratch) -> None:
    """A record per page: ``response``, or ``revisit`` naming the page whose payload it equals."""
    refers = F.create_map(
        F.lit("WARC-Refers-To"), F.concat(F.lit("<"), "first.record_id", F.lit(">")), F.lit("WARC-Refers-To-Target-URI"), F.coalesce("first.url", F.lit("")), F.lit("WARC-Profile"), F.lit(SAME_PAYLOAD)
    )
    heads = F.map_concat(F.create_map(F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), "digest")), F.when(F.col("again"), refers).otherwise(F.expr("map()").cast("map<string,string>")))
    rows = revisits(pages, scratch).select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("rec_type"),
        "record_id",
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        heads.alias("headers"),
        "payload",
    )
    register(pages.sparkSession)
    rows.write.format("quire_warc").mode("append").save(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    with Scratch(spark) as s:
        write_archive(pages, s.path("archive"), s)
        back = spark.read.format("quire_warc").load(s.path("archive")).where(F.col("rec_type").isin("response", "revisit"))
        number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)", 1).try_cast("long")
        return s.keep(
            back.select(
                number("record_id").alias("page_id"),
                F.length("payload").cast("long").alias("payload_bytes"),
                F.sha2("payload", 256).alias("payload_digest"),
                F.col("rec_type").alias("record_type"),
                number("refers_to").alias("refers_to"),
            )
        )
