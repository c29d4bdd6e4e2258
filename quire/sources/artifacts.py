"""Sinks: rows of a document's artefacts, externalised pictures and their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.udf import over_text
from quire.operators import render

#: Fixed value: the offset of this hash. It isn't the usual FNV one, and names of pictures depend on it.
FNV_OFFSET, FNV_PRIME = 1469598103934665603, 1099511628211


def fnv_hex(data: bytes) -> str:
    """64-bit FNV-1a with the offset above, as 16 hex digits."""
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


text_hash = over_text(lambda s: fnv_hex(s.encode()))


def bytes_hash(c: Column) -> Column:
    return F.udf(lambda b: None if b is None else fnv_hex(bytes(b)))(c)


DATA_URI = r"data:image/[a-z]+;base64,([A-Za-z0-9+/=]+)"


def externalise(df: DataFrame, key: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with file names instead of data URIs, (key, name, data) of the pictures, each once).

    The name is the hash of the base64 text.
    """
    body = F.regexp_extract(path, f"^{DATA_URI}$", 1)
    named = df.withColumn("__data", F.when(body != "", body)).withColumn("__name", F.concat(text_hash(F.col("__data")), F.lit(".jpg")))
    rows = named.withColumn(path, F.coalesce("__name", F.col(path))).drop("__data", "__name")
    pictures = named.where("__data IS NOT NULL").select(key, F.col("__name").alias("name"), F.col("__data").alias("data")).distinct()
    return rows, pictures


def artefacts(df: DataFrame, stem: str, pages: str, o: render.Options = render.Options(bucket="images"), model: str | None = None) -> DataFrame:
    """(stem, artefact, payload) of each document: Markdown, both content lists and the tree; the detections
    too where ``model`` names their column."""
    made = {
        ".md": render.markdown(F.col(pages), "mm", o), "_content_list.json": render.content_list(F.col(pages), o),
        "_content_list_v2.json": render.content_list_v2(F.col(pages), o), "_middle.json": F.to_json(F.struct(F.col(pages).alias("pdf_info"))),
    }
    if model is not None:
        made["_model.json"] = F.to_json(F.col(model))
    rows = df.select(F.col(stem).alias("stem"), F.explode(F.create_map(*(x for k, v in made.items() for x in (F.lit(k), v)))).alias("artefact", "payload"))
    return rows


def write_artefacts(rows: DataFrame, path: str, backend: str = "pipeline") -> None:
    """Artefact rows as text, a folder for each stem and artefact."""
    rows.select("stem", F.lit(backend).alias("backend"), "artefact", F.col("payload").alias("value")).write.partitionBy("stem", "backend", "artefact").mode("overwrite").text(path)


def response(df: DataFrame, pages: str, images: Column | None = None, layout_pdf: Column | None = None, timing: Column | None = None, o: render.Options = render.Options()) -> DataFrame:
    """``df`` with a JSON ``response``: Markdown, content list and pictures by name; the overlay (base64) and
    the seconds of each stage where they are given."""
    parts = {
        "md_content": render.markdown(F.col(pages), "mm", o), "content_list": F.parse_json(render.content_list(F.col(pages), o)),
        "images": F.create_map().cast("map<string,string>") if images is None else images, "layout_pdf": layout_pdf, "timing": timing,
    }
    return df.withColumn("response", F.to_json(F.struct(*(c.alias(k) for k, c in parts.items() if c is not None))))


def layout_only(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(page_idx, blocks JSON) of parsed layout rows, in order."""
    one = F.struct("type", F.array("x0", "y0", "x1", "y1").alias("bbox"), "angle")
    rows = blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return rows.select(*keys, F.to_json(F.struct("blocks")).alias("layout"))
