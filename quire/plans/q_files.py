"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout
from quire.plans import (
    q_render,  # noqa: F401  its SQL is part of the artefacts'
    registry,
    views,
)
from quire.plans.registry import query
from quire.session import table
from quire.sources import artifacts, files

HEADS = ("89504E470D0A1A0A00", "FFD8FFE0", "424D3A", "474946383961", "49492A0001", "4D4D002A", "524946460000000057454250", "255044462D", "00")


@query(
    "image_sniff",
    "SELECT doc_id, CASE (doc_id % 9)::INT WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'bmp' WHEN 3 THEN 'gif' WHEN 4 THEN 'tiff_le' WHEN 5 THEN 'tiff_be' WHEN 6 THEN 'webp' WHEN 7 THEN 'pdf' END AS kind FROM documents",
)
def image_sniff(spark, sf_dir):
    head = F.unhex(F.get(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % len(HEADS)).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", files.kind_of(F.concat(head, F.encode("text", "UTF-8"))).alias("kind"))


def _fnv_sql(text: str) -> str:
    """The hash of a text's bytes, one step a byte in 128-bit integers."""
    h = f"hex(encode({text}))"
    step = f"lambda h, b: xor(h, b) * {artifacts.FNV_PRIME}::HUGEINT % 18446744073709551616::HUGEINT"
    bytes_ = f"list_transform(regexp_extract_all({h}, '..'), lambda x: ('0x' || x)::HUGEINT)"
    return f"lower(lpad(to_hex(list_reduce(list_prepend({artifacts.FNV_OFFSET}::HUGEINT, {bytes_}), {step})::UBIGINT), 16, '0'))"


@query("image_hash", f"SELECT doc_id, CASE WHEN text = '' THEN lower(lpad(to_hex({artifacts.FNV_OFFSET}), 16, '0')) ELSE {_fnv_sql('text')} END AS hash FROM documents")
def image_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", artifacts.text_hash(F.col("text")).alias("hash"))


@query(
    "externalised_pictures",
    f"""WITH b AS (SELECT doc_id, base64(encode(text)) AS data FROM documents)
    SELECT doc_id, CASE WHEN data = '' THEN 'data:image/jpeg;base64,' WHEN data IS NOT NULL THEN {_fnv_sql("data")} || '.jpg' END AS image_path, nullif(data, '') AS data FROM b""",
)
def externalised_pictures(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("data:image/jpeg;base64,"), F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")).alias("image_path"))
    named, pictures = artifacts.externalise(rows, "doc_id", "image_path")
    at = F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.image_path") == F.col("p.name"))
    return named.alias("r").join(pictures.alias("p"), at, "left").select("r.doc_id", "r.image_path", "p.data")


def _tree_sql(keys: bool) -> str:
    """The JSON of a document's page: keys in the order of the schema, or alphabetical with whole numbers bare."""
    num = (lambda x: f"({x})") if keys else (lambda x: f"({x}) || '.0'")
    join = lambda **kv: "'{' || concat_ws(',', " + ", ".join(f"'\"{k}\":' || {v}" for k, v in (sorted(kv.items()) if keys else kv.items())) + ") || '}'"
    span = join(type="to_json(kind)::VARCHAR", content="to_json(content)::VARCHAR")
    box = f"'[' || {num('10')} || ',' || {num('b')} || ',' || {num('300')} || ',' || b || '.5' || ']'".replace("b || '.5'", "(b + 9) || '.5'")
    block = join(type="to_json(kind)::VARCHAR", level="b % 6", index=num("b"), bbox=box, lines="'[' || lines || ']'")
    size = f"'[' || {num('612')} || ',' || {num('792')} || ']'"
    page = join(page_idx="0", page_size=size, para_blocks="'[' || coalesce(para, '') || ']'", discarded_blocks="'[' || coalesce(gone, '') || ']'")
    return f"""WITH {views.BLOCKS_SQL},
    jl AS (SELECT doc_id, b, i, '{{"spans":[' || string_agg({span}, ',' ORDER BY j) || ']}}' AS line FROM sp GROUP BY ALL),
    jb AS (SELECT doc_id, b, kind, string_agg(line, ',' ORDER BY i) AS lines FROM jl JOIN bk USING (doc_id, b) GROUP BY ALL),
    jd AS (SELECT doc_id, string_agg(CASE WHEN kind <> 'header' THEN {block} END, ',' ORDER BY b) AS para, string_agg(CASE WHEN kind = 'header' THEN {block} END, ',' ORDER BY b) AS gone FROM jb GROUP BY doc_id)
    SELECT doc_id, '[' || {page} || ']' AS pages FROM jd"""


@query(
    "document_artefacts",
    f"""SELECT doc_id::VARCHAR AS stem, '.md' AS artefact, markdown AS payload FROM ({registry.sql("doc_markdown")})
    UNION ALL SELECT doc_id::VARCHAR, '_content_list.json', content_list FROM ({registry.sql("doc_content_list")})
    UNION ALL SELECT doc_id::VARCHAR, '_content_list_v2.json', content_list FROM ({registry.sql("doc_content_list_v2")})
    UNION ALL SELECT doc_id::VARCHAR, '_middle.json', '{{"pdf_info":' || pages || '}}' FROM ({_tree_sql(False)})""",
)
def document_artefacts(spark, sf_dir):
    return artifacts.artefacts(views.page_tree(spark, sf_dir).withColumn("stem", F.col("doc_id").cast("string")), "stem", "pdf_info")


@query(
    "document_response",
    f"""SELECT doc_id, '{{"md_content":' || to_json(markdown)::VARCHAR || ',"content_list":' || content_list || ',"images":{{}}}}' AS response
    FROM ({registry.sql("doc_markdown")}) JOIN ({registry.sql("doc_content_list")}) USING (doc_id)""",
)
def document_response(spark, sf_dir):
    return artifacts.response(views.page_tree(spark, sf_dir), "pdf_info").select("doc_id", "response")


@query("document_json_round_trip", f"""SELECT doc_id, '{{"pdf_info":' || pages || ',"unknown_key":' || doc_id || '}}' AS j, 1 AS n_pages FROM ({_tree_sql(True)})""")
def document_json_round_trip(spark, sf_dir):
    rows = views.page_tree(spark, sf_dir).select("doc_id", F.to_json(F.struct("pdf_info", F.col("doc_id").alias("unknown_key"))).alias("j"))
    parsed = files.parse_documents(rows, "j")
    return parsed.select("doc_id", files.dump_document(F.col("raw")).alias("j"), F.size("document.pdf_info").alias("n_pages"))


@query(
    "overlay_spans",
    f"SELECT page_id, det_pos, CASE WHEN det_pos % 5 = 0 THEN '158,158,158' WHEN label IN ('ocr_text', 'text') THEN '255,0,0' WHEN label IN ('image', 'chart') THEN '255,204,0' ELSE '204,0,255' END AS rgb FROM ({views.DETS_SQL}) WHERE label IN ('ocr_text', 'text', 'image', 'chart', 'table') OR (det_pos % 5 = 0)",
)
def overlay_spans(spark, sf_dir):
    kind = F.when(F.col("label") == "ocr_text", "text").otherwise(F.col("label"))
    rows = views.dets(spark, sf_dir).select("page_id", "det_pos", kind.alias("type"), (F.col("det_pos") % 5 == 0).alias("discarded"))
    return layout.span_overlay(rows).select("page_id", "det_pos", "rgb")


@query(
    "conversation_text",
    "SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id",
)
def conversation_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")).alias("x"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("text"), F.count("*").alias("turns"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from quire.streaming.documents import arrivals

    return arrivals(table(spark, sf_dir, "events"))
