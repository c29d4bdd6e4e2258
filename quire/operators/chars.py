"""Embedded characters into spans: a range join by page, then spacing by character gaps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import is_blank
from quire.operators.ocr import filled_text
from quire.session import ship

#: Characters that may overhang a span's end or start.
STOPS = ".!?。！？)）\"”:：;；]】}>》、,，-—–"
STARTS = "(（\"“【{《<「『["
#: The same by code point; the last entry stands for all above.
_STOP, _OVERHANG = (np.isin(np.arange(1 << 16), [ord(x) for x in letters]) for letters in (STOPS, STOPS + STARTS))


def fill_spans(chars: DataFrame, spans: DataFrame, band: float = 16.0) -> DataFrame:
    """(page_id, span_pos, text): each character goes to the first span from the top that it lies in.

    Page and horizontal band are the join's keys: a character has the band of its centre, a span every
    band it reaches, so a long page costs no more pairs a character than a short one.
    """
    at = lambda y: F.floor(y / band)
    s = spans.select("page_id", "span_pos", *(F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1"))).where("s_y0 <= s_y1")
    # a span's place from the top and its position in one number, whose least is a plain hash aggregate
    rank = F.row_number().over(W.partitionBy("page_id").orderBy("s_y0", "span_pos")).cast("long")
    s = s.withColumn("place", F.shiftleft(rank, 32) + F.col("span_pos"))
    s = s.withColumn("band", F.explode(F.sequence(at(F.col("s_y0")), at(F.col("s_y1")))))
    chars = chars.withColumn("band", at((F.col("y0") + F.col("y1")) / 2))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    high = F.col("s_y1") - F.col("s_y0")
    level = (F.col("s_y0") < cy) & (cy < F.col("s_y1")) & (F.abs(cy - (F.col("s_y0") + F.col("s_y1")) / 2) < high * 0.33)
    centred = (F.col("s_x0") < cx) & (cx < F.col("s_x1"))
    stop = F.col("c").isin(*STOPS) & (F.col("s_x1") - high < F.col("x0")) & (F.col("x0") < F.col("s_x1")) & (cx > F.col("s_x0"))
    start = F.col("c").isin(*STARTS) & ~F.col("c").isin(*STOPS) & (F.col("s_x0") < F.col("x1")) & (F.col("x1") < F.col("s_x0") + high) & (cx < F.col("s_x1"))
    hit = chars.join(s, ["page_id", "band"]).where(level & (centred | stop | start))
    first = hit.groupBy("page_id", "band", "idx", "c", "x0", "x1").agg(F.min("place").alias("place"))
    return join_chars(first.withColumn("span_pos", F.col("place").bitwiseAND((1 << 32) - 1).cast(spans.schema["span_pos"].dataType)))


def first_spans(c: np.ndarray, box: np.ndarray, spans: np.ndarray, pos: np.ndarray, band: float) -> np.ndarray:
    """Of each character (code point, box [4, n]) of a page the place in ``spans`` [4, m] that ``fill_spans`` gives it, or -1."""
    order = np.lexsort((pos, spans[1]))
    order = order[spans[1][order] <= spans[3][order]]
    low, high_band = (np.floor(spans[k][order] / band).astype(np.int64) for k in (1, 3))
    n = high_band - low + 1
    held = np.repeat(order, n)  # a span in each band that it reaches, from the top
    bands = np.repeat(low, n) + np.arange(len(held)) - np.repeat(np.cumsum(n) - n, n)
    by_band = np.argsort(bands, kind="stable")
    held, bands = held[by_band], bands[by_band]
    x0, y0, x1, y1 = box
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    own = np.floor(cy / band).astype(np.int64)
    at, end = np.searchsorted(bands, own, "left"), np.searchsorted(bands, own, "right")
    code = np.minimum(c, len(_OVERHANG) - 1)
    overhang = _OVERHANG[code]
    s_x0, s_y0, s_x1, s_y1 = spans
    high, middle = s_y1 - s_y0, (s_y0 + s_y1) / 2
    reach = high * 0.33
    found, left = np.full(len(c), -1), np.flatnonzero(at < end)
    while len(left):
        k = held[at[left]]
        level = np.flatnonzero(np.abs(cy[left] - middle[k]) < reach[k])
        i, k = left[level], k[level]
        x, y = cx[i], cy[i]
        hit = (s_x0[k] < x) & (x < s_x1[k])
        odd = np.flatnonzero(overhang[i] & ~hit)
        if len(odd):
            j, m = i[odd], k[odd]
            stop = _STOP[code[j]]
            hit[odd] = np.where(stop, (s_x1[m] - high[m] < x0[j]) & (x0[j] < s_x1[m]) & (x[odd] > s_x0[m]), (s_x0[m] < x1[j]) & (x1[j] < s_x0[m] + high[m]) & (x[odd] < s_x1[m]))
        hit &= (s_y0[k] < y) & (y < s_y1[k])
        found[i[hit]] = k[hit]
        at[left] += 1
        left = left[(found[left] < 0) & (at[left] < end[left])]
    return found


def span_texts(c: np.ndarray, x0: np.ndarray, x1: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(span positions, sizes in bytes, UTF-8) of the texts that ``join_chars`` gives characters in order."""
    keep = (c != 10) & (c != 13)
    order = np.flatnonzero(keep)[np.argsort(pos[keep], kind="stable")]
    c, x0, x1, pos = c[order], x0[order], x1[order], pos[order]
    if not len(c):
        return pos, np.empty(0, np.int64), b""
    first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    size = np.diff(np.concatenate([first, [len(c)]]))
    widths = x1 - x0
    wide = np.repeat(widths[np.lexsort((widths, pos))][first + size // 2] * 0.25, size)
    gap = np.zeros(len(c), bool)
    gap[:-1] = (pos[1:] == pos[:-1]) & (x0[1:] - x1[:-1] > wide[:-1]) & (c[:-1] != 32) & (c[1:] != 32)
    ahead = np.cumsum(gap) - gap
    out = np.full(len(c) + int(gap.sum()), 32, "<u4")
    out[np.arange(len(c)) + ahead] = c
    length = 1 + (out > 0x7F) + (out > 0x7FF).astype(np.int64) + (out > 0xFFFF)
    return pos[first], np.add.reduceat(length, first + ahead[first]), out.tobytes().decode("utf-32-le").encode()


def fill_pages(pages: DataFrame, column: str, layout: Callable, band: float = 16.0) -> DataFrame:
    """``fill_spans`` of pages that hold their characters in one row, without a shuffle.

    ``layout`` gives (code points in order, boxes [4, n], span positions, span boxes [4, m]) of the
    value of ``column``.  ``page_id`` must be neither null nor repeated.
    """
    ship(pages.sparkSession)
    out = pa.schema([("page_id", pa.int64()), ("span_pos", pa.int32()), ("text", pa.string())])

    def run(batches):
        for batch in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
            ids, positions, sizes, texts = [], [], [np.zeros(1, np.int64)], []
            for page, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                c, box, pos, spans = layout(value.as_py())
                k = first_spans(c, box, spans, pos, band)
                hit = k >= 0
                where, size, data = span_texts(c[hit], box[0][hit], box[2][hit], pos[k[hit]])
                ids.append(np.full(len(where), page, np.int64))
                positions.append(where.astype(np.int32))
                sizes.append(size)
                texts.append(data)
            if ids:
                ends = np.cumsum(np.concatenate(sizes))
                text = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(texts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(positions)), text.cast(pa.string())], schema=out)

    return pages.select("page_id", column).mapInArrow(run, "page_id long, span_pos int, text string")


def fill_text(chars: DataFrame, spans: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(page_id, span_pos, text, score): embedded characters first, recognised text where they leave a span blank.

    A page without characters is a scan, whose spans are all recognised.  ``recognise`` gives (page_id,
    span_pos, text, score) of the spans it gets; text up to a score of 0.5 counts as "".
    """
    own = spans.select("page_id", "span_pos", "x0", "y0", "x1", "y1")
    filled = own.join(fill_spans(chars, spans), ["page_id", "span_pos"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    done = filled.where(~is_blank(F.col("text"))).select("page_id", "span_pos", "text", F.lit(1.0).alias("score"))
    left = filled.where(is_blank(F.col("text"))).drop("text")
    if recognise is None:
        return done.unionByName(left.select("page_id", "span_pos", F.lit("").alias("text"), F.lit(0.0).alias("score")))
    text, score = filled_text(F.col("text"), F.col("score"))
    return done.unionByName(recognise(left).select("page_id", "span_pos", text.alias("text"), score.alias("score")))


def join_chars(rows: DataFrame) -> DataFrame:
    """Characters of a span in order; a space where a gap exceeds a quarter of the upper median width."""
    spans = rows.where("c NOT IN ('\\n', '\\r')").groupBy("page_id", "span_pos").agg(F.array_sort(F.collect_list(F.struct("idx", "c", "x0", "x1"))).alias("cs"))
    widths = F.array_sort(F.transform("cs", lambda x: x["x1"] - x["x0"]))
    spans = spans.withColumn("wide", F.get(widths, F.floor(F.size(widths) / 2).cast("int")) * 0.25)

    def piece(x, i):
        ahead = F.get("cs", i + 1)
        gap = (ahead["x0"] - x["x1"] > F.col("wide")) & (x["c"] != " ") & (ahead["c"] != " ")
        return F.when(gap, F.concat(x["c"], F.lit(" "))).otherwise(x["c"])

    return spans.select("page_id", "span_pos", F.array_join(F.transform("cs", piece), "").alias("text"))


def code_points(cp: list[int]) -> str:
    """Code points as text: surrogate pairs joined, 0 dropped, lone or impossible ones as U+FFFD."""
    out, i = [], 0
    while i < len(cp):
        c = cp[i]
        if 0xD800 <= c < 0xDC00 and i + 1 < len(cp) and 0xDC00 <= cp[i + 1] < 0xE000:
            c, i = 0x10000 + ((c - 0xD800) << 10) + (cp[i + 1] - 0xDC00), i + 1
        if c:
            out.append(chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else "�")
        i += 1
    return "".join(out)
