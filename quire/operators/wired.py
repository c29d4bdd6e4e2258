"""Ruled tables from cell rectangles: reading order, grid recovery, cell texts and HTML.

The column list grows as cells are seen, so a table is one Arrow group; pages with
tables are small, and grouping is by (page, table).
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tolerances in pixels.
ROW_GAP, COLUMN_GAP, MERGE_GAP = 10, 15, 10


def cell_order(boxes: np.ndarray) -> list[int]:
    """Cells by (top, left); a cell moves left past others of its row, judged pair by pair."""
    at = sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0]))

    def one_row(a, b) -> bool:
        high = [x[3] - x[1] for x in (a, b)]
        both = min(a[3], b[3]) - max(a[1], b[1])
        return any(h > 0 and (h - both) / h < 0.2 for h in high) and abs(a[1] - b[1]) < 20

    for i in range(len(at) - 1):
        j = i
        while j >= 0 and boxes[at[j + 1]][0] < boxes[at[j]][0] and one_row(boxes[at[j]], boxes[at[j + 1]]):
            at[j], at[j + 1] = at[j + 1], at[j]
            j -= 1
    return at


def _span(sizes: list[float], start: int, extent: float) -> int:
    """How many of ``sizes`` from ``start`` on a cell of ``extent`` covers."""
    total = 0.0
    for k, size in enumerate(sizes[start:], 1):
        total += size
        if k == 1 and total > extent:
            return 1
        if abs(total - extent) <= MERGE_GAP:
            return k
        if total > extent:
            return k if abs(total - extent) < abs(total - size - extent) else k - 1
    return len(sizes) - start


def recover_grid(boxes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first row, last row, first column, last column) of each cell, cells being in ``cell_order``."""
    if not len(boxes):
        return []
    jumps = np.flatnonzero(np.abs(np.diff(boxes[:, 1])) > ROW_GAP) + 1
    rows = np.split(np.arange(len(boxes)), jumps)
    longest = max(rows, key=len)
    edges = [float(x) for x in boxes[longest, 0]]
    low, high = edges[0], float(boxes[longest[-1], 2])

    def note(x: float, may_end: bool) -> None:
        """A new column edge, unless it is near the first one or, within the table, near any."""
        nonlocal low, high
        if abs(edges[0] - x) <= COLUMN_GAP:
            return
        if x < low:
            edges.insert(0, x)
            low = x
        elif x > high:
            if may_end:
                edges.append(x)
            high = x
        else:
            at = bisect_left(edges, x - COLUMN_GAP)
            if at < len(edges) and edges[at] > x + COLUMN_GAP:
                edges.insert(at, x)

    for row in rows:
        for i in row:
            note(float(boxes[i, 0]), True)
            note(float(boxes[i, 2]), False)
    widths = [*np.diff(edges).tolist(), high - edges[-1]]
    tops = [float(boxes[r[0], 1]) for r in rows]
    heights = [*np.diff(tops).tolist(), float(max(boxes[i, 3] - boxes[i, 1] for i in rows[-1]))]
    grid = []
    for y, row in enumerate(rows):
        taken = 0
        for i in row:
            x = max(taken, min(range(len(edges)), key=lambda k, i=i: abs(edges[k] - boxes[i, 0])))
            across = _span(widths, x, float(boxes[i, 2] - boxes[i, 0]))
            down = _span(heights, y, float(boxes[i, 3] - boxes[i, 1]))
            taken += across
            grid.append((y, y + down - 1, x, x + across - 1))
    return grid


def cell_text(items: list[tuple[float, float, float, float, str]]) -> str:
    """Texts of a cell from top to bottom, all on one line, a space for each ten pixels of gap."""
    out, right = "", None
    for x0, _, x1, _, text in sorted(items, key=lambda i: (i[1], i[0])):
        if right is not None:
            out += " " * int(max(x0 - right, 0.0) / 10)
        out += text
        right = x1 if right is None else max(right, x1)
    return out


def grid_html(boxes: np.ndarray, grid: list[tuple[int, int, int, int]], texts: list[str]) -> str:
    """The grid as HTML; outer rows and columns without text that are broken or of odd size are cut off."""
    if not grid:
        return "<html><body><table></table></body></html>"
    logic = np.array(grid)
    shape = logic[:, 1].max() + 1, logic[:, 3].max() + 1
    owner = np.full(shape, -1)
    for i, (a, b, c, d) in enumerate(grid):
        owner[a : b + 1, c : d + 1] = i
    full = np.array([bool(t.strip(" \t\r\n")) for t in texts])

    def sizes(axis: int) -> np.ndarray:
        lo, hi, near, far = (0, 1, 1, 3) if axis == 0 else (2, 3, 0, 2)
        each = (boxes[:, far] - boxes[:, near]) / (logic[:, hi] - logic[:, lo] + 1)
        found = [[e for e, g in zip(each, logic, strict=True) if g[lo] <= k <= g[hi] and e > 0] for k in range(shape[axis])]
        return np.array([np.median(f) if f else -1.0 for f in found])

    size = [sizes(0), sizes(1)]
    window = [[0, shape[0] - 1], [0, shape[1] - 1]]

    def noise(axis: int, k: int) -> bool:
        lo, hi = window[1 - axis]
        line = owner[k, lo : hi + 1] if axis == 0 else owner[lo : hi + 1, k]
        held = line[line >= 0]
        if full[held].any():
            return False
        if len(held) < len(line):
            return True
        others = np.delete(size[axis], k)
        others = others[others > 0]
        if size[axis][k] <= 0 or not len(others):
            return False
        ratio = size[axis][k] / np.median(others)
        return ratio < 0.35 or ratio > 2.5

    for axis in (0, 1):
        w = window[axis]
        while w[0] <= w[1] and noise(axis, w[0]):
            w[0] += 1
        while w[1] >= w[0] and noise(axis, w[1]):
            w[1] -= 1
    (r0, r1), (c0, c1) = window
    out = []
    if c0 <= c1:
        for y in range(r0, r1 + 1):
            out.append("<tr>")
            for x in range(c0, c1 + 1):
                i = owner[y, x]
                if i < 0:
                    out.append("<td></td>")
                    continue
                a, b, c, d = grid[i]
                if (y, x) == (max(a, r0), max(c, c0)):
                    out.append(f"<td rowspan={min(b, r1) - y + 1} colspan={min(d, c1) - x + 1}>{texts[i]}</td>")
            out.append("</tr>")
    return "<html><body><table>" + "".join(out) + "</table></body></html>"


def table_html(cells: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html) of cells (cell, x0..y1) and texts matched to them (cell, x0..y1, text)."""
    own = lambda rows, *more: rows.select(  # noqa: E731  new names, as both may stem from one table
        *(F.col(k).alias(k) for k in (*keys, "cell")), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), *more
    )
    texts, boxes = own(matched, "text"), own(cells)

    def one(key, own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        b = own[["x0", "y0", "x1", "y1"]].to_numpy()
        at = cell_order(b)
        by = {c: list(g[["x0", "y0", "x1", "y1", "text"]].itertuples(index=False, name=None)) for c, g in said.groupby("cell")}
        shown = [cell_text(by.get(own["cell"].iloc[i], [])) for i in at]
        return pd.DataFrame([[*key, grid_html(b[at], recover_grid(b[at]), shown)]], columns=[*keys, "html"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in keys) + ", html string"
    return boxes.groupBy(*keys).cogroup(texts.groupBy(*keys)).applyInPandas(one, schema)
