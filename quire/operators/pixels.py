"""Pixel operations of model pre- and post-processing as numpy functions for Arrow batches."""

from __future__ import annotations

import numpy as np


def crop(image: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of an image under a box, edges floored and ceiled and held to the image."""
    h, w = image.shape[:2]
    x0, y0 = max(0, int(np.floor(box[0]))), max(0, int(np.floor(box[1])))
    x1, y1 = min(w, int(np.ceil(box[2]))), min(h, int(np.ceil(box[3])))
    return image[y0 : max(y0, y1), x0 : max(x0, x1)]


def turn_tall(image: np.ndarray, ratio: float = 1.5) -> np.ndarray:
    """Images at least ``ratio`` times as high as wide, turned a quarter to the left."""
    h, w = image.shape[:2]
    return np.rot90(image) if w and h / w >= ratio else image


def quad_crop(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The image under a quad (tl, tr, br, bl), sampled bilinearly; upright quads are cut out directly."""
    quad = np.asarray(quad, np.float64)
    side = lambda a, b: float(np.hypot(*(quad[a] - quad[b])))
    w, h = max(1, int(max(side(0, 1), side(3, 2)))), max(1, int(max(side(0, 3), side(1, 2))))
    upright = abs(quad[0, 1] - quad[1, 1]) < 1e-6 and abs(quad[0, 0] - quad[3, 0]) < 1e-6 and abs(quad[2] - [quad[1, 0], quad[3, 1]]).max() < 1e-6
    if upright:
        return turn_tall(crop(image, (*quad[0], *quad[2])))
    u, v = np.meshgrid((np.arange(w) + 0.5) / w, (np.arange(h) + 0.5) / h)
    at = ((1 - u) * (1 - v))[..., None] * quad[0] + (u * (1 - v))[..., None] * quad[1] + (u * v)[..., None] * quad[2] + ((1 - u) * v)[..., None] * quad[3] - 0.5
    x, y = np.clip(at[..., 0], 0, image.shape[1] - 1), np.clip(at[..., 1], 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    src = image.astype(np.float64).reshape(*image.shape[:2], -1)
    out = src[y0, x0] * (1 - fx) * (1 - fy) + src[y0, x1] * fx * (1 - fy) + src[y1, x0] * (1 - fx) * fy + src[y1, x1] * fx * fy
    return turn_tall(np.rint(out).astype(image.dtype).reshape(h, w, *image.shape[2:]))


def regions(mask: np.ndarray) -> list[np.ndarray]:
    """Pixel coordinates (x, y) of the 8-connected parts of a mask, by joining runs of rows."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(runs)
            runs.append((y, a, b))
            parent.append(k)
            here.append(k)
            for j in above:
                if runs[j][1] <= b and a <= runs[j][2]:
                    i, j = sorted((find(k), find(j)))
                    parent[j] = i
        above = here
    parts: dict[int, list[np.ndarray]] = {}
    for k, (y, a, b) in enumerate(runs):
        parts.setdefault(find(k), []).append(np.stack([np.arange(a, b), np.full(b - a, y)], axis=1))
    return [np.concatenate(p) for p in parts.values()]


def text_boxes(prob: np.ndarray, width: int, height: int, level: float = 0.3, least_score: float = 0.6, unclip: float = 1.5, least_side: int = 3) -> list[tuple[list[int], float]]:
    """Upright boxes of a text probability map, grown by area * unclip / perimeter, scaled to the page.

    Parts are boxed along the axes; a rotated box needs the image library of a model runner.
    """
    sy, sx = height / prob.shape[0], width / prob.shape[1]
    out = []
    for part in regions(prob > level):
        (x0, y0), (x1, y1) = part.min(0), part.max(0) + 1
        score = float(prob[part[:, 1], part[:, 0]].mean())
        if min(x1 - x0, y1 - y0) < least_side or score < least_score:
            continue
        grow = (x1 - x0) * (y1 - y0) * unclip / (2 * (x1 - x0 + y1 - y0))
        if min(x1 - x0, y1 - y0) + 2 * grow < least_side + 2:
            continue
        box = [(x0 - grow) * sx, (y0 - grow) * sy, (x1 + grow) * sx, (y1 + grow) * sy]
        out.append(([int(np.clip(round(v), 0, m)) for v, m in zip(box, (width, height, width, height), strict=True)], score))
    return out


def normalise(image: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    """Channels first, scaled to (x / 255 - mean) / std."""
    return ((image.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def patches(image: np.ndarray, patch: int = 14, merge: int = 2) -> tuple[np.ndarray, tuple[int, int]]:
    """Patch matrix of a (3, h, w) image: squares of ``merge`` x ``merge`` patches in turn, each twice in time."""
    _, h, w = image.shape
    gh, gw = h // patch, w // patch
    x = np.stack([image, image]).reshape(2, 3, gh // merge, merge, patch, gw // merge, merge, patch)
    return x.transpose(2, 5, 3, 6, 1, 0, 4, 7).reshape(gh * gw, -1), (gh, gw)
