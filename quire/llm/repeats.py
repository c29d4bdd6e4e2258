"""Which of many hashed positions hold a key that occurs more than once?

Keys are hashed per chunk of bounded size in the map task.  A key found twice in a
chunk is known to repeat: its positions are marked there and one entry stands for
them in the shuffle, so a key that a third of all documents hold costs one entry
a chunk instead of one a document.  A chunk sends one packed row to each bucket;
a bucket is looked through as a whole by the task that gets it, and the number of
buckets follows ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.words import mix

DDL = "bucket int, n int, keys binary, docs binary, positions binary"
_ROWS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("positions", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("positions", pa.binary())])
CHUNK = 1 << 20


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array with equal places together, which block compression likes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _values(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind).reshape(-1) if n else np.empty(0, kind)


def _row(bucket: int, keys: np.ndarray, docs: np.ndarray, positions: np.ndarray) -> tuple:
    """Entries in document order, documents as differences; keys [n, bytes]."""
    order = np.lexsort((positions, docs))
    docs = docs[order]
    return bucket, len(docs), keys[order].tobytes(), _planes(np.diff(docs, prepend=0)), _planes(positions[order].astype(np.int32))


def _flush(parts: list[tuple], buckets: int, width: int) -> pa.RecordBatch:
    k = np.concatenate([p[1] for p in parts])
    k2 = np.concatenate([p[2] for p in parts])
    doc = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
    pos = np.concatenate([p[3] for p in parts]).astype(np.int32)
    order = np.lexsort((k2, k))
    k, k2, doc, pos = k[order], k2[order], doc[order], pos[order]
    same = (k[1:] == k[:-1]) & (k2[1:] == k2[:-1])
    again = np.zeros(len(k), bool)
    again[1:] |= same
    again[:-1] |= same
    head = again & ~np.concatenate([[False], same])  # the first of a run stands for it, without a place
    sent = ~again | head
    where = np.where(head, -1, pos)[sent]
    keys = np.concatenate([k[sent].view(np.uint8).reshape(-1, 8), k2[sent].view(np.uint8).reshape(-1, 8)], axis=1)[:, :width]
    bucket = (k[sent] >> np.uint64(40)) % np.uint64(buckets)
    owner = doc[sent]
    rows = []
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b, lo, hi in zip(range(buckets), cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            at = order[lo:hi]
            rows.append(_row(b, keys[at], owner[at], where[at]))
    known_bucket = mix(doc[again].view(np.uint64)) % np.uint64(buckets)
    order = np.argsort(known_bucket, kind="stable")
    cuts = np.searchsorted(known_bucket[order], np.arange(buckets + 1))
    for b, lo, hi in zip(range(buckets), cuts[:-1], cuts[1:], strict=True):
        if lo < hi:  # known to repeat: no keys
            at = np.flatnonzero(again)[order[lo:hi]]
            rows.append(_row(b, np.empty((hi - lo, 0), np.uint8), doc[at], pos[at]))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def _hashed(rows: Callable, buckets: int, width: int) -> Callable:
    def run(batches) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for part in rows(batch):
                if len(part[1]):
                    parts.append(part)
                    n += len(part[1])
                if n >= CHUNK:
                    yield _flush(parts, buckets, width)
                    parts, n = [], 0
        if parts:
            yield _flush(parts, buckets, width)

    return run


def _runs(width: int, buckets: int) -> Callable:
    """All rows of a task's buckets to packed entries that repeat, one row for each bucket of documents."""

    def run(batches):
        keys, docs, positions, known = [], [], [], []
        for b in batches:
            for n, k, d, p in zip(*(b.column(c) for c in ("n", "keys", "docs", "positions")), strict=True):
                n = n.as_py()
                own, at = np.cumsum(_values(d.as_py(), n, np.int64)), _values(p.as_py(), n, np.int32)
                if k.as_py():
                    keys.append(np.frombuffer(k.as_py(), np.uint8).reshape(n, width))
                    docs.append(own)
                    positions.append(at)
                else:
                    known.append((own, at))
        if keys:
            wide = np.zeros((sum(map(len, keys)), 16), np.uint8)
            wide[:, :width] = np.concatenate(keys)
            keys.clear()
            k = wide.view(np.uint64)
            order = np.lexsort((k[:, 1], k[:, 0])) if width > 8 else np.argsort(k[:, 0], kind="stable")
            k = k[order]
            same = (k[1:] == k[:-1]).all(axis=1)
            hit = np.zeros(len(k), bool)
            hit[1:] |= same
            hit[:-1] |= same
            at = order[hit]
            own, where = np.concatenate(docs)[at], np.concatenate(positions)[at]
            known.append((own[where >= 0], where[where >= 0]))
        if known:
            own, where = (np.concatenate(x) for x in zip(*known, strict=True))
            to = mix(own.view(np.uint64)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            none = np.empty((len(own), 0), np.uint8)
            rows = [_row(b, none[:hi - lo], own[order[lo:hi]], where[order[lo:hi]]) for b, lo, hi in zip(range(buckets), cuts[:-1], cuts[1:], strict=True) if lo < hi]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return run


def _by_doc(batches):
    """Packed entries to one row a document; a task has all entries of its documents."""
    parts = [
        (np.cumsum(_values(d.as_py(), n.as_py(), np.int64)), _values(p.as_py(), n.as_py(), np.int32)) for b in batches for n, d, p in zip(*(b.column(c) for c in ("n", "docs", "positions")), strict=True)
    ]
    if parts:
        docs, positions = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(docs, kind="stable")
        docs, positions = docs[order], positions[order]
        cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]]))
        yield pa.RecordBatch.from_pydict({"doc_id": docs[cut[:-1]], "positions": [positions[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]}, schema=_FOUND)


def repeated(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[tuple]], parts: int, width: int) -> DataFrame:
    """(doc_id, positions) of the positions whose key occurs elsewhere too, one row a document.

    ``rows`` yields (doc_id, keys, second keys, positions) of each row of a batch;
    the first ``width`` bytes of both keys are compared.
    """
    packed = df.mapInArrow(_hashed(rows, parts, width), DDL)
    found = packed.repartitionById(parts, "bucket").mapInArrow(_runs(width, parts), DDL)
    return found.repartitionById(parts, "bucket").mapInArrow(_by_doc, "doc_id long, positions binary")
