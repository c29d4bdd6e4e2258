"""Memory of a worker between its tasks."""

import ctypes
from pathlib import Path

import pyarrow as pa
import pytest
from quire.llm import bpe_words, line_dedup
from quire.llm.batches import BYTES, batch_bytes, give_back


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


@pytest.mark.skipif(not Path("/proc/self/statm").exists() or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs Linux and glibc")
def test_freed_memory_goes_back():
    held = [bytes(2000 + i % 7) for i in range(100_000)]
    last = held[-1]  # keeps the heap's end in place
    del held
    before = resident()
    give_back()
    assert last and before - resident() > 100 << 20


def test_batches_of_wide_rows_are_small_and_the_setting_comes_back(spark):
    before = spark.conf.get(BYTES, None)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    wide = spark.range(0, 40, numPartitions=1).selectExpr("id", "repeat('x', 1 << 20) AS t").mapInArrow(sizes, "n long")
    with batch_bytes(spark):
        found = [r.n for r in wide.select("n").collect()]
    assert sum(found) == 40 and max(found) <= 4
    assert spark.conf.get(BYTES, None) == before


def test_op8_asks_for_small_batches_of_blocks(spark, monkeypatch):
    seen = []
    real = bpe_words.bpe
    monkeypatch.setattr(bpe_words, "bpe", lambda *a, **b: seen.append(int(spark.conf.get(BYTES, "0"))) or real(*a, **b))
    bpe_words.query(spark, "/root/testdata/sf0.001").count()
    assert 0 < seen[0] <= 8 << 20


def test_decoded_words_are_cut_without_an_object_for_each():
    for words in ([b"a"], [b""], [b"", b"", b"x"], [b"caf\xc3\xa9", b"", b"b"], [b"x", b""]):
        assert bpe_words._cut_lines(b"\n".join(words)).to_pylist() == words


def test_no_row_of_a_block_holds_it_all(monkeypatch):
    monkeypatch.setattr(bpe_words.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(20_000)), "text": [" ".join(f"w{i * 7 + k}" for k in range(40)) for i in range(20_000)]})
    rows = [b.slice(i, 1).nbytes for b in bpe_words._blocks(64, 32 << 20)(iter([texts])) for i in range(b.num_rows)]
    assert max(rows) < sum(rows) / 5


def test_line_dedup_asks_for_small_batches(spark, monkeypatch):
    seen = []
    real = line_dedup.line_links
    monkeypatch.setattr(line_dedup, "line_links", lambda *a, **b: seen.append(int(spark.conf.get(BYTES, "0"))) or real(*a, **b))
    line_dedup.query(spark, "/root/testdata/sf0.001").count()
    assert 0 < seen[0] <= 8 << 20 and spark.conf.get(BYTES, None) is None
