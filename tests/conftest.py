import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from quire.session import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture()
def compare(spark):
    """Runs a registered query and its SQL over the smallest tables and compares their rows."""
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"

    def text(v):
        if isinstance(v, float):
            return repr(round(v, 6))
        return str(v)

    def run(name):
        got = entry.queries()[name](spark, folder)
        con = duckdb.connect()
        for f in Path(folder).glob("*.parquet"):
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        cur = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(got.columns)
        order = sorted(names)
        want = sorted(tuple(text(dict(zip(names, r, strict=True))[c]) for c in order) for r in cur.fetchall())
        have = sorted(tuple(text(r.asDict(recursive=True)[c]) for c in order) for r in got.collect())
        assert have == want

    return run
