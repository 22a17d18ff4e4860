import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compare a query's rows with its SQL on a folder of Parquet tables."""
    import math

    import duckdb

    def plain(v):
        if isinstance(v, list | tuple):
            return tuple(plain(x) for x in v)
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
        return v

    def run(query, sql, folder):
        df = query(spark, str(folder))
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        mine = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
        theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in cur.fetchall())
        assert mine == theirs

    return run
