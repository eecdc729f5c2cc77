"""Every catalogue query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from rangeflow.plans import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr) == expected


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_partition_counts_do_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([sorted(map(repr, catalog.QUERIES[q](spark, SF).collect())) for q in ("csr_build", "nnz_cuts", "stencil_steps", "consensus_full", "synthetic_csr")])
        assert seen[0] == seen[1] == seen[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_task_holds_the_matrix(spark, duck, monkeypatch):
    from rangeflow.sources import mtx

    monkeypatch.setattr(catalog, "TASK_ROWS", (500, 2000), raising=False)
    expected = duck.execute(f"SELECT count(*) FROM ({catalog.SQL['mtx_round_trip']})").fetchone()[0]
    seen, write = [], mtx.write_mtx

    def written(cells, rows, cols, path):
        write(cells, rows, cols, path)
        files = [f.removeprefix("file:") for f in cells.inputFiles()]
        seen.append([spark.read.parquet(f).count() for f in files])
        seen.append([r["count"] for r in spark.read.text(path).groupBy("_metadata.file_name").count().collect()])

    monkeypatch.setattr(mtx, "write_mtx", written)
    assert catalog.QUERIES["mtx_round_trip"](spark, SF).count() == expected
    summed, lines = seen
    assert sum(summed) == expected and max(summed) < 2 * 500
    assert sum(lines) == expected + 2 and len(lines) > 2
