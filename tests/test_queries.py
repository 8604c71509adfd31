"""Every query runs on the smallest tables and agrees with its SQL in DuckDB."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry_point

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in table), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, duck, name):
    out = entry_point.queries()[name](spark, str(DATA))
    got = rows(out.columns, [tuple(r) for r in out.collect()])
    sql = entry_point.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(out.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_hybrid_search_finds_documents_without_a_vector(spark, tmp_path):
    rows = [(k, "s", "plain words here" if k < 80 else "released under the MIT license") for k in range(90)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(k, [0.0, 1.0] if k == 7 else [1.0, 0.0]) for k in range(70)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = entry_point.queries()["hybrid_batch"](spark, str(tmp_path)).filter("qid = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in out[:11]] == [7, *range(80, 90)]
    assert all(r["keyword_score"] == 1 and r["vector_score"] == 0 for r in out[1:11])


def test_vector_search_of_a_table_in_blocks(spark, monkeypatch):
    from lanternfish.operators import vector

    run = lambda: sorted(tuple(r) for r in entry_point.queries()["cosine_every_100th_topk"](spark, str(DATA)).collect())
    whole = run()
    asked = spark.read.parquet(f"{DATA}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    assert len(whole) == 10 * asked and {r[0] % 100 for r in whole} == {0}
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 1)
    assert run() == whole
