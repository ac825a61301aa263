"""Registration, SQL oracles and the pipeline."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidelake.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are absent")


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_returns_a_row_for_each_input(spark, name):
    out = QUERIES[name](spark, DATA)
    table, key = {"op2": ("pages", "page_id"), "op11": ("conversations", "conv_id"), "op13": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    n = spark.read.parquet(f"{DATA}/{table}.parquet").select(key).distinct().count()
    assert out.count() == n or name.startswith("op4_") or name.startswith("op11_") and out.count() > n


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    mine = QUERIES[name](spark, DATA)
    columns = sorted(mine.columns)
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    a = sorted((tuple(map(clean, (r[c] for c in columns))) for r in mine.collect()), key=str)
    b = sorted(con.sql(f"select {', '.join(columns)} from ({ORACLES[name]}) o").fetchall(), key=str)
    assert a == b


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert all(b <= a for a, b in zip(counts, counts[1:])) and counts[-1] > 0
    last = corpus_pipeline.run(spark, DATA)
    assert last.columns == [*columns, "shard", "slot"] and last.count() == counts[-1]
    assert last.groupBy("shard").count().agg({"count": "max"}).first()[0] == -(-counts[-1] // 8)


EDGE = "doc_id long, text string, lang string, source string, n_chars long, shard string, dropped_id string, row_key string, quality string"


@pytest.mark.parametrize("values", [[], [None, None, "", " \n", "word", "short text of a few words", "short text of a few words", "long words " * 60_000]])
def test_stages_take_any_rows(spark, values):
    """Empty tables, null texts and ids, repeated rows, a very long text, and columns whose names the stages use themselves."""
    rows = [(None if k % 4 == 1 else k % 6, v, None if k % 2 else "en", None if k % 3 else "src1", None, "mine", "mine", "mine", "mine") for k, v in enumerate(values)]
    docs = spark.createDataFrame(rows, EDGE)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        got = sorted(map(str, out.select(*docs.columns).collect()))
        have = sorted(map(str, docs.collect()))
        assert all(got.count(x) <= have.count(x) for x in set(got)), name
        if name == "sharding":
            assert out.columns == [*docs.columns, "_shard", "slot"] and got == have
        elif name == "benchmark_decontamination":
            assert got == have
        elif name == "simhash_near_dedup":
            assert sum("doc_id=None" in x for x in got) == sum("doc_id=None" in x for x in have)
