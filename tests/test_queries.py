"""Every registered query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), tables.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_queries_remain_if_a_package_of_the_others_is_missing():
    code = "import sys, warnings; sys.modules['zstandard'] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(len(e.queries()), 'q27_eval_hybrid' in e.queries(), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
    assert said.stdout.split() == [str(sum(q.startswith("q") for q in entry.queries())), "True", "False"]


def test_entry(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() == 1


def test_attribution_cites_the_last_of_many_turns(spark, tmp_path):
    said = "The harbour bridge opened to traffic in the spring of that year"
    turns = [(1, k, "user", f"filler number {k} about nothing much") for k in range(7)] + [(1, 7, "user", said), (1, 8, "assistant", f"{said}.")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = entry.queries()["q40_attribution"](spark, str(tmp_path)).collect()
    assert row.cited == f"{said} [8]."


def test_attribution_equals_its_sql_where_a_far_turn_is_hardly_more_similar(spark, tmp_path):
    said = "The harbour bridge opened to traffic in the spring of that year"
    near = " ".join([said] * 60) + " rivets"
    turns = [(1, 0, "user", near)] + [(1, k, "user", f"filler number {k} about nothing much") for k in range(1, 30)] + [(1, 30, "user", said), (1, 31, "assistant", f"{said} now")]
    turns += [(2, 0, "user", near), (2, 1, "user", said), (2, 2, "assistant", f"{said} now"), (3, 0, "user", near), (3, 1, "user", said), (3, 2, "assistant", said)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.answer_id: r.cited for r in entry.queries()["q40_attribution"](spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = {i: cited for i, _, cited in connection.sql(entry.oracle_sql()["q40_attribution"]).fetchall()}
    assert got == want
    assert (got[1031][-3:], got[3002][-3:]) == ("[1]", "[2]")
