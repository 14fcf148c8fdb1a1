"""Queries against the SQL of another engine, on the small tables."""

import json
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from sievework import queries

CHECKED = sorted(queries.ORACLES)
OTHERS = ["full_scan", "json_report", "sarif_report"]


@pytest.fixture(scope="module")
def other(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(str)
    return list(df.columns), sorted(map(tuple, df.itertuples(index=False)))


@pytest.mark.parametrize("name", CHECKED)
def test_equal(spark, sf, other, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(other.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", OTHERS)
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).collect()


def test_entry(spark, sf):
    out = entry.entry(spark)
    assert out.count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entropy_of_whole_texts(spark, tmp_path):
    texts = ["a" * 60 + "bcdefghijklmnop" * 9, "a" * 60, "ab" * 5000 + "é𝒳\n", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def entropy(t):
        return round(-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) + 0.0, 6)

    assert {r.doc_id: r.entropy for r in queries.entropies(spark, str(tmp_path)).collect()} == {k: entropy(t or "") for k, t in enumerate(texts)}


def test_reports_hold_the_full_scan(spark, sf):
    whole = {r.repo_id: r for r in queries.full_scan(spark, sf).collect()}
    for r in queries.json_report(spark, sf).collect():
        body, want = json.loads(r.report), whole[r.repo_id]
        assert (body["score"], body["grade"], body["verified_count"], len(body["findings"])) == (want.score, want.grade, want.verified_count, want.verified_count)
    told = {r.repo_id: len(json.loads(r.sarif)["runs"][0]["results"]) for r in queries.sarif_report(spark, sf).collect()}
    assert told == {k: r.verified_count for k, r in whole.items() if r.verified_count}
