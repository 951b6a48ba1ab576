"""Registered queries against their SQL, and the pipeline against its stages' own rules."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lineout.llm.common import clear_stored, stored
from lineout.llm.queries import all_queries, all_sql
from tests.conftest import SF_SMALL
from tests.llm.helpers import ODD, docs_table, shingle_set, components
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_SMALL)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, duck, name):
    assert differences(all_queries()[name](spark, SF_SMALL), duck, all_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_query_without_sql_covers_its_table(spark, name):
    rows = all_queries()[name](spark, SF_SMALL).count()
    assert rows > 0 if name == "op5_license_scan" else rows == 200


def test_everything_is_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in all_queries()}
    assert set(all_queries()) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL))
        counts.append(docs.count())
        if name == "near_dedup":
            sets = {r.doc_id: shingle_set(r.text) for r in docs.select("doc_id", "text").collect()}
            assert all(d == c for d, c in components(sets).items())
        if name != "mixing":
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, stage):
    docs = docs_table(spark, ODD)
    out = stored(stage(spark, docs, SF_SMALL))
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {d for d, _ in ODD}
    assert set(docs.columns) <= set(out.columns)
    assert stage(spark, docs.limit(0), SF_SMALL).count() == 0


def test_mixing_takes_each_row_by_itself(spark):
    words = lambda n: "word " * n
    rows = [(i, words(5 + i % 40), "en", f"s{i % 3}") for i in range(300)] + [(7, words(12), "en", "s1")] * 50
    rows += [(None, words(50), "en", "s0"), (None, words(50), "en", "s2"), (None, words(20), "en", None)] * 7
    docs = docs_table(spark, rows)
    out = stored(corpus_pipeline.mixing(spark, docs, SF_SMALL)).collect()
    size = {id(r): len(r.text.split()) for r in out}
    assert all(0 < r["taken"] <= 2 * size[id(r)] for r in out)
    assert sum(int(r["taken"]) for r in out) == sum(len(t.split()) for _, t, *_ in rows) * 3 // 2
    assert len({(r.source, r["target"]) for r in out}) == len({r.source for r in out})


def test_stored_tables_can_be_removed(spark):
    df = stored(spark.range(3))
    assert df.count() == 3
    clear_stored(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
