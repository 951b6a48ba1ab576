from __future__ import annotations

import random

from lineout.llm.components import connected_components
from lineout.llm.near_dedup import near_duplicates
from tests.conftest import SF_SMALL
from tests.llm.helpers import ODD, components, docs_table, shingle_set


def _compare(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs_table(spark, rows)).collect()}
    sets = {d: shingle_set(t) for d, t in rows}
    want = components(sets)
    assert got == {d: (len(s), want[d], want[d] == d) for d, s in sets.items()}


def test_equals_all_pairs_on_chains_copies_and_shared_passages(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    rows = []

    def add(text_words):
        rows.append((len(rows) * 3 + 1, " ".join(text_words)))

    for size in (12, 60, 150, 700):  # chains in which each text edits the one before
        text = rng.choices(words, k=size)
        for _ in range(40):
            add(text)
            text = list(text)
            for _ in range(max(1, size // 60)):
                text[rng.randrange(size)] = rng.choice(words)
    for _ in range(60):  # mostly one passage
        add(passage + rng.choices(words, k=rng.randrange(5, 40)))
    for _ in range(40):  # exact copies, upper and lower case
        add([w.upper() if rng.random() < 0.5 else w for w in passage])
    for _ in range(60):
        add(rng.choices(words, k=rng.randrange(1, 300)))
    rng.shuffle(rows)
    _compare(spark, rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    _compare(spark, [tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    rows = near_duplicates(docs_table(spark, ODD)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert len(rows) == len(ODD)
    assert [got[i] for i in (1, 2, 3)] == [[(0, i, True)] for i in (1, 2, 3)] and got[4] == [(1, 4, True)]
    assert got[7] == [(2, 7, True)] and got[8] == [(2, 7, False)] * 2
    assert got[None] == [(2, None, True)]
    assert got[9][0][0] == 2 and got[10][0][0] == 1


def test_an_id_with_two_texts_joins_their_groups(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    got = {r.component_id for r in near_duplicates(docs_table(spark, [(1, a), (2, a), (2, b), (3, b)])).collect()}
    assert got == {1}


def test_empty_table(spark):
    assert near_duplicates(docs_table(spark, [])).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5)]
    edges = spark.createDataFrame(path, "a long, b long").unionByName(spark.createDataFrame(path[:9], "a long, b long"))
    got = dict(connected_components(edges).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(1000, 1200)}}


def test_nothing_is_crossed(spark):
    plan = near_duplicates(docs_table(spark, [(1, "a b c d e")]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
