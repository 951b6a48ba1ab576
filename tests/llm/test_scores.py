"""Toxicity, quality and language-model scores on planted texts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lineout.llm import lm_scores, toxicity, words
from lineout.llm.common import map_arrow
from lineout.llm.lm_scores import score_documents
from lineout.llm.resampling import select_quality
from lineout.llm.toxicity import drop_toxic, score_toxicity
from tests.llm.helpers import LOWER, ODD, WORD, docs_table, labels_table


@pytest.fixture(scope="module")
def planted(spark):
    """900 texts: toxic ones hold one of three words, poor ones shout; two thirds are labelled."""
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in "bdfgklmn" for b in ("ar", "el", "in", "os", "ut", "am")]
    rows, labels, truth = [], [], {}
    for i in range(900):
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.8)
        words = rng.choices(plain, k=rng.randrange(30, 200))
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilefool", "cretinous", "filthbag"]))
        text = " ".join(words if good else [w.upper() + "!!" for w in words])
        rows.append((i, text, rng.choice(["en", None]), "src"))
        truth[i] = (good, toxic)
        if rng.random() < 0.67:
            labels.append((i, good, toxic))
    return docs_table(spark, rows), labels_table(spark, labels), truth


def test_toxicity_on_held_out_documents(planted):
    docs, labels, truth = planted
    rows = score_toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id][1] for r in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted} and drop_toxic(docs, labels).columns == docs.columns


def test_quality_keeps_the_labelled_share_and_drops_shouting(planted):
    docs, labels, truth = planted
    rows = select_quality(docs, labels).collect()
    good = sum(truth[r.doc_id][0] for r in rows if r.kept)
    assert len(rows) == 900 and abs(sum(r.kept for r in rows) - sum(g for g, _ in truth.values())) <= 40
    assert good >= 0.97 * sum(r.kept for r in rows)
    again = {r.doc_id: r.kept for r in select_quality(docs.repartition(3), labels).collect()}
    assert again == {r.doc_id: r.kept for r in rows}


def test_top_k_is_exactly_the_share(planted):
    docs, labels, _ = planted
    rows = select_quality(docs, labels, share=0.3).collect()
    kept = [r.key for r in rows if r.kept]
    assert len(kept) == 270 and min(kept) >= max(r.key for r in rows if not r.kept)


def test_loss_difference_ranks_the_target_lower(planted):
    docs, labels, truth = planted
    rows = score_documents(docs, labels).collect()
    good = [r.loss_difference for r in rows if truth[r.doc_id][0]]
    poor = [r.loss_difference for r in rows if not truth[r.doc_id][0]]
    assert max(good) < min(poor)
    assert all(abs(r.loss_difference - (r.target_loss - r.background_loss)) < 1e-9 and r.background_loss > 0 for r in rows)


@pytest.mark.parametrize("operator", [score_toxicity, select_quality, score_documents])
def test_odd_rows_labels_and_empty_tables(spark, operator):
    docs = docs_table(spark, ODD)
    for labels in ([], [(None, 1, 1), (7, None, None)], [(7, 1, 1), (8, 0, 0), (8, 0, 0), (999, 1, 0)]):
        rows = operator(docs, labels_table(spark, labels)).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ODD)
        assert all(v is not None for r in rows for k, v in r.asDict().items() if k != "doc_id")
    assert operator(docs_table(spark, []), labels_table(spark)).collect() == []


def exact_losses(docs, good):
    """[(id, words, target loss, background loss)] of bigram models over whole words, in plain Python."""
    texts = [(d, WORD.findall((text or "").translate(LOWER))) for d, text in docs]
    vocabulary = {w for _, found in texts for w in found}
    models = []
    for wanted in (lambda d: d in good, lambda d: True):
        used = [found for d, found in texts if wanted(d)]
        pairs = Counter(p for found in used for p in zip([None, *found], found))
        single, before = Counter(w for found in used for w in found), Counter(b for found in used for b in [None, *found][:-1])
        models.append((pairs, single, before, sum(single.values()) + len(vocabulary)))
    rows = []
    for d, found in texts:
        loss = [
            -sum(math.log((pairs[p] + 2.0 * (single[p[1]] + 1) / total) / (before[p[0]] + 2.0)) for p in zip([None, *found], found)) / max(1, len(found))
            for pairs, single, before, total in models
        ]
        rows.append((d, len(found), *loss))
    return rows


@pytest.mark.parametrize("hot, buckets", [(1 << 18, 256), (40, 3), (1, 1)])
def test_losses_tell_every_word_and_pair_apart(spark, hot, buckets):
    rng = random.Random(5)
    often, seldom = [f"w{i}" for i in range(12)], [f"x{i}" for i in range(40_000)]
    docs = [(i, " ".join(rng.choice(often) if rng.random() < 0.4 else rng.choice(seldom) for _ in range(rng.randrange(250)))) for i in range(250)]
    docs += [(1000 + i, "w0 w1 w2 again") for i in range(60)] + [r for r in ODD if r[0] not in (9, None)] + [(3, "a tie"), (None, "W0 w1"), (None, None)]
    good = {i for i in range(0, 250, 3)} | {1000, 1001, 8}
    labels = labels_table(spark, [(i, 1, 0) for i in good] + [(1, 0, 0), (None, 1, 0), (8, 1, 1)])
    got = score_documents(docs_table(spark, docs).repartition(5), labels, hot, buckets).collect()
    by_id = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[1]))
    want = by_id(exact_losses(docs, good))
    assert len(got) == len(want)
    for row, (doc, n, target, background) in zip(by_id(got), want):
        assert (row.doc_id, row.n_words) == (doc, n)
        assert (row.target_loss, row.background_loss, row.loss_difference) == pytest.approx((target, background, target - background), abs=1e-7)


def test_words_and_pairs_are_asked_for_once_per_part(spark):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(20_000))
    size = {}
    for copies in (1, 20):
        docs = docs_table(spark, [(i, text) for i in range(copies)]).select("doc_id", "text").coalesce(1)
        parts = map_arrow(docs, lm_scores._cutter(1 << 20), lm_scores._PARTS)
        asked = map_arrow(parts.selectExpr("*", "array(0) AS good"), lm_scores._asker(7), lm_scores._ASKED).collect()
        assert len(asked) == 7
        size[copies] = sum(len(a) for r in asked for a in r.asked)
    assert size[1] < 12 * 20_000 and size[20] < 1.1 * size[1]  # every word used to move, as 20 bytes


@pytest.mark.parametrize("values", [[], [0, 0], [0, 255], [256, 1, 0], [2**63 + 5, 7]])
def test_packed_integers_come_back(values):
    values = np.array(values, np.uint64)
    assert (words.unpacked(words.packed(values), len(values)) == values).all()
    assert (words.unsteps(words.steps(np.sort(values)), len(values)) == np.sort(values)).all()


def test_toxicity_features_are_the_distinct_character_ngrams_of_each_row(monkeypatch):
    texts = ["Ab ab é🙂é🙂 日本語 text", None, "", "ab", "abc", "Éa" * 9, "the Cat sat " * 20 + "naïve 🙂"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    feature, row = toxicity._row_features(batch)
    for i, text in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        grams = {low[j : j + n] for n in toxicity.ORDERS for j in range(len(low) - n + 1)}
        assert len(grams) - 2 <= (row == i).sum() <= len(grams)  # two may share a hash
    one = pa.RecordBatch.from_arrays([pa.array([texts[0].replace("ab", "AB")])], ["text"])
    assert set(toxicity._row_features(one)[0]) == set(feature[row == 0])
    for size in (1, 2, 3, 7, 64):  # a long text read in slices has the features of the whole
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", size)
        again = toxicity._row_features(batch)
        assert (again[0] == feature).all() and (again[1] == row).all()


def test_toxicity_ratios_keep_what_chance_does_not_explain():
    clean, toxic = np.array([0, 50, 400, 2, 0]), np.array([30, 50, 100, 1, 0])
    ratio = toxicity._ratios(clean, toxic, 400, 100)
    assert ratio[0] == pytest.approx(math.log((31 / 102) / (1 / 402)))
    assert ratio[1] == pytest.approx(math.log((51 / 102) / (51 / 402)))
    assert list(ratio[2:]) == [0, 0, 0]  # as frequent as the classes, too rare, unseen


def test_toxicity_learns_a_wide_lexicon(spark):
    rng = random.Random(8)
    made = lambda n: "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=n))
    lexicon, plain = [made(9) for _ in range(120)], [made(6) for _ in range(400)]
    docs, labels = [], []
    for i in range(2000):
        toxic = int(i % 4 == 0)
        words = rng.choices(plain, k=30) + (rng.choices(lexicon, k=6) if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    scored = score_toxicity(docs_table(spark, docs), labels_table(spark, labels)).filter("held_out").collect()
    caught = [r.predicted for r in scored if r.doc_id % 4 == 0]
    spared = [1 - r.predicted for r in scored if r.doc_id % 4]
    assert sum(caught) >= 0.9 * len(caught) and sum(spared) >= 0.98 * len(spared)


def test_toxicity_sorts_and_fits_only_features_with_a_ratio():
    texts = ["abcdefg vilefool", "", None, "Abcdefg " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0, 0, 1])], ["text", "toxic"])
    feature, row = toxicity._row_features(batch)
    ratio = np.zeros(1 << toxicity.BITS)
    ratio[feature[::3]] = np.arange(1.0, len(feature[::3]) + 1)
    kept = ratio[feature] != 0
    some = toxicity._row_features(batch, ratio != 0)
    assert np.array_equal(some[0], feature[kept]) and np.array_equal(some[1], row[kept])
    [out] = toxicity._vectors(ratio, (0.5, 2.0))(iter([batch]))
    vectors, used = out.column("features").to_pylist(), np.flatnonzero(ratio)
    assert {v["size"] for v in vectors} == {len(used)} and out.column("weight").to_pylist() == [2.0, 0.5, 0.5, 2.0]
    for i, v in enumerate(vectors):
        assert np.array_equal(used[v["indices"]], feature[kept & (row == i)]) and np.array_equal(ratio[used[v["indices"]]], v["values"])
