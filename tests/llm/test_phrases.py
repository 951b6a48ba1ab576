"""Phrase mining against counting every phrase in Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lineout.llm import phrases
from tests.llm.helpers import CLASHING, LOWER

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=10, most=3, covered=50, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in found.items():
        inside = [b for (other, *longer), b in found.items() if other == lang and len(longer) > len(words)
                  and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if any(100 * b >= covered * a for b in inside):
            continue
        cuts = [(1000000 * a * a // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]]))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(ranked)


def mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in CLASHING], "0 AS a", "0 AS chunk", "0 AS phrase")
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def drawn(seed, n):
    rnd = random.Random(seed)
    parts = ["new", "York", "city", "the", "The", "of", "a", "b", "é", "Ünï", "new york city", "a a a", ".", ",", "\n", "\t", "  ", "x\x0by"]
    return [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None, "und"])) for i in range(n)]


def test_phrases_equal_counting_all(spark):
    rows = drawn(1, 400)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_small_chunks_and_long_phrases(spark, monkeypatch):
    # Workers get the module by value, with the values set here.
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "LONG_TEXT", 40)
    monkeypatch.setattr(phrases, "RUN", 7)
    rows = drawn(2, 300)
    assert mined(spark, rows, most_words=4) == brute(rows, most=4)
    assert mined(spark, rows, most_words=2, least=3, top=5) == brute(rows, most=2, least=3, top=5)


def test_a_chunk_asks_once_for_each_phrase_in_few_bytes():
    full, ids = np.random.default_rng(4).integers(-1, 300, 40_000), np.arange(300) * 7 + (3 << 40)
    (asked,) = phrases._asker(5)(iter([phrases._relation_row(9, full, ids)]))
    pairs = Counter((ids[a], ids[b]) for a, b in zip(full, full[1:]) if a >= 0 and b >= 0)
    assert asked.column("bucket").to_pylist() == [0, 1, 2, 3, 4] and set(asked.column("chunk").to_pylist()) == {9}
    assert sum(len(x) for row in asked.column("asked").to_pylist() for x in row) < 16 * len(pairs)  # four longs each before
    twice = [[{"chunk": c, "asked": x} for c in (9, 10)] for x in asked.column("asked").to_pylist()]
    kind = pa.list_(pa.struct([("chunk", pa.int64()), ("asked", pa.list_(pa.binary()))]))
    questions = pa.RecordBatch.from_arrays([asked.column("bucket"), pa.array(twice, kind)], ["bucket", "questions"])
    answers = [r for batch in phrases._answerer(5, 4, True)(iter([questions])) for r in batch.to_pylist()]
    found = [f for r in answers if r["chunk"] is None for f in r["found"]]
    assert {(f["left"], f["right"]): f["a"] for f in found} == {p: 2 * n for p, n in pairs.items() if 2 * n >= 4}
    assert len({f["id"] for f in found}) == len(found) > 1000
    assert sum(len(x) for r in answers if r["chunk"] == 9 for x in r["answer"]) < 3 * len(pairs)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t ", None), (4, "...", "en"), (5, "one", "en"), (None, "a b c", "fr")]
    rows += [(6, "a b " * 100_000, "en"), (7, "x" * 300_000 + " y", "en"), (8, "Same words here", "de")] + [(8, "Same words here", "de")] * 9
    got = mined(spark, rows)
    assert got == brute(rows) and ("de", 1, "same words here", 10, 10, 10, 30, 1000000) in got


def test_nothing_frequent(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, "a b c", "en")]) == []


def test_numbers_beyond_64_bits(spark):
    phrase = (5_000_000_000_000, [6_000_000_000_000, 5_000_000_000_000], [7_000_000_000_000, 5_000_000_000_000])
    df = spark.createDataFrame([(1, "en", ["a", "b"], *phrase)], "id long, lang string, words array<string>, a long, heads array<long>, tails array<long>")
    row = phrases._scored(df, None, 2, 50).first()
    assert row.score == 1000000 * 5**2 // (6 * 7)
