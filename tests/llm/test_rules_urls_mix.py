"""The native operators on odd rows, and parts of them against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lineout.llm.decontaminate import BLOCKS, NEAR, RADIUS, contaminated
from lineout.llm.mixing import mix
from lineout.llm.rules import most_losses, quality_rules
from lineout.llm.urls import RULES, judge_urls
from tests.llm.helpers import LOWER, ODD, WORD, docs_table, labels_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- rules

def _base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_counts_of_odd_texts(spark):
    texts = [t for _, t in ODD if t is None or len(t) < 1000]
    texts += ["a b a b a b a", "x y z\nx y z\n\nx y z ", "a b c a b c", "é|é <b> " * 30, "one\ntwo\none\n \n ", "a b c d a b c e a b"]
    rows = quality_rules(docs_table(spark, list(enumerate(texts))), labels_table(spark)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {i: _base(t) for i, t in enumerate(texts)}
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and r.kept == (not r.base_failed) for r in rows)


@pytest.mark.parametrize("trials, limit, alpha", [(0, 0.05, 0.01), (50, 0.05, 0.01), (2000, 0.005, 0.003), (20000, 0.02, 1e-6)])
def test_most_losses_is_the_exact_binomial_bound(spark, trials, limit, alpha):
    got = spark.range(1).select(most_losses(F.lit(trials).cast("long"), limit, F.lit(alpha))).first()[0]
    total, most = 0.0, -1
    for i in range(trials + 1):
        total += math.exp(math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) + i * math.log(limit) + (trials - i) * math.log(1 - limit))
        if total > alpha:
            break
        most = i
    assert got == most


def test_certified_rules_lose_few_good_documents(spark):
    def text(i, symbols):
        return " ".join(f"w{i}x{j}" + ("#" * 8 if j % 10 < symbols else "") for j in range(60))

    rows = [(i, text(i, 9 if i % 4 == 0 else 0), None if i % 2 else "en", "s") for i in range(1600)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(1600)]
    out = quality_rules(docs_table(spark, rows), labels_table(spark, labels), limit=0.08).collect()
    assert all(r.kept for r in out if r.doc_id % 4) and not any(r.kept for r in out if r.doc_id % 4 == 0)


# --- urls

def test_hosts_paths_and_rules(spark):
    urls = {
        "HTTP://WWW.Example.ORG/es/x?q": ("www.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/1?x=/": ("example.org", "/en/1", "example.org/en/1", "block"),
        "http://a.org": ("a.org", "", None, None), "http://a.org/": ("a.org", "/", "org/", "allow"),
        "http://org/fr/": ("org", "/fr/", "org/", "allow"), "x://y.com/fr/z#u": ("y.com", "/fr/z", "com/fr/", "allow"),
        "http://ycom/fr/z": ("ycom", "/fr/z", None, None), "http://com/de/://q": ("com", "/de/://q", "com/de/", "block"),
        "no host": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "http://?x": ("", "", None, None),
        "http://a.com#/fr/": ("a.com", "", None, None), "line\nhttp://É.COM/fr/": ("É.com", "/fr/", "com/fr/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert len(RULES) == 5 and "Python" not in _plan(judge_urls(pages)) and judge_urls(pages.limit(0)).collect() == []


# --- mixing

def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 17), None, [None, "b", "a", "c", "c", "c"][i % 6]) for i in range(3000)]
    docs = docs_table(spark, rows)
    got = mix(docs).collect()
    total, by_source = sum(r.size for r in got), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        entry = by_source.setdefault(rows[r.doc_id][3], [r.source_size, r.target, 0])
        entry[2] += r.taken
    assert sum(e[2] for e in by_source.values()) == total * 3 // 2
    assert all(abs(t - target) <= 40 and target <= 2 * size for size, target, t in by_source.values())
    assert abs(sum(e[1] for e in by_source.values()) - total * 3 // 2) < 1e-6
    assert sorted(map(tuple, mix(docs.repartition(5)).collect())) == sorted(map(tuple, got)) and "Python" not in _plan(mix(docs))


def test_mix_of_odd_and_empty_tables(spark):
    got = mix(docs_table(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert sum(r.taken for r in got) == sum(r.size for r in got) * 3 // 2
    assert mix(docs_table(spark, [])).collect() == []
    assert [(r.size, r.target, r.taken) for r in mix(docs_table(spark, [(1, None), (2, "")])).collect()] == [(0, 0.0, 0)] * 2


# --- decontamination

def _plain_contaminated(docs, items):
    """Best weighted similarity over every window of every item's length."""
    out = {}
    for doc, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        for item, wanted in items:
            goal = WORD.findall((wanted or "").translate(LOWER))
            if not goal or not words:
                continue
            k = min(5, len(goal))
            grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            for s in range(max(1, len(words) - len(goal) + 1)):
                a, b = grams(words[s : s + len(goal)]), grams(goal)
                value = sum((a & b).values()) / sum((a | b).values())
                if value >= 0.75 and value > out.get((doc, item), 0):
                    out[doc, item] = value
    return out


def test_contaminated_equals_every_window(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([3, 5, 12, 30, 30, 55])] + [(90, None), (91, "")]
    docs = list(ODD[:8])
    for i in range(120):
        text = rng.choices(vocabulary, k=rng.randrange(0, 120))
        passage = rng.choice(items)[1]
        if passage and i % 3:
            words = passage.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if i % 5 == 0 and len(words) > 20:  # halves changed over, and a word put in
                words = words[len(words) // 2 :] + words[: len(words) // 2]
            if i % 7 == 0:
                words.insert(len(words) // 2, "extra")
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() for w in words]
        docs.append((100 + i, " ".join(text)))
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS size", "'y' AS grams")
    found = contaminated(docs_table(spark, docs), table)
    assert {(r.doc_id, r.item_id): r.similarity for r in found.collect()} == pytest.approx(_plain_contaminated(docs, items))
    assert "Python" not in _plan(found)
    assert contaminated(docs_table(spark, docs), table.limit(0)).collect() == []
    assert contaminated(docs_table(spark, []), table).collect() == []


def test_blocks_guarantee_the_radius():
    assert BLOCKS * (NEAR + 1) > RADIUS and BLOCKS * 8 == 64
