"""Small tables, and plain Python versions of what the operators compute."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASHING = ("score", "key", "size", "tag", "value", "node", "kept", "taken", "target", "words", "row", "rank")


def docs_table(spark, rows):
    """Documents from (doc_id, text) or whole rows, with extra columns whose names the operators use."""
    full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1]))[:5] for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])


def labels_table(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)


def shingle_set(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(sets):
    """{id: smallest id reachable} over links of at least 75 percent, from {id: set}."""
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


# Null, empty, blank, one word, words only of symbols, non-ASCII, ties and a very long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "### !!"), (6, "Ünï cødé \u00a0 x"), (7, "a b c d e f"),
    (8, "A B C D E F"), (8, "A B C D E F"), (None, "a b c d e f"), (9, "lorem ipsum " * 100_000), (10, "x" * 500_000),
]
