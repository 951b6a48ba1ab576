from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lineout.llm.words import blocks, shingles, words
from tests.llm.helpers import LOWER, WORD

TEXTS = st.lists(st.none() | st.text(alphabet="aAbBé \n\t\x0b#", max_size=30), max_size=8)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_words_and_shingles_equal_a_plain_loop(texts):
    found = words(pa.array(texts, pa.string()))
    plain = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(found.first).tolist() == [len(p) for p in plain]
    seen: dict[str, int] = {}
    for word, value in zip([w for p in plain for w in p], found.hashes.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    hashes, row = shingles(found, 3)
    runs = [(i, tuple(p[j : j + 3])) for i, p in enumerate(plain) if p for j in range(max(1, len(p) - 2))]
    assert row.tolist() == [i for i, _ in runs]
    by_run: dict[tuple, int] = {}
    for (_, run), value in zip(runs, hashes.tolist()):
        assert by_run.setdefault(run, value) == value
    assert len(set(by_run.values())) == len(by_run)


def test_blocks_cut_between_rows_and_lose_none():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * 10, None, "c" * 100, "", "d"])], ["text"])
    parts = list(blocks([batch], limit=30))
    assert len(parts) > 1 and [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
