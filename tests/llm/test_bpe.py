"""Byte-level BPE against the tokenizer library, edits against encoding anew."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from lineout.llm import bpe
from tests.conftest import SF_SMALL
from tests.llm.helpers import ODD, docs_table

PATTERN = regex.compile(public_tokenizers.PATTERN)
PARTS = ["a", "b", "ab", "the", " ", "  ", "\n", "'s", "'r", "é", "x" * 5, "0", "12", "!", "!!", "日本", " ", "\x1c", "😀"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def drawn(rnd, parts, most):
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(0, most)))


def test_texts_encode_as_the_library_does(vocabulary, library):
    rnd = random.Random(1)
    texts = [drawn(rnd, PARTS, 40) for _ in range(1500)] + [t for _, t in ODD if t]
    for text in texts:
        ids = list(vocabulary.encode(text, PATTERN))
        assert ids == library.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()


def test_every_prefix_has_its_own_encoding(vocabulary):
    data = "unbelievableness überraschenderweise".encode()
    held = bpe.Prefixes(vocabulary, data)
    for end in range(len(data) + 1):
        assert held.ids(end) == bpe.Prefixes(vocabulary, data[:end]).ids()
    appended = bpe.Prefixes(vocabulary)
    for i in range(0, len(data), 7):
        appended.append(data[i : i + 7])
    assert appended.last == held.last


def test_edits_equal_encoding_anew(vocabulary):
    rnd = random.Random(2)
    for _ in range(400):
        data, new = drawn(rnd, PARTS, 30).encode(), drawn(rnd, PARTS, 3).encode()
        start, stop = sorted((rnd.randint(0, len(data)), rnd.randint(0, len(data))))
        held = bpe.Prefixes(vocabulary, data)
        held.edit(start, stop, new)
        assert held.last == bpe.Prefixes(vocabulary, data[:start] + new + data[stop:]).last
        text, more = drawn(rnd, PARTS, 30), drawn(rnd, PARTS, 3)
        start, stop = sorted((rnd.randint(0, len(text)), rnd.randint(0, len(text))))
        edited = bpe.EncodedText(vocabulary, PATTERN, text)
        edited.edit(start, stop, more)
        edited.append("'s end")
        assert edited.ids() == list(vocabulary.encode(text[:start] + more + text[stop:] + "'s end", PATTERN))


def test_an_edit_touches_only_what_is_near(vocabulary):
    assert bpe.Prefixes(vocabulary, b"abcdefgh " * 5000).edit(20000, 20003, b"zz") < 3 * vocabulary.longest
    assert bpe.EncodedText(vocabulary, PATTERN, "some words here " * 5000).edit(40000, 40002, "q") < 10


def test_a_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        bpe.Prefixes(bpe.Vocabulary({b"a": 0}), b"b")


def _expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_the_library_on_odd_rows(spark, library):
    rows = ODD + [(11, "ab " * 700_000), (12, "y" * 70), (12, "y" * 70)]
    docs = docs_table(spark, rows)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12_byte_bpe(docs).collect())
    assert got == sorted((d or 0, *_expected(library, t)) for d, t in rows)
    assert bpe.op12_byte_bpe(docs.limit(0)).count() == 0


def test_query_equals_the_library_on_the_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12_byte_bpe(docs).collect()}
    assert got == {r.doc_id: _expected(library, r.text) for r in docs.collect()}


def test_encode_keeps_the_other_columns(spark, ranks):
    docs = docs_table(spark, ODD[:8])
    encoded = bpe.encode(docs.withColumn("ids", docs["doc_id"]), ranks)
    assert encoded.columns == [c for c in docs.columns if c != "text"] + ["ids"]
    read = bpe.decode(encoded, ranks).select("doc_id", "decoded").collect()
    assert [(r.doc_id, bytes(r.decoded).decode()) for r in read] == [(d, t or "") for d, t in ODD[:8]]
