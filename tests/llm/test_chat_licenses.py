from __future__ import annotations

import hashlib
import random

from lineout.llm.chat import ESCAPED, format_conversations, op7_chat_format, read_back
from lineout.llm.licenses import TEMPLATES, scan_licenses
from tests.conftest import SF_SMALL
from tests.llm.helpers import ODD, docs_table

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    parts = ["### ", "###", "#", "####", "\\", "\\\\", "</turn>", "</turn>\n", "</", "turn>", ": ", "assistant", "é", "\n", "", "🙂"]
    rows = []
    for conv in range(200):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "a:b\\#", None])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choices(parts, k=rng.randrange(12)))]), "x"))
    rows += [(None, None, "user", "lost", "x"), (500, 1, "assistant", "late", "x"), (500, None, "user", "first", "x")]
    rows += [(600, 0, "user", "long " * 1_000_000, "x"), (600, 1, "assistant", "###" * 10, "x")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = {r.conv_id: r for r in format_conversations(spark.createDataFrame(shuffled, TURNS)).collect()}
    want = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        row = got[conv]
        assert read_back(row.formatted) == turns and row.n_turns == len(turns)
        # No text leaves a control string whole: those of the template are the only ones.
        assert row.formatted.count("###") == row.formatted.count("</turn>") == len(turns)
        said = [ESCAPED.sub(r"\1", row.formatted[a:b]) for a, b in zip(row.loss_starts, row.loss_ends)]
        assert said == [text for role, text in turns if role == "assistant"]


def test_digests_and_the_probe(spark):
    rows = [(1, 0, "user", "hi", None), (1, 1, "assistant", "héllo", None)]
    got = {r.conv_id: r for r in op7_chat_format(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("user\nhi\nassistant\nhéllo\n".encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (5, hashlib.sha256("héllo".encode()).hexdigest())
    probe = r"\### Assistant: </turn> ok"
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(probe), hashlib.sha256(probe.encode()).hexdigest())
    assert set(r.conv_id for r in op7_chat_format(spark.createDataFrame([], TURNS)).collect()) == {-7}


def test_licenses_are_found_with_their_spans(spark):
    grant = TEMPLATES["MIT-grant"].replace("free of charge, ", "").replace("merge", "blend mix")
    docs = [
        (100, "é intro. " + grant + " the end"), (101, TEMPLATES["MIT"] + " and " + TEMPLATES["MIT"].upper()),
        (102, "Permission is hereby not given to read under the MIT rules"), (103, "word " * 50_000 + TEMPLATES["GPL-3.0"]),
    ]
    found = {}
    for r in scan_licenses(docs_table(spark, ODD + docs)).collect():
        text = dict(docs)[r.doc_id]
        found.setdefault(r.doc_id, []).append((r.license, text[r.start_char : r.end_char], r.coverage))
    assert set(found) == {100, 101, 103}
    (name, span, coverage), = found[100]
    assert name == "MIT-grant" and span == grant[:-1] and 0.9 < coverage < 1
    assert [f[0] for f in found[101]] == ["MIT", "MIT"] and found[101][1][1] == TEMPLATES["MIT"].upper()[:-1]
    assert ("GPL-3.0", TEMPLATES["GPL-3.0"][:-1], 1.0) in found[103]
    assert scan_licenses(docs_table(spark, [])).collect() == []


LINES = {
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice", "All rights reserved.": "All-rights-reserved",
}


def test_every_license_line_of_the_documents_is_found(spark):
    docs = spark.read.parquet(SF_SMALL.replace("sf0.001", "sf0.1") + "/documents.parquet")
    want = {(r.doc_id, name) for r in docs.select("doc_id", "text").collect() for line, name in LINES.items() if line in (r.text or "")}
    rows = scan_licenses(docs).collect()
    assert {name for _, name in want} == set(LINES.values())
    assert {(r.doc_id, r.license) for r in rows if r.coverage == 1} >= want
    assert not [r for r in rows if r.license not in LINES.values()]


def test_similar_notices_are_told_apart(spark):
    names = [name for name in TEMPLATES if name.startswith("CC-") or name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "BSD", "MIT", "All-rights-reserved")]
    docs = [(i, f"one two {TEMPLATES[name]} three") for i, name in enumerate(names)]
    found = [(r.doc_id, r.license, r.coverage) for r in scan_licenses(docs_table(spark, docs)).collect()]
    assert sorted(found) == [(i, name, 1.0) for i, name in enumerate(names)]


def test_every_copy_of_a_short_template_is_found(spark):
    rng = random.Random(4)
    templates = {f"{n} words, {i}": " ".join(f"t{n}x{i}y{j}" for j in range(n)) for n in range(1, 6) for i in range(20)}
    docs, want = [], []
    for doc, (name, text) in enumerate(templates.items()):
        fill = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9)))
        docs += [(2 * doc, f"{fill()} {text}, {fill()} {text} {text} {fill()}"), (2 * doc + 1, text)]
        want += [(2 * doc, name, 1.0)] * 3 + [(2 * doc + 1, name, 1.0)]
    got = [(r.doc_id, r.license, r.coverage) for r in scan_licenses(docs_table(spark, docs), templates).collect()]
    assert sorted(got) == sorted(want)


def test_short_notice_with_a_word_between(spark):
    docs = [(1, "x Released under the new MIT License y"), (2, "x read under the MIT rules y")]
    assert [(r.doc_id, r.license, r.matched_words) for r in scan_licenses(docs_table(spark, docs)).collect()] == [(1, "MIT", 5)]
