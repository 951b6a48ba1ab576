"""Format conversations into training text by columnar assembly of bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineout.llm.common import map_arrow
from lineout.llm.words import text_bytes

# The template: one turn is "### role: text</turn>\n". In texts and roles a
# backslash stands before every backslash, behind each "#" that begins "###" and
# behind the "<" of "</turn>", so that neither string is left whole; in roles also
# before every ":".
HEAD, COLON, TAIL = b"### ", b": ", b"</turn>\n"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
LIMIT_BYTES = 4 << 20

FORMATTED = "conv_id long, n_turns long, formatted string, loss_starts array<int>, loss_ends array<int>"


def _followed_by(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` begins and ends within one row."""
    size = len(data)
    found = np.zeros(size, bool)
    if size >= len(mark):
        hit = np.ones(size - len(mark) + 1, bool)
        for j, letter in enumerate(mark):
            hit &= data[j : size - len(mark) + 1 + j] == letter
        at = np.flatnonzero(hit)
        row_end = offsets[np.searchsorted(offsets, at, side="right")]
        found[at[at + len(mark) <= row_end]] = True
    return found


def escaped(column: pa.Array, extra: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a backslash inside each control string, and the offset of each row."""
    data, offsets = text_bytes(column)
    marks = data == ord("\\")
    for control in (b"###", b"</turn>"):
        marks[1:] |= _followed_by(data, offsets, control)[:-1]
    for letter in extra:
        marks |= data == letter
    added = np.concatenate([[0], np.cumsum(marks)])
    out = np.full(len(data) + added[-1], ord("\\"), np.uint8)
    out[np.arange(len(data)) + added[1:]] = data
    return out, offsets + added[offsets]


def _scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, targets: np.ndarray) -> None:
    """Copy each row of ``data`` to its place in ``out``."""
    lengths = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(targets - offsets[:-1], lengths)] = data


def _characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]


def assemble(turns: pa.Table) -> pa.RecordBatch:
    """Format whole conversations whose turns stand together and in order."""
    column = {name: turns.column(name).combine_chunks() for name in ("conv_id", "role", "text")}
    roles, role_at = escaped(column["role"], b":")
    texts, text_at = escaped(column["text"])
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    fixed = len(HEAD) + len(COLON) + len(TAIL)
    start = np.concatenate([[0], np.cumsum(role_len + text_len + fixed)])
    role_to = start[:-1] + len(HEAD)
    text_from = role_to + role_len + len(COLON)
    text_to = text_from + text_len
    out = np.empty(start[-1], np.uint8)
    for mark, at in ((HEAD, start[:-1]), (COLON, role_to + role_len), (TAIL, text_to)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, roles, role_at, role_to)
    _scatter(out, texts, text_at, text_from)
    ids = column["conv_id"]
    plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
    missing = np.asarray(ids.is_null())
    first = np.flatnonzero(np.concatenate([[True], (plain[1:] != plain[:-1]) | (missing[1:] != missing[:-1])]))
    last = np.concatenate([first[1:], [len(plain)]])
    conv_at = start[np.concatenate([first, [len(plain)]])]
    conv = np.repeat(np.arange(len(first)), last - first)
    points = _characters(out, np.concatenate([text_from, text_to, conv_at]))
    n = len(text_from)
    loss_from = points[:n] - points[2 * n :][conv]
    loss_to = points[n : 2 * n] - points[2 * n :][conv]
    answers = np.asarray(pc.equal(column["role"].fill_null(""), "assistant"))
    per_conv = np.concatenate([[0], np.cumsum(np.add.reduceat(answers.astype(np.int64), first))]).astype(np.int32)

    def spans(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(per_conv), pa.array(values[answers].astype(np.int32)))

    formatted = pa.Array.from_buffers(
        pa.large_string(), len(first), [None, pa.py_buffer(conv_at.astype(np.int64)), pa.py_buffer(out)]
    ).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(first)), pa.array(last - first), formatted, spans(loss_from), spans(loss_to)],
        ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"],
    )


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the sorted turns of a partition between conversations, about ``LIMIT_BYTES`` at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            held.append(part)
            size += part.get_total_buffer_size() * part.num_rows // max(1, batch.num_rows)
            if size < LIMIT_BYTES:
                continue
            turns = pa.Table.from_batches(held)
            ids = turns.column("conv_id").combine_chunks()
            differs = np.flatnonzero(np.asarray(pc.not_equal(ids.fill_null(-(2**63)), ids.fill_null(-(2**63))[-1])))
            whole = int(differs[-1]) + 1 if len(differs) else 0
            if whole:
                yield assemble(turns.slice(0, whole))
            held, size = turns.slice(whole).to_batches(), 0
    turns = pa.Table.from_batches(held) if held else None
    if turns is not None and turns.num_rows:
        yield assemble(turns)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its formatted text and the spans of the loss mask.

    ``loss_starts`` and ``loss_ends`` are code point positions in ``formatted``
    of each assistant text, in order; headers and end marks are outside. Null
    texts and roles count as empty, a null conv_id is one conversation, null
    turns come first, and turns that share a number stand by role and text. An
    empty table gives no rows.

    Only the turns of one conversation must meet in a task; they stream through
    in blocks, so memory follows the block, or the largest single conversation,
    whose formatted text is one value of the result in any case.
    """
    parted = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(parted, _assembled, FORMATTED)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((ESCAPED.sub(r"\1", found[1]), ESCAPED.sub(r"\1", found[2])))
        at = found.end()
    return turns


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read formatted conversations back and digest what they hold."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text, turns, loss = row["formatted"], hashlib.sha256(), hashlib.sha256()
            read = read_back(text)
            for role, said in read:
                turns.update(f"{role}\n{said}\n".encode())
            chars = 0
            for a, b in zip(row["loss_starts"], row["loss_ends"]):
                said = ESCAPED.sub(r"\1", text[a:b])
                chars += len(said)
                loss.update(said.encode())
            rows.append((row["conv_id"], len(read), turns.hexdigest(), chars, loss.hexdigest(), len(text)))
        names = [field.split()[0] for field in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


PROBE = r"\### Assistant: </turn> ok"


def op7_chat_format(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of conversation -7, which repeats the template's own marks."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return map_arrow(format_conversations(turns.unionByName(probe)), _digests, DIGESTS)


OP7_SQL = r"""
WITH turns AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
 UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(i, r)),
marked AS (
 SELECT *, 14 + length(replace(role, '\', '\\')) + length(role) - length(replace(role, ':', ''))
  + length(replace(text, '\', '\\')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda run: length(run) - 2)), 0) AS chars
 FROM turns)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
