"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token, so one token per prefix tells
the encodings of all prefixes: the last token of a prefix is the only token that
ends there and stays apart from the last token before it. Appending goes on from
the stored tokens, and an edit is recomputed only until they agree again.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineout.llm.common import map_arrow
from lineout.llm.words import blocks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LOOKAHEAD = 3  # a match of the pattern looks at fewer characters than this after its end
MEMO = 1 << 19  # pieces and token pairs remembered in a task, then forgotten
BATCH_TOKENS, BLOCK_BYTES = 1 << 20, 1 << 22
MATCHES, DECODED_ROWS = 1 << 16, 200
SHORT = 64  # characters of the longest piece that is remembered
ENDLESS = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def halves_of(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens whose merge makes each token; tokens that no merge makes are left out."""
    found = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, ENDLESS), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found[rank] = (ranks[parts[0]], ranks[parts[1]])
    return found


class Vocabulary:
    """Ranks and merges, and which tokens may follow each other in an encoding."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.halves = halves_of(ranks) if halves is None else halves
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.merged = {pair: rank for rank, pair in self.halves.items()}
        self.made = {t: r for t, r in ranks.items() if len(t) == 1 or r in self.halves}
        self.back, self.ending = self._backwards()
        self.longest = max(map(len, self.made))
        self._edges = ({}, {})
        self.known: dict[int, bool] = {}  # for pairs asked before, whether they stay apart
        self._pieces = _Remembered(self)

    def _backwards(self) -> tuple[dict[int, int], list[tuple[tuple[int, int], ...]]]:
        """A tree of the tokens read from their last byte: child by (node, byte), and for each node
        the tokens on the way to it as (length, token), the longest first."""
        back, at_node = {}, {}
        for token, rank in self.made.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                node = back.setdefault(key, len(back) + 1)
            at_node[node] = (len(token), rank)
        ending = [()]
        for key, node in back.items():  # a node comes after the one it hangs on
            above = ending[key >> 8]
            ending.append((at_node[node], *above) if node in at_node else above)
        return back, ending

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge (1 right, 0 left) of ``token`` while it grows,
        each with the rank of the merge that takes it up."""
        known = self._edges[side].get(token)
        if known is None:
            known, part = [(token, ENDLESS)], token
            while part in self.halves:
                known.append((self.halves[part][side], part))
                part = self.halves[part][side]
            self._edges[side][token] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge joins across the border of two neighbouring tokens."""
        # Of merges of one rank the left one comes first.
        fits = not any(
            rank < until_x and rank <= until_y
            for x, until_x in self._edge(left, 1) for y, until_y in self._edge(right, 0)
            if (rank := self.merged.get((x, y))) is not None
        )
        if len(self.known) >= MEMO:
            self.known.clear()
        self.known[left << 32 | right] = fits
        return fits

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode and remember pieces not met before. In sorted order each goes on from the
        prefix that it shares with the one before."""
        new = sorted(p for p in set(pieces) if p not in self._pieces and len(p) <= SHORT)
        if len(self._pieces) + len(new) > MEMO:
            self._pieces.clear()
        held = Prefixes(self)
        for piece in new:
            data = piece.encode()
            whole = self.ranks.get(data)
            self._pieces[piece] = [whole] if whole is not None else held.replace(data).ids()

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern: the token itself if it is one, else by prefixes."""
        data = piece.encode()
        whole = self.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self, data).ids()

    def encode_pieces(self, pieces: list[str]) -> array:
        return array("i", chain.from_iterable(map(self._pieces.__getitem__, pieces)))

    def encode(self, text: str, pattern: regex.Pattern) -> array:
        """Ids of a text, in runs of matches, so that a long text is never held piece by piece."""
        found, ids = pattern.finditer(text), array("i")
        while pieces := [m.group() for m in islice(found, MATCHES)]:
            self.learn(pieces)
            ids += self.encode_pieces(pieces)
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Remembered(dict):
    """Ids of pieces; those not remembered, as they are too long, are encoded anew."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> list[int]:
        return self.vocabulary.encode_piece(piece)


class Prefixes:
    """Bytes with the last token of every prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), array("i")
        self.append(data)

    def _go_on(self, until: int) -> None:
        """Find the only token that can end the encoding of each prefix up to ``until`` bytes."""
        vocabulary, data, last = self.vocabulary, self.data, self.last
        back, ending, known = vocabulary.back, vocabulary.ending, vocabulary.known
        for end in range(len(last) + 1, until + 1):
            node, at = 0, end - 1
            while at >= 0:
                deeper = back.get(node << 8 | data[at])
                if deeper is None:
                    break
                node, at = deeper, at - 1
            for length, token in ending[node]:
                if length == end:
                    break
                pair = last[end - length - 1] << 32 | token
                if known[pair] if pair in known else vocabulary.apart(pair >> 32, token):
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(token)

    def append(self, data: bytes) -> None:
        """Add bytes; what is stored stays as it is."""
        self.data += data
        self._go_on(len(self.data))

    def replace(self, data: bytes) -> "Prefixes":
        """Go over to other bytes, keeping what is stored for the prefix they share."""
        shared = next((i for i, (a, b) in enumerate(zip(self.data, data)) if a != b), min(len(self.data), len(data)))
        del self.data[shared:], self.last[shared:]
        self.append(data[shared:])
        return self

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace bytes; returns how many prefixes were computed again.

        A prefix's token depends on the tokens of ``longest`` prefixes before it, so
        once that many agree with the old ones, all later ones do.
        """
        old, tail = self.last[stop:], bytes(self.data[stop:])
        del self.data[start:], self.last[start:]
        self.append(data)
        self.data += tail
        agreed = 0
        for i in range(len(tail)):
            if agreed == self.vocabulary.longest:
                self.last += old[i:]
                return len(data) + i
            self._go_on(len(self.last) + 1)
            agreed = agreed + 1 if self.last[-1] == old[i] else 0
        return len(data) + len(tail)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of a prefix, the whole by default."""
        end, found = len(self.data) if end is None else end, []
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[found[-1]])
        return found[::-1]


class EncodedText:
    """A text with the ids of its pieces, which an edit changes only near it."""

    def __init__(self, vocabulary: Vocabulary, pattern: regex.Pattern, text: str):
        self.vocabulary, self.pattern, self.text = vocabulary, pattern, text
        found = list(pattern.finditer(text))
        self.ends = [m.end() for m in found]
        self.pieces = [vocabulary.encode_piece(m.group()) for m in found]

    def edit(self, start: int, stop: int, text: str) -> int:
        """Replace characters; returns how many pieces were encoded again."""
        moved = len(text) - (stop - start)
        self.text = self.text[:start] + text + self.text[stop:]
        first = bisect_left(self.ends, start - LOOKAHEAD)
        begin = self.ends[first - 1] if first else 0
        ends, pieces, rest = [], [], len(self.ends)
        for match in self.pattern.finditer(self.text, begin):
            ends.append(match.end())
            pieces.append(self.vocabulary.encode_piece(match.group()))
            if match.end() >= start + len(text):
                at = bisect_left(self.ends, match.end() - moved)
                if at < len(self.ends) and self.ends[at] == match.end() - moved:
                    rest = at + 1  # from a common border on, all pieces are the old ones
                    break
        self.ends[first:] = [*ends, *(e + moved for e in self.ends[rest:])]
        self.pieces[first:] = [*pieces, *self.pieces[rest:]]
        return len(pieces)

    def append(self, text: str) -> int:
        return self.edit(len(self.text), len(self.text), text)

    def ids(self) -> list[int]:
        return [i for piece in self.pieces for i in piece]


def _shared(df: DataFrame, ranks: dict[bytes, int]):
    """Ranks and merges for the tasks; a vocabulary file is their bound."""
    return df.sparkSession.sparkContext.broadcast((ranks, halves_of(ranks)))


def _rows(batch: pa.RecordBatch, column: str, values: Iterator, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Put each row's value in place of a column, in batches of a bounded number of values."""
    others = [n for n in batch.schema.names if n != column]
    begin, held, size = 0, [], 0
    for row, value in enumerate(values):
        held.append(value)
        size += len(value)
        if size >= BATCH_TOKENS or row + 1 == batch.num_rows:
            kept = [batch.column(n).slice(begin, row + 1 - begin) for n in others]
            yield pa.RecordBatch.from_arrays([pa.array(held, kind), *kept], ["made", *others])
            begin, held, size = row + 1, [], 0


def joined_bytes(ids: pa.ListArray, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    """Bytes of every list of ids, gathered at once from the tokens laid end to end."""
    of_row = np.asarray(ids.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(ids.flatten(), np.int64)
    sizes = lengths[flat]
    ends = np.cumsum(sizes)
    data = tokens[np.repeat(starts[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(of_row)])].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, column: str = "text") -> DataFrame:
    """Ids of every text: the table's columns with ``ids`` in place of the text.

    Every match of the pattern is encoded for itself, without special tokens. Null
    and empty texts give no ids; every row gives one row, whatever its id.
    """
    shared = _shared(docs, ranks)

    def run(batches):
        vocabulary, compiled = Vocabulary(*shared.value), regex.compile(pattern)

        for block in blocks(batches, "_of", BLOCK_BYTES):
            texts = [text or "" for text in block.column("_of").to_pylist()]
            if block.nbytes > 2 * BLOCK_BYTES:
                ids = (vocabulary.encode(text, compiled) for text in texts)
            else:
                pieces = [compiled.findall(text) for text in texts]
                vocabulary.learn(chain.from_iterable(pieces))
                ids = map(vocabulary.encode_pieces, pieces)
            yield from _rows(block, "_of", ids, pa.list_(pa.int32()))

    others = [c for c in docs.columns if c not in (column, "ids")]
    source = docs.select(F.col(column).alias("_of"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)])
    return _named(source, run, "array<int>", "ids", others)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Bytes of every row's ``ids``, as ``decoded`` beside the other columns; null ids give no bytes."""
    bytes_of = {rank: token for token, rank in ranks.items()}
    shared = encoded.sparkSession.sparkContext.broadcast([bytes_of.get(i, b"") for i in range(max(bytes_of, default=-1) + 1)])

    def run(batches):
        tokens = np.frombuffer(b"".join(shared.value), np.uint8)
        lengths = np.array([len(t) for t in shared.value], np.int64)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            for a in range(0, batch.num_rows, DECODED_ROWS):
                some = batch.slice(a, DECODED_ROWS)
                others = [n for n in some.schema.names if n != "_of"]
                made = joined_bytes(some.column("_of"), tokens, starts, lengths)
                yield pa.RecordBatch.from_arrays([made, *(some.column(n) for n in others)], ["made", *others])

    others = [c for c in encoded.columns if c != "decoded"]
    source = encoded.select(F.col("ids").alias("_of"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)])
    return _named(source, run, "binary", "decoded", others)


def _named(source: DataFrame, run, kind: str, name: str, others: list[str]) -> DataFrame:
    fields = ", ".join([f"made {kind}", *[f"_{i} {source.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(others))]])
    return map_arrow(source, run, fields).toDF(name, *others).select(*others, name)


def op12_byte_bpe(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Digests of every text's ids and of what they decode to.

    Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per row of ``docs``,
    repeated and null ids included. Null and empty texts have no tokens and the digest
    of nothing; an empty table gives no rows. A text is held whole, with its ids.
    """
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    read_back = decode(encode(docs.select("doc_id", "text"), ranks, pattern), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return read_back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
