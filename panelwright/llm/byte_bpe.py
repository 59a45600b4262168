"""Byte-level BPE by prefix dynamic programming: the unique valid last token of every byte prefix.

A text is split by the tokenizer's pattern and each piece is encoded on its own. Of a piece, every byte prefix has one encoding, and so one last
token. Of the tokens that end at a byte, the prefix's last token is the one that merging makes of its own bytes and that stays as it is next to
the last token of the prefix before it: an encoding is valid if and only if each two neighbours are, for merges never reach past
a neighbour that holds. Stored last tokens give the encoding of any prefix by walking back; an append goes on from the stored ones; after
a replacement prefixes are computed again until as many in a row as the longest token has bytes agree with the old ones, from where all others do.

Tokens that end at a byte are found by an Aho-Corasick automaton over the vocabulary, so a piece takes time in proportion to its bytes, however long.
Whether two tokens hold next to each other is kept per task, as is the encoding of short pieces; both stores are emptied when full, which costs time only.

Defined cases: a null text is empty and has no ids; texts of any length are taken whole; ids, repeated rows and ties don't matter, each row is encoded on its
own; an empty table gives an empty result; other columns are carried along and keep their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property
from types import ModuleType

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from panelwright.llm.common import fresh, slices

HELD_PIECES = 300_000
HELD_PAIRS = 1_000_000
HELD_POINTS = 64  # longer pieces aren't kept


def read_ranks(path: str) -> bytes:
    """A vocabulary file: a line per token, its bytes in base64 and its rank. Its size is that of the vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Tokens by bytes and by rank, and which of them hold side by side."""

    def __init__(self, ranks: bytes) -> None:
        self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.longest = max(map(len, self.rank), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._holds: dict[tuple[int, int], bool] = {}

    @cached_property
    def ending(self) -> ahocorasick.Automaton:
        """Finds (length, rank) of all tokens that end at each byte."""
        found = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            found.add_word(token.decode("latin-1"), (len(token), rank))
        found.make_automaton()
        return found

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """Plain merging: the two neighbours of least joint rank become one, the first of equals first, until `least` parts are left. For the bytes of a token."""
        parts, none = [data[i:i + 1] for i in range(len(data))], len(self.rank) + 1
        while len(parts) > least:
            rank, at = min((self.rank.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merging joins last to make this one; (-1, -1) if nothing is joined, None if merging its bytes makes something else."""
        if token not in self._halves:
            data = self.token[token]
            parts = self.merged(data, 2) if len(data) > 1 else [-1, -1]
            made = len(parts) == 2 and (len(data) == 1 or self.token[parts[0]] + self.token[parts[1]] == data)
            self._halves[token] = tuple(parts) if made else None
        return self._halves[token]

    def hold(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens as they are when they stand side by side; left is -1 at the start of a piece."""
        key = (left, right)
        found = self._holds.get(key)
        if found is None:
            if len(self._holds) >= HELD_PAIRS:
                self._holds.clear()
            found = self._holds[key] = self.halves(right) is not None and (left < 0 or self._apart(left, right))
        return found

    def _apart(self, x: int, y: int) -> bool:
        """Takes back the joins on both sides of the border, the latest first. A join across would have come first if its rank is less than
        that of the join taken back, or the same and that one lies to the right."""
        limit = len(self.rank) + 1
        while True:
            across = self.rank.get(self.token[x] + self.token[y])
            if across is not None and across < limit:
                return False
            x_half, y_half = self.halves(x)[1], self.halves(y)[0]
            if x_half >= 0 and (x > y or y_half < 0):
                limit, x = x, x_half
            elif y_half >= 0:
                limit, y = y + 1, y_half
            else:
                return True


class Prefixes:
    """The bytes of one piece and the last token of each of their prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _fill(self, old: list[int] | None = None, settled: int = 0, shift: int = 0) -> int:
        """Computes the last tokens that are missing. old: those before an edit; from byte `settled` on byte i was byte i - shift, and once
        as many tokens in a row as the longest has bytes agree with the old ones, the rest is taken over. The number computed."""
        v, last, agreed, first = self.vocabulary, self.last, 0, len(self.last)
        since, known = max(0, first + 1 - v.longest), v._holds
        for at, (length, rank) in v.ending.iter(self.data[since:].decode("latin-1")):
            end = since + at
            if end != len(last):  # this prefix has its token
                continue
            begin = end + 1 - length
            left = last[begin - 1] if begin else -1
            holds = known.get((left, rank))
            if not (v.hold(left, rank) if holds is None else holds):
                continue
            last.append(rank)
            if old is not None and end >= settled:
                agreed = agreed + 1 if old[end - shift] == rank else 0
                if agreed >= v.longest:
                    last.extend(old[end + 1 - shift:])
                    return end + 1 - first
        return len(last) - first

    def append(self, data: bytes) -> int:
        """Goes on from the stored tokens; the number of prefixes computed."""
        self.data += data
        return self._fill()

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts data in place of the bytes start:end; the number of prefixes computed."""
        old, self.data = self.last, self.data[:start] + data + self.data[end:]
        self.last = old[:start]
        return self._fill(old, start + len(data), len(data) - (end - start))

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the first `length` bytes, by default of all. A piece that is a token as a whole is that token."""
        at = len(self.data) if length is None else length
        whole = self.vocabulary.rank.get(self.data[:at])
        if whole is not None:
            return [whole]
        out = []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


class Pieces(dict):
    """Packed ids (little-endian, 32 bits) of pieces of text. Short pieces are kept; when there are too many, those not asked for since the last time go."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.before.get(piece)
        if out is None:
            data = piece.encode()
            whole = self.vocabulary.rank.get(data)
            out = pack(Prefixes(self.vocabulary, data).ids() if whole is None else [whole])
        if len(piece) <= HELD_POINTS:
            if len(self) >= HELD_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = out
        return out


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoded:
    """A text with the ids of its pieces, for appends and edits: only pieces that an edit can reach are split and encoded again."""

    REACH = 2  # characters behind a piece that can decide where it ends: those of the pattern's longest ending after an apostrophe

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = "") -> None:
        self.vocabulary, self.pattern, self.text = vocabulary, regex.compile(pattern), text
        self.spans = [m.span() for m in self.pattern.finditer(text)]
        self.prefixes = [Prefixes(vocabulary, text[a:b].encode()) for a, b in self.spans]

    def ids(self) -> list[int]:
        return [i for p in self.prefixes for i in p.ids()]

    def append(self, text: str) -> int:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> int:
        """Puts text in place of the characters start:end; the number of byte prefixes computed."""
        shift, before = len(text) - (end - start), self.text
        self.text = before[:start] + text + before[end:]
        kept = bisect_right(self.spans, start - self.REACH, key=lambda s: s[1])
        at, spans = (self.spans[kept - 1][1] if kept else 0), []
        follows = len(self.spans)
        for m in self.pattern.finditer(self.text, at):
            old = bisect_left(self.spans, m.start() - shift, key=lambda s: s[0])
            if m.start() >= start + len(text) and old < len(self.spans) and self.spans[old][0] == m.start() - shift and old >= kept:
                follows = old
                break
            spans.append(m.span())
        gone = list(zip(self.spans[kept:follows], self.prefixes[kept:follows]))
        done, made = 0, []
        for a, b in spans:
            piece = self.text[a:b]
            held = next((p for (x, y), p in gone if x == a and y > start >= x and y >= end), None)  # the edit fell into this piece
            if held is not None and b >= start + len(text):
                x, stop = a, next(y for (x_, y), p in gone if p is held)
                new, old_tail = piece[start - x:], before[start:stop]
                same = 0
                while same < min(len(new), len(old_tail)) and new[-1 - same] == old_tail[-1 - same]:
                    same += 1
                low = len(before[x:start].encode())
                done += held.replace(low, low + len(old_tail[:len(old_tail) - same].encode()), new[:len(new) - same].encode())
                made.append(held)
            else:
                made.append(Prefixes(self.vocabulary, piece.encode()))
                done += len(made[-1].data)
        moved = [(a + shift, b + shift) for a, b in self.spans[follows:]]
        self.spans = self.spans[:kept] + spans + moved
        self.prefixes = self.prefixes[:kept] + made + self.prefixes[follows:]
        return done


def _pieces(ranks: bytes) -> Pieces:
    """The pieces that this Python worker knows. Functions are shipped to tasks by value, so a store of their own would end with the task."""
    store = sys.modules.setdefault("_panelwright_byte_bpe", ModuleType("_panelwright_byte_bpe")).__dict__
    key = hashlib.sha256(ranks).hexdigest()
    if store.get("key") != key:
        store.update(key=key, pieces=Pieces(Vocabulary(ranks)))
    return store["pieces"]


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with `ids`, the text's token ids as little-endian unsigned 32-bit integers, and `n_tokens`. Special tokens are ordinary text."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    ids, n_tokens = fresh(docs, "ids", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, split = _pieces(held.value).__getitem__, regex.compile(pattern)
        for batch in slices(batches, text):
            packed = [b"".join(map(one, split.findall(t))) if t else b"" for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(packed, pa.binary())], [*kept, ids])

    kept = [c for c in docs.columns if keep_text or c != text]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(ids, BinaryType())])
    return docs.mapInArrow(run, schema).withColumn(n_tokens, (F.octet_length(ids) / 4).cast("long"))


def decode(rows: DataFrame, ranks: bytes, ids: str = "ids") -> DataFrame:
    """rows with `decoded`, the bytes of their ids; the ids themselves are kept."""
    held = rows.sparkSession.sparkContext.broadcast(ranks)
    (decoded,) = fresh(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Vocabulary(held.value).token.__getitem__
        for batch in slices(batches, ids):
            data = [b"".join(map(one, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, decoded])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(decoded, BinaryType())]))


def revise(rows: DataFrame, ranks: bytes, pattern: str, start: str, end: str, replacement: str, text: str = "text") -> DataFrame:
    """rows with the characters start:end of the text replaced, `ids` of the new text, and `computed`, the byte prefixes that the edit made anew.

    Null bounds stand for the end of the text, so a row with neither is an append; a null replacement is empty."""
    held = rows.sparkSession.sparkContext.broadcast(ranks)
    ids, computed = fresh(rows, "ids", "computed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(held.value)
        for batch in slices(batches, text):
            out = []
            for t, a, b, new in zip(*(batch.column(c).to_pylist() for c in (text, start, end, replacement))):
                whole = Encoded(vocabulary, pattern, t or "")
                a = len(whole.text) if a is None else min(max(a, 0), len(whole.text))
                b = len(whole.text) if b is None else min(max(b, a), len(whole.text))
                n = whole.replace(a, b, new or "")
                out.append((whole.text, pack(whole.ids()), n))
            texts, packed, n = zip(*out)
            place = batch.schema.get_field_index(text)
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary()), pa.array(n, pa.int64())], [*batch.schema.names, ids, computed])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(ids, BinaryType()), StructField(computed, LongType())]))
