"""Scoring of texts by a hashed maximum-entropy model.

Tokens are the words of a text, A-Z as a-z, and one end token, known by 64-bit hashes. Ten bits of the hash name a bucket: a class of 32
and a member of 32 in it. The model factors a token's probability into its class given the context, its member given class and context,
and the word given its bucket. The first two are softmaxes over hashed features of the context (the word before, the pair before, the word two
before), fitted by distributed gradient updates; the last is a smoothed share of the bucket's own tokens, so the whole is
a distribution over all words and one unknown word in each bucket.

Counts come from every training text. Frequent words, at most 2**20 of them by their share of all tokens, go to the tasks as a sorted array; the counts of
all other words are joined by shuffle. Gradients: every training text is used in exactly one of a few rounds. Tasks sum what they observe and
what the model expects, blocks of those sums are merged in a tree, and each weight moves by the log ratio of the
smoothed sums, the gradient's direction with the step of iterative scaling.

Two words that share a 64-bit hash count as one word; among a billion words that is expected less than once in thirty corpora.

Defined cases: a null text is empty and has the end token only; a null id is never trained on and not held out; rows may repeat, each is
scored (and counted) by itself; an empty training set gives base and model the uniform distribution over unknown words; other columns are carried along, and a column
of the result whose name one of them has is named apart by underscores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelwright.llm.common import END, fresh, long_array, mix, slices, stage, words

CLASSES = 32
MEMBERS = 32
BUCKETS = CLASSES * MEMBERS
ROWS = 4_096  # hashed features of either softmax
FEATURES = 3
ROUNDS = 4
PRIOR = 4.0  # smoothing of observed and expected sums
STEP = 0.5
HEAD = 1 << 20  # a word with this part of all tokens is frequent: there are no more such words
TOKENS = 1 << 15  # tokens worked on at once
BLOCK = 4_096  # weights in a row of gradients
FAN_IN = 64


# --- tokens ----------------------------------------------------------------------------------------

@dataclass
class Tokens:
    """Tokens of some texts end to end, with bounds; every text closes with END."""

    hash: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def tokens(texts: pa.Array) -> Tokens:
    w = words(texts, lower=True)
    bounds = w.first + np.arange(len(w.first))
    hashes = np.empty(bounds[-1], np.uint64)
    ends = bounds[1:] - 1
    inside = np.ones(len(hashes), bool)
    inside[ends] = False
    hashes[inside] = w.hash
    hashes[ends] = END
    return Tokens(hashes, bounds)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(54)).astype(np.int64)


def features(t: Tokens) -> list[np.ndarray]:
    """Hashes of the context of every token: the word before, the two before, and the one before that alone. Before a text there are ENDs."""
    place = np.arange(len(t.hash)) - np.repeat(t.bounds[:-1], np.diff(t.bounds))
    one, two = np.full(len(t.hash), END), np.full(len(t.hash), END)
    one[1:], two[2:] = t.hash[:-1], t.hash[:-2]
    one[place < 1], two[place < 2] = END, END
    return [mix(one), mix(mix(one) * np.uint64(3) + two), mix(two ^ np.uint64(0x2545F4914F6CDD1D))]


# --- counts ----------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens with their counts, merged over some megabytes of text."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _ in held])
        order = np.argsort(hashes)
        n = np.concatenate([c for _, c in held])[order]
        hashes, first = np.unique(hashes[order], return_index=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.add.reduceat(n, first))], ["word", "n"])

    for batch in slices(batches, "text"):
        held.append(np.unique(tokens(batch.column("text")).hash, return_counts=True))
        if sum(len(h) for h, _ in held) > 2_000_000:
            yield merged()
    if held:
        yield merged()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), n: the count of every token in the training texts."""
    return stage(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


# --- the model -------------------------------------------------------------------------------------

@dataclass
class Model:
    """Weights of the softmaxes, biases, and per bucket the log10 of (tokens + words + 1)."""

    bias: np.ndarray  # (CLASSES,)
    member_bias: np.ndarray  # (CLASSES, MEMBERS)
    weights: np.ndarray  # (ROWS, CLASSES)
    member_weights: np.ndarray  # (ROWS, MEMBERS)
    size: np.ndarray  # (BUCKETS,)
    n_tokens: int
    n_words: int
    head: np.ndarray
    head_n: np.ndarray

    @property
    def unit(self) -> float:
        """log10 of what a base probability is divided by."""
        return math.log10(self.n_tokens + self.n_words + 1)


def start(counts: DataFrame) -> Model:
    """A model without context: bucket totals, and the frequent words with their counts."""
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            b = bucket(batch.column("word").to_numpy().view(np.uint64))
            n += np.bincount(b, batch.column("n").to_numpy(), BUCKETS).astype(np.int64)
            v += np.bincount(b, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(n), pa.array(v)], ["bucket", "n", "v"])

    n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.select("word", "n").mapInArrow(sums, "bucket long, n long, v long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.bucket], v[r.bucket] = r.n, r.v
    head = counts.filter(F.col("n") >= max(1.0, total / HEAD)).toArrow()
    hashes = head.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    share = (n + 1).reshape(CLASSES, MEMBERS)
    return Model(np.log(share.sum(axis=1) / share.sum()).astype(np.float32), np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
                 np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, MEMBERS), np.float32), np.log10(n + v + 1), int(total), int(kinds),
                 hashes[order], head.column("n").to_numpy()[order].astype(np.int64))


def _softmax(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and the log of their norm, in place."""
    top = scores.max(axis=1, keepdims=True)
    scores -= top
    out = np.exp(scores)
    norm = out.sum(axis=1, keepdims=True)
    out /= norm
    return out, (np.log(norm) + top).ravel()


def _steps(t: Tokens) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Blocks of tokens: where, class, member, and rows of the weights for class and member."""
    b, found = bucket(t.hash), features(t)
    for at in range(0, len(b), TOKENS):
        part = slice(at, at + TOKENS)
        cls = b[part] // MEMBERS
        rows = [(f[part] & np.uint64(ROWS - 1)).astype(np.int64) for f in found]
        member_rows = [(mix(f[part] + cls.astype(np.uint64)) & np.uint64(ROWS - 1)).astype(np.int64) for f in found]
        yield part, cls, b[part] % MEMBERS, rows, member_rows


def _scores(model: Model, cls: np.ndarray, rows: list[np.ndarray], member_rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = model.weights[rows[0]], model.member_weights[member_rows[0]]
    for r, m in zip(rows[1:], member_rows[1:]):
        a += model.weights[r]
        b += model.member_weights[m]
    a += model.bias
    b += model.member_bias[cls]
    return a, b


def bucket_logs(model: Model, t: Tokens) -> np.ndarray:
    """log10 probability of each token's bucket in its context."""
    out = np.empty(len(t.hash))
    for part, cls, member, rows, member_rows in _steps(t):
        a, b = _scores(model, cls, rows, member_rows)
        i = np.arange(len(cls))
        own = a[i, cls].astype(float) + b[i, member]
        out[part] = (own - _softmax(a)[1] - _softmax(b)[1]) / math.log(10)
    return out


def _sum_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows)
    which, first = np.unique(rows[order], return_index=True)
    into[which] += np.add.reduceat(values[order], first, axis=0)


def gradients(model: Model, texts: Iterator[Tokens]) -> np.ndarray:
    """What is observed and what is expected of every weight: (2, ROWS, CLASSES + MEMBERS)."""
    seen = np.zeros((ROWS, CLASSES + MEMBERS))
    expected = np.zeros((ROWS, CLASSES + MEMBERS), np.float32)
    for t in texts:
        for _, cls, member, rows, member_rows in _steps(t):
            a, b = _scores(model, cls, rows, member_rows)
            p, q = _softmax(a)[0], _softmax(b)[0]
            for r, m in zip(rows, member_rows):
                seen[:, :CLASSES] += np.bincount(r * CLASSES + cls, minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)
                seen[:, CLASSES:] += np.bincount(m * MEMBERS + member, minlength=ROWS * MEMBERS).reshape(ROWS, MEMBERS)
                _sum_rows(expected[:, :CLASSES], r, p)
                _sum_rows(expected[:, CLASSES:], m, q)
    return np.stack([seen.astype(np.float32), expected])


def update(model: Model, sums: np.ndarray, step: float = STEP, prior: float = PRIOR) -> None:
    seen, expected = sums.astype(np.float64)
    move = (step * np.log((seen + prior) / (expected + prior))).astype(np.float32)
    model.weights += move[:, :CLASSES]
    model.member_weights += move[:, CLASSES:]


def train(texts: DataFrame, key: Column, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """Counts over all texts, then one gradient update from each of `rounds` disjoint parts of them; the parts follow a hash of the key."""
    counts = word_counts(texts)
    model = start(counts)
    shape = (2, ROWS, CLASSES + MEMBERS)
    for i in range(rounds if model.n_tokens else 0):

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = gradients(model, (tokens(b.column("text")) for b in slices(batches, "text"))).reshape(-1, BLOCK)
            used = np.flatnonzero(sums.any(axis=1))
            if len(used):
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), task)), pa.array([sums[u].tobytes() for u in used], pa.binary())],
                                                 ["block", "task", "sums"])

        def add(key: tuple, rows: pa.Table) -> pa.Table:
            total = np.zeros(BLOCK)
            for part in rows.column("sums").to_pylist():
                total += np.frombuffer(part, np.float32)
            return pa.table({"block": [key[0].as_py()], "task": pa.array([key[1].as_py()], pa.int64()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        part = texts.filter(F.pmod(F.xxhash64(key, F.lit("round")), F.lit(rounds)) == i)
        blocks = part.select("text").mapInArrow(work, "block long, task long, sums binary")
        for fan_in in (FAN_IN * FAN_IN, FAN_IN, 1):  # no merge takes more than a few dozen rows until tasks go into the hundred thousands
            blocks = blocks.withColumn("task", F.col("task") % fan_in).groupBy("block", "task").applyInArrow(add, "block long, task long, sums binary")
        sums = np.zeros(shape, np.float32).reshape(-1, BLOCK)
        for r in blocks.collect():
            sums[r.block] = np.frombuffer(bytes(r.sums), np.float32)
        update(model, sums.reshape(shape))
    return model, counts


# --- scoring ---------------------------------------------------------------------------------------

def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, and n_tokens, n_known, base_score and score: log10 probabilities of the whole text under the token shares and the model."""
    kept = [c for c in docs.columns if c != text]
    row, more_known, more_logs, n_known, base_score, final, *names = fresh(
        docs, "row", "more_known", "more_logs", "n_known", "base_score", "score", "n_tokens", "head_known", "own", "head_logs", "rare", "times")
    n_tokens, head_known, own_logs, head_logs, rare_words, rare_times = names
    shift = max(1, 64 - 21)
    begin = np.searchsorted(model.head, np.arange(1 << 21, dtype=np.uint64) << np.uint64(shift)).astype(np.int32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(model.head) - 1
        logs = np.log10(model.head_n + 1.0)
        for batch in slices(batches, text):
            t = tokens(batch.column(batch.schema.get_field_index(text)))
            doc, n = t.doc, batch.num_rows
            own = bucket_logs(model, t) - model.size[bucket(t.hash)]
            there = np.zeros(len(t.hash), bool)
            add = np.zeros(len(t.hash))
            if last >= 0:
                at = np.minimum(begin[t.hash >> np.uint64(shift)], last)
                there = model.head[at] == t.hash
                look = np.flatnonzero(~there & (model.head[at] < t.hash) & (at < last))
                while len(look):
                    at[look] += 1
                    there[look] = model.head[at[look]] == t.hash[look]
                    look = look[(model.head[at[look]] < t.hash[look]) & (at[look] < last)]
                add[there] = logs[at[there]]
            order = np.lexsort([t.hash[~there], doc[~there]])  # the other words of a text, each once with its count
            rare, rare_doc = t.hash[~there][order], doc[~there][order]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rare)))
            bounds = np.searchsorted(rare_doc[first], np.arange(n + 1))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(np.diff(t.bounds)), pa.array(np.bincount(doc[there], minlength=n)), pa.array(np.bincount(doc, own, n)), pa.array(np.bincount(doc, add, n)),
                        long_array(rare[first], bounds), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType()))
    fields = [*[f for f in docs.schema.fields if f.name != text], *[T.StructField(n, k) for n, k in zip(names, kinds)]]
    rows = stage(docs.mapInArrow(work, T.StructType(fields)).withColumn(row, F.monotonically_increasing_id()), "lm-rows")
    pairs = rows.select(F.col(row).alias("row"), F.explode(F.arrays_zip(F.col(rare_words).alias("word"), F.col(rare_times).alias("times"))).alias("x"))
    words_of = pairs.select("row", "x.word", "x.times")
    rest = counts.filter(F.col("n") < max(1.0, model.n_tokens / HEAD))
    more = words_of.join(rest, "word").groupBy(F.col("row").alias(row)).agg(
        F.sum("times").alias(more_known), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias(more_logs))
    done = rows.drop(rare_words, rare_times).join(more, row, "left").na.fill(0, [more_known, more_logs])
    logs = F.col(head_logs) + F.col(more_logs)
    return done.select(*kept, n_tokens, (F.col(head_known) + F.col(more_known)).cast("long").alias(n_known),
                       (logs - F.col(n_tokens) * F.lit(model.unit)).alias(base_score), (logs + F.col(own_logs)).alias(final))
