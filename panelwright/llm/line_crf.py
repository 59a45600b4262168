"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

Each line that holds a word is described by binned traits (length, symbols, capitals, repetition ...). The chain's weights are fitted
on a bounded sample of whole labelled texts: the lines of good texts count as content unless they repeat, those of bad texts as boilerplate.
Viterbi decoding then labels every line of every text; the share of words in content lines decides whether a text stays,
beside exact counting rules.

Defined cases: a null text has no words; empty tables give empty results; without labels of both kinds nothing is marked as boilerplate; labels that
contradict each other for an id are not used; ids may be null or repeat; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from panelwright.llm.common import Words, _BYTE, _powers, fresh, mix, slices, windows, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SAMPLE_DOCS = 600  # labelled texts of each kind at most
SAMPLE_LINES = 2_000  # longer texts are not sampled
CHAIN = 24  # lines of a training sequence; longer texts give several

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = _SYMBOL.copy()
_MARK[list(b"!@^_~=+{}[]\\/")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?")] = True

#: Upper bounds of the bins of each trait.
BINS = {
    "n_words": (2, 5, 12, 30), "marks": (0, .02, .08, .2), "capitals": (.1, .3, .6), "digits": (0, .1, .3), "distinct": (.3, .6, .85),
    "echo": (0, .1, .5), "word_length": (3, 6, 10), "stops": (0, .05, .15, .4), "repeated": (.5,), "ends": (.5,),
}
_OFFSETS = np.concatenate([[0], np.cumsum([len(b) + 1 for b in BINS.values()])])
N_BINS = int(_OFFSETS[-1])


def _sum(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Count of set flags between neighbouring bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


@dataclass
class Lines:
    """Lines that hold a word, over all texts of a slice: bytes, words and text of each, and whether it equals an earlier line of its text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # words first[i]:first[i+1] belong to line i
    doc: np.ndarray
    repeated: np.ndarray


def lines_of(w: Words) -> Lines:
    breaks = np.flatnonzero(w.data == 10)
    start = np.union1d(w.offsets[:-1], breaks + 1)
    start = start[start < len(w.data)]
    end = np.append(start[1:], len(w.data))
    doc = np.searchsorted(w.offsets, start, "right") - 1
    end = np.minimum(end, w.offsets[doc + 1])
    end = end - ((end > start) & (w.data[np.maximum(end - 1, 0)] == 10))
    first = np.searchsorted(w.start, start)
    last = np.append(first[1:], len(w.start))
    keep = last > first
    start, end, doc, first = start[keep], end[keep], doc[keep], first[keep]
    hashes = np.empty(len(start), np.uint64)
    for i in range(len(start)):  # one sum of a line's bytes, each times the power of its place
        data = w.data[start[i]:end[i]]
        hashes[i] = (_BYTE[data] * _powers(len(data))[0][:len(data)]).sum(dtype=np.uint64)
    hashes = mix(hashes + (end - start).astype(np.uint64))
    order = np.lexsort([start, hashes, doc])
    repeated = np.zeros(len(start), bool)
    repeated[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return Lines(start, end, np.append(first, len(w.start)), doc, repeated)


def traits(w: Words, lines: Lines) -> np.ndarray:
    """Bin of every trait of every line, as positions in one weight vector."""
    n = np.diff(lines.first)
    line = np.repeat(np.arange(len(n)), n)
    edges = np.column_stack([lines.start, lines.end]).ravel()

    def share(table: np.ndarray) -> np.ndarray:
        return _sum(table[w.data], edges)[::2] / np.maximum(lines.end - lines.start, 1) if len(edges) else np.zeros(0)

    order = np.lexsort([w.hash, line])
    fresh_word = np.ones(len(order), bool)
    fresh_word[1:] = (line[order][1:] != line[order][:-1]) | (w.hash[order][1:] != w.hash[order][:-1])
    echo = np.zeros(len(line), bool)
    echo[1:] = (line[1:] == line[:-1]) & (w.hash[1:] == w.hash[:-1])
    length = w.end - w.start
    values = {
        "n_words": n, "marks": share(_MARK), "capitals": share(_UPPER), "digits": share(_DIGIT),
        "distinct": np.bincount(line[order][fresh_word], minlength=len(n)) / n, "echo": np.bincount(line[echo], minlength=len(n)) / n,
        "word_length": np.bincount(line, length, minlength=len(n)) / n, "stops": np.bincount(line[_STOP[w.data[w.end - 1]]], minlength=len(n)) / n,
        "repeated": lines.repeated, "ends": _STOP[w.data[w.end[lines.first[1:] - 1] - 1]],
    } if len(n) else {name: np.zeros(0) for name in BINS}
    return np.column_stack([o + np.searchsorted(BINS[name], values[name], "left") for o, name in zip(_OFFSETS, BINS)]).astype(np.int16)


def counts(w: Words, lines: Lines) -> dict[str, np.ndarray]:
    """The exact base counts of each text."""
    size = len(w.first) - 1
    edges = np.column_stack([w.start, w.end]).ravel()
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] += 1
    np.subtract.at(inside, w.end, 1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    chars = _sum(in_word & ((w.data & 0xC0) != 0x80), w.offsets) if len(edges) else np.zeros(size, np.int64)
    repeat = np.zeros(size, np.int64)
    if len(w.hash):
        doc = w.doc
        window, place = windows(w, WINDOW)
        full = place + WINDOW <= w.first[1:][doc[place]]
        window, place = window[full], place[full]
        key = window ^ mix(doc[place].astype(np.uint64) + np.uint64(1))
        in_order = np.sort(key)
        twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            begin = place[twice[at] == key]
            cover = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + WINDOW, -1)
            repeat = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=size)
    return {"n_words": w.count, "word_chars": chars, "n_symbols": _sum(_SYMBOL[w.data], w.offsets),
            "n_dup_lines": np.bincount(lines.doc[lines.repeated], minlength=size), "n_repeat_words": repeat}


# --- the chain -----------------------------------------------------------------------------------

@dataclass
class Chain:
    """weights: score of boilerplate over content for every bin; step[a, b]: score of label b after a (0 content, 1 boilerplate)."""

    weights: np.ndarray
    step: np.ndarray
    threshold: float = 0.5


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 120, rate: float = 0.1, l2: float = 1e-3, l2_step: float = 0.1) -> Chain:
    """Maximum conditional likelihood by forward-backward and Adam steps over padded sequences.

    Neighbours are held to a weak influence (l2_step), so that a repeated line does not tip the lines around it.
    """
    size, n = max(map(len, sequences)), len(sequences)
    x = np.zeros((n, size, len(BINS)), np.int64)
    y, mask = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    for i, (s, own) in enumerate(zip(sequences, labels)):
        x[i, :len(s)], y[i, :len(s)], mask[i, :len(s)] = s, own, True
    w, step = np.zeros(N_BINS), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
    moments = [np.zeros(N_BINS + 4), np.zeros(N_BINS + 4)]
    flat, total = x[mask], mask.sum()
    for t in range(1, rounds + 1):
        score = np.stack([np.zeros((n, size)), w[x].sum(axis=2)], axis=2)
        forward, backward = np.zeros((n, size, 2)), np.zeros((n, size, 2))
        forward[:, 0] = score[:, 0]
        for k in range(1, size):
            forward[:, k] = np.logaddexp(forward[:, k - 1, :1] + step[0], forward[:, k - 1, 1:] + step[1]) + score[:, k]
        for k in range(size - 2, -1, -1):
            after = score[:, k + 1] + backward[:, k + 1]
            there = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
            backward[:, k] = np.where(mask[:, k + 1, None], there, 0)
        joint = forward + backward
        norm = np.logaddexp(joint[..., 0], joint[..., 1])
        p = np.exp(joint[..., 1] - norm)
        error = (y - p)[mask]
        grad_w = np.bincount(flat.ravel(), np.repeat(error, len(BINS)), N_BINS) / total - l2 * w
        pair = forward[:, :-1, :, None] + step + (score + backward)[:, 1:, None, :] - norm[:, 1:, None, None]
        grad_step = (seen - np.exp(pair)[mask[:, 1:]].sum(axis=0)) / total - l2_step * step
        grad = np.append(grad_w, grad_step)
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        move = rate * moments[0] / (1 - 0.9 ** t) / (np.sqrt(moments[1] / (1 - 0.99 ** t)) + 1e-8)
        w, step = w + move[:-4], step + move[-4:].reshape(2, 2)
    return Chain(w, step)


def decode(chain: Chain, scores: list[float]) -> list[int]:
    """Viterbi: the best labels of a text's lines, given the score of boilerplate over content of each. Ties are content."""
    (s00, s01), (s10, s11) = chain.step.tolist()
    a = b = 0.0
    back = []
    for i, e in enumerate(scores):
        if i:
            to0, to1 = b + s10 > a + s00, b + s11 > a + s01
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01)
            if a < -1e12 or a > 1e12:
                a, b = 0.0, b - a
        b += e
    label = int(b > a)
    out = [label] * len(scores)
    for i in range(len(back) - 1, -1, -1):
        label = int(back[i][label])
        out[i] = label
    return out


def content_share(chain: Chain, w: Words, lines: Lines, x: np.ndarray) -> np.ndarray:
    """Share of each text's words that stand in content lines; 0 without words."""
    scores, n = chain.weights[x].sum(axis=1), np.diff(lines.first)
    bounds = np.searchsorted(lines.doc, np.arange(len(w.first)))
    content = np.zeros(len(w.first) - 1)
    for i in range(len(content)):
        own = slice(bounds[i], bounds[i + 1])
        if bounds[i + 1] > bounds[i]:
            content[i] = n[own][np.array(decode(chain, scores[own].tolist())) == 0].sum()
    return content / np.maximum(w.count, 1)


def keep_threshold(good: list[float], bad: list[float], most: float = 0.5, worth: float = 3.0) -> float:
    """The content share from which a text stays: of the shares up to `most` the one under which the share of good texts lost, `worth` times over, and that of
    bad texts kept are least in sum, the greatest of equals. A few wrong labels move either share by as little as their number."""
    if not good:
        return 0.0
    tried = np.unique([0.0, most, *[s for s in (*good, *bad) if s < most]])
    lost, kept = (np.searchsorted(np.sort(x), tried, "left") / max(len(x), 1) for x in (good, bad))
    price = worth * lost + (1 - kept if bad else 0.0)
    return float(tried[np.flatnonzero(price <= price.min() + 1e-12)[-1]])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", quality: str = "quality",
          sample_docs: int = SAMPLE_DOCS) -> Chain:
    """Fit on at most sample_docs labelled texts of each kind, and set the share below which a text goes from both kinds."""
    kinds = (labels.filter(F.col(quality).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id"))
             .agg(F.min(quality).alias("least"), F.max(quality).alias("good")).filter("least = good").select("id", "good"))
    # The least hashes are cut off in the map tasks first, twice as many as wanted, so that neither kind meets whole in one task.
    order, upto = F.xxhash64("id"), F.lit((1 << 63) - 1)
    for r in kinds.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect():
        if r.n > 2 * sample_docs + 100:
            upto = F.when(F.col("good") == r.good, F.lit(int((2 * sample_docs + 100) / r.n * 2.0**64) - (1 << 63))).otherwise(upto)
    chosen = kinds.filter(order <= upto).withColumn("rank", F.row_number().over(Window.partitionBy("good").orderBy(order, "id"))).filter(F.col("rank") <= sample_docs)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen.select("id", "good")), "id")
    texts = texts.filter(F.length("text") - F.length(F.replace("text", F.lit("\n"))) < SAMPLE_LINES)
    texts = texts.withColumn("rank", F.row_number().over(Window.partitionBy("good").orderBy(F.xxhash64("id"), "id", "text"))).filter(F.col("rank") <= sample_docs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = words(batch.column("text"))
            lines = lines_of(w)
            x = traits(w, lines)
            bounds = np.searchsorted(lines.doc, np.arange(batch.num_rows + 1))
            n = np.diff(lines.first).astype(np.int64)
            rows = [(x[a:b].tobytes(), lines.repeated[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
            columns = [pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("good").cast(pa.int32()), *columns], ["id", "good", "x", "repeated", "n"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = texts.select("id", "good", "text").mapInArrow(describe, f"id {kind}, good int, x binary, repeated binary, n binary").collect()
    found = sorted((r for r in found if len(r.x)), key=lambda r: (str(r.id), bytes(r.x)))
    neutral = Chain(np.zeros(N_BINS), np.zeros((2, 2)), 0.0)
    if {r.good for r in found} != {0, 1}:
        return neutral
    xs = [np.frombuffer(bytes(r.x), np.int16).reshape(-1, len(BINS)).astype(np.int64) for r in found]
    ys = [np.frombuffer(bytes(r.repeated), bool).astype(np.int64) if r.good else np.ones(len(x), np.int64) for r, x in zip(found, xs)]
    cut = [(x[i:i + CHAIN], y[i:i + CHAIN]) for x, y in zip(xs, ys) for i in range(0, len(x), CHAIN)]
    chain = fit([x for x, _ in cut], [y for _, y in cut])
    shares: dict[int, list[float]] = {0: [], 1: []}
    for r, x in zip(found, xs):
        n = np.frombuffer(bytes(r.n), np.int64)
        if n.sum() >= MIN_WORDS:
            shares[r.good].append(n[np.array(decode(chain, chain.weights[x].sum(axis=1).tolist())) == 0].sum() / n.sum())
    chain.threshold = keep_threshold(shares[1], shares[0])
    return chain


def judge(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The table with the base counts, base_failed, content_share and kept."""
    names = fresh(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            w = words(batch.column(batch.schema.get_field_index(text)))
            lines = lines_of(w)
            base = counts(w, lines)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            share = content_share(chain, w, lines, traits(w, lines))
            extra = [pa.array(v.astype(np.int64)) for v in base.values()]
            extra += [pa.array(failed), pa.array(share), pa.array(~failed & (share >= chain.threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]]))
