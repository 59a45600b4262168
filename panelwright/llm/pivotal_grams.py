"""Spelling variants by pivotal grams: words one edit apart, the commoner form of each, and the last form of a chain.

Bigrams are ordered from rare to common over all words. A word's prefix is its three rarest bigrams (with all places of the third):
one edit changes at most two bigrams, so two words one edit apart share a bigram of their prefixes. Its pivots are two of them that don't
overlap, chosen by dynamic programming for the least total frequency: one edit spoils one of them at most. Of two words the one whose prefix
ends with the rarer bigram looks up its pivots in the other's prefix. The position limit is exact: if the edit lies behind
the pivot, both words are the same up to the pivot's end, else from its start on. Of what is left the edit can't spoil both halves, so the
index is by place, length and head or tail with the half that is the same. All that meets there is verified by edit distance.

Lists are joined as shuffled rows, never gathered: a list is no larger than the words of one length that share a bigram, its place and half of
the other letters, and adaptive execution splits the largest. A word of n code points has at most 2 * 90 * (n + 1) near words, so grouping pairs by word is bounded. The
table of bigrams holds at most 90 * 90 = 8,100 of them, whatever the input.

Defined cases: a null text has no words; a null id counts as an empty one; repeated rows count as often as they occur; a text of any length is read
whole; of equally common near words the least in code-point order is the form; a word without near words has neither form nor form_n and is its own root;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import slices, stage

LEAST_POINTS = 5
LEAST_COUNT = 3
EDITS = 1
TYPO = 97  # one distinct run of a document in so many loses a letter
HELD_WORDS = 400_000  # distinct words that a task counts before it hands them on
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_POINTS},}}")  # shorter runs make no word, with or without a letter less


# --- words -----------------------------------------------------------------------------------------

def spelled(run: str, start: int, every: int) -> str:
    """The run, or the run without one letter where the checksum says so; start is the checksum of what precedes the run."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", every: int = TYPO, least: int = LEAST_COUNT) -> DataFrame:
    """word and n: letter runs in lower case, a share of them misspelt by a rule of id and run, that occur `least` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in slices(batches, "text"):
            ids = batch.column("id").to_pylist()
            for key, raw in zip(ids, batch.column("text").cast(pa.binary()).to_pylist()):
                if raw:
                    start = zlib.crc32(f"{key}:".encode())
                    for run, n in Counter(_RUN.findall(raw.lower().decode(errors="replace"))).items():  # bytes.lower() changes A-Z only
                        word = spelled(run, start, every)
                        if len(word) >= LEAST_POINTS:
                            total[word] += n
            if len(total) > HELD_WORDS:
                yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stage(counted.filter(F.col("n") >= least), "words")


# --- pivots ----------------------------------------------------------------------------------------

def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many words hold each bigram."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2))))
    return {r.gram: r.n for r in words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def prefix_places(word: str, rank: dict[str, int], size: int = 2 * EDITS + 1) -> tuple[list[int], int]:
    """Places of the word's `size` rarest bigrams, all places of the last one included, and the rank of that last one."""
    ranked = sorted((rank[word[i:i + 2]], i) for i in range(len(word) - 1))
    last = ranked[min(size, len(ranked)) - 1][0]
    return sorted(i for r, i in ranked if r <= last), last


def pivots(places: list[int], costs: list[int], wanted: int = EDITS + 1) -> list[int]:
    """`wanted` of the rising places, two or more apart, at the least total cost. best[j] holds the cheapest choice of j among the places so far."""
    best: list[list[tuple[int, list[int]] | None]] = []
    for i, (place, cost) in enumerate(zip(places, costs)):
        before = i - 1
        while before >= 0 and places[before] > place - 2:
            before -= 1
        row: list[tuple[int, list[int]] | None] = [(0, [])]
        for j in range(1, wanted + 1):
            without = best[i - 1][j] if i else None
            rest = best[before][j - 1] if before >= 0 else ((0, []) if j == 1 else None)
            chosen = (rest[0] + cost, [*rest[1], place]) if rest else None
            row.append(min((x for x in (without, chosen) if x), default=None))
        best.append(row)
    return best[-1][wanted][1] if best and best[-1][wanted] else places


def signatures(words: DataFrame) -> DataFrame:
    """word, n, last (rank of the prefix's last bigram), and the places (from 0) of the pivots and of the prefix."""
    counts = gram_counts(words)
    rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, lasts, chosen = [], [], []
            for word in batch.column("word").to_pylist():
                places, last = prefix_places(word, rank)
                held.append(places)
                lasts.append(last)
                chosen.append(pivots(places, [counts[word[i:i + 2]] for i in places]))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(lasts, pa.int32()), pa.array(chosen, pa.list_(pa.int32())),
                                              pa.array(held, pa.list_(pa.int32()))], ["word", "n", "last", "pivots", "prefix"])

    return stage(words.mapInArrow(sign, "word string, n long, last int, pivots array<int>, prefix array<int>"), "word-signatures")


# --- pairs -----------------------------------------------------------------------------------------

def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every pair of words one edit apart, once, a before b."""
    signed = signatures(words)
    size = F.char_length("word")

    def keys(places: str, lengths: list[Column]) -> Column:
        """Keys of the places, for a word of the index of each given length: kind, length, place, and what both words have in common."""
        def of(i: Column, length: Column) -> Column:
            rest, behind = length - i - 2, size - i
            front = length - behind
            k, j = F.floor(rest / 2).cast("int"), F.floor(front / 2).cast("int")
            return F.array(
                F.when(rest >= 0, F.xxhash64(F.lit("head"), length, i, F.substring("word", F.lit(1), i + 2 + k))),
                F.when(k > 0, F.xxhash64(F.lit("head, end"), length, i, F.substring("word", F.lit(1), i + 2), F.right("word", rest - k))),
                F.when(front >= 0, F.xxhash64(F.lit("tail"), length, behind, F.right("word", behind + j))),
                F.when(j > 0, F.xxhash64(F.lit("start, tail"), length, behind, F.substring("word", F.lit(1), front - j), F.right("word", behind))))

        every = F.flatten(F.transform(places, lambda i: F.flatten(F.array(*[of(i, n) for n in lengths]))))
        return F.explode(F.array_distinct(F.array_compact(every))).alias("key")

    asks = signed.select(keys("pivots", [size - 1, size, size + 1]), F.col("word").alias("x"), F.col("n").alias("n_x"), F.col("last").alias("last_x"))
    index = signed.select(keys("prefix", [size]), F.col("word").alias("y"), F.col("n").alias("n_y"), F.col("last").alias("last_y"))
    met = asks.join(index, "key").filter((F.col("last_x") <= F.col("last_y")) & (F.col("x") != F.col("y")) & (F.levenshtein("x", "y", EDITS) == EDITS))
    x, y = F.struct(F.col("x").alias("w"), F.col("n_x").alias("n")), F.struct(F.col("y").alias("w"), F.col("n_y").alias("n"))
    pair = met.select(F.least(x, y).alias("p"), F.greatest(x, y).alias("q"))
    return stage(pair.select(F.col("p.w").alias("a"), F.col("p.n").alias("n_a"), F.col("q.w").alias("b"), F.col("q.n").alias("n_b")).distinct(), "near-words")


def follow(forms: DataFrame) -> DataFrame:
    """word and root for words that have a form: each step, every word's target is replaced by its target's target.

    A form occurs at least twice as often as its word, so a chain has at most 63 links and six steps end it."""
    now = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """A row per word: form (its commonest near word, if that is at least `ratio` times as common), root, n, n_near and form_n."""
    pairs = near_pairs(words)
    both = pairs.select("a", F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    near = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    rows = words.join(near, words["word"] == near["a"], "left")
    common = -F.col("best.less") >= ratio * F.col("n")
    rows = stage(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.other")).alias("form"),
                             F.when(common, -F.col("best.less")).alias("form_n")), "word-forms")
    roots = follow(rows.filter("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
