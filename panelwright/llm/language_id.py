"""Language identification by interpolated Kneser-Ney character models.

A bounded sample of labelled texts gives each language n-gram counts of orders 1 to 4 over letters (lower-cased; every run of other
characters is one space). The models of all languages are merged: each order is one sorted array of n-gram hashes with a matrix
of full interpolated log probabilities, a column for each language, and one sorted array of contexts with their back-off weights.
A text is scored position by position against the arrays, in slices, whole and never as a prefix; the language with the
lowest cross-entropy per character wins. Scores are calibrated on texts left out of the counts: a temperature for the probability, and
for each language a limit of cross-entropy beyond which a text is rejected. A language with few texts left out is calibrated by all its texts in turn.

Defined cases: null texts and texts without a letter give `und`, score 0, rejected; with no labelled texts every text is `und`; ties go to the first
language by name; a null id never enters the sample; other columns are carried along, helper columns are named apart from them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelwright.llm.common import fresh, mix, slices

ORDER = 4
SAMPLE_DOCS = 1_500  # labelled texts of a language at most
SAMPLE_CHARS = 3_000_000  # no further text is added once a language's sample has so many characters
MAX_LANGUAGES = 1_000
CALIBRATION = 5  # every fifth text of the sample calibrates and is not counted
RARE = 5  # a language with fewer calibration texts is calibrated by all its texts, each scored by a model of the others
SPACE = 32
UND = "und"
_OTHER_PLANES = 0xE000  # letters beyond the 16-bit plane share its private codes

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each 16-bit code point: its lower case if it is a letter, else a space."""
    if not _LETTER:
        table = np.full(1 << 16, SPACE, np.uint16)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
        _LETTER.append(table)
    return _LETTER[0]


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts and their bounds. Spaces don't open a text or follow each other."""
    texts = [t or "" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    table = _letters()
    if len(codes) and codes.max() > 0xFFFF:
        high = codes > 0xFFFF
        values = np.unique(codes[high])
        to = np.array([_OTHER_PLANES + ord(chr(v).lower()) % 0x1900 if chr(v).isalpha() else SPACE for v in values.tolist()], np.uint16)
        out = table[np.where(high, SPACE, codes)]
        out[high] = to[np.searchsorted(values, codes[high])]
    else:
        out = table[codes]
    space = out == SPACE
    before = np.empty(len(out), bool)
    before[:1] = True
    before[1:] = space[:-1]
    begins = np.concatenate([[0], ends[:-1]])
    before[begins[begins < len(out)]] = True
    keep = ~(space & before)
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]


def grams(codes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Packed n-grams of orders 1 to ORDER that end at each position; before a text there are spaces."""
    wide = codes.astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
    out, packed = [wide], wide
    for back in range(1, ORDER):
        earlier = np.full(len(codes), SPACE, np.uint64)
        earlier[back:] = wide[:len(codes) - back]
        earlier[place < back] = SPACE
        packed = packed | (earlier << np.uint64(16 * back))
        out.append(packed)
    return out


# --- training ----------------------------------------------------------------------------------

def sample(docs: DataFrame, id_column: str, text: str, lang: str, allowed: Column, docs_each: int = SAMPLE_DOCS,
           chars_each: int = SAMPLE_CHARS) -> DataFrame:
    """id, lang, text, fold of at most docs_each whole texts of each language, chosen by a hash of the id.

    A language's rows are thinned by the hash before the exact cut, so a language with most rows sends no more than others.
    """
    rows = docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("order", F.xxhash64("id"))
    # Labels beyond the commonest MAX_LANGUAGES, dirt as a rule, are not learned; all texts are still scored.
    common = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = {r.lang: r.n for r in common.collect()}
    if len(counts) == MAX_LANGUAGES:
        rows = rows.filter(F.col("lang").isin(*counts))
    share = F.lit(1.0)
    for name, n in counts.items():
        if n > 2 * docs_each:
            share = F.when(F.col("lang") == name, 1.2 * docs_each / n + 50.0 / n).otherwise(share)
    rows = rows.filter(F.pmod("order", F.lit(1 << 30)) < share * (1 << 30))
    group = Window.partitionBy("lang").orderBy("order", "id", "text")
    rows = rows.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= docs_each)
    before = F.coalesce(F.sum(F.length("text")).over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).filter(F.col("before") < chars_each).select(
        "id", "lang", "text", F.pmod("rank", F.lit(CALIBRATION)).alias("fold"))


def count_language(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams of each order with their counts: tokens at the highest order, below it the distinct left extensions."""
    codes, bounds = normalise(texts)
    top, n = np.unique(grams(codes, bounds)[ORDER - 1], return_counts=True)
    out = [(top, n)]
    for order in range(ORDER - 1, 0, -1):
        longer = out[0][0]
        out.insert(0, np.unique(longer & np.uint64((1 << (16 * order)) - 1), return_counts=True))
    return out


@dataclass
class Model:
    """Merged models. keys[n]: sorted hashes of (n+1)-grams, logs[n]: their log10 probability in each language;
    contexts[n], backoff[n]: contexts of length n+1 and the log10 weight they leave to the shorter context."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    index: list[tuple[int, np.ndarray]]
    temperature: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: np.ndarray | float = np.inf  # for each language


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _language_tables(counts: list[tuple[np.ndarray, np.ndarray]]) -> list[dict[str, np.ndarray]]:
    """Per order: grams, count and, per context, total, number of successors and discount of one language."""
    out = []
    for order, (gram, n) in enumerate(counts, 1):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context, first = np.unique(gram >> np.uint64(16), return_index=True)
        out.append({"gram": gram, "n": n, "context": context, "total": np.add.reduceat(n, first).astype(float),
                    "kinds": np.diff(np.append(first, len(gram))).astype(float), "discount": min(max(discount, 0.1), 0.95), "order": order})
    return out


def merge(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], alphabet: int = 0) -> Model:
    """Evaluate every language's interpolated model on the n-grams that any language has seen; alphabet: its size where more languages count."""
    languages = sorted(counts)
    tables = {lang: _language_tables(counts[lang]) for lang in languages}
    alphabet = alphabet or len(np.unique(np.concatenate([counts[lang][0][0] for lang in languages]))) + 1
    union = [np.unique(np.concatenate([counts[lang][n][0] for lang in languages])) for n in range(ORDER)]
    logs = [np.empty((len(u), len(languages))) for u in union]
    contexts = [np.unique(u >> np.uint64(16)) for u in union[1:]]
    backoff = [np.zeros((len(c), len(languages))) for c in contexts]
    unseen = np.empty(len(languages))
    for column, lang in enumerate(languages):
        for n, table in enumerate(tables[lang]):
            gram = union[n]
            context = gram >> np.uint64(16)
            at, there = _find(table["gram"], gram)
            own = np.where(there, table["n"][at], 0)
            c_at, c_there = _find(table["context"], context)
            total, kinds, d = table["total"][c_at], table["kinds"][c_at], table["discount"]
            left = np.where(c_there, d * kinds / total, 1.0)
            if n == 0:
                lower = np.full(len(gram), 1 / alphabet)
                unseen[column] = np.log10(left[0] / alphabet)
            else:
                s_at, _ = _find(union[n - 1], gram & np.uint64((1 << (16 * n)) - 1))
                lower = 10 ** logs[n - 1][s_at, column]
            logs[n][:, column] = np.log10(np.where(c_there, np.maximum(own - d, 0) / total, 0) + left * lower)
            if n:
                at, there = _find(table["context"], contexts[n - 1])
                backoff[n - 1][:, column] = np.log10(np.where(there, d * table["kinds"][at] / table["total"][at], 1.0))
    keys, sorted_logs = [], []
    for gram, log in zip(union, logs):
        h = mix(gram)
        order = np.argsort(h)
        keys.append(h[order])
        sorted_logs.append(log[order].astype(np.float32))
    hashed, weights = [], []
    for context, weight in zip(contexts, backoff):
        h = mix(context)
        order = np.argsort(h)
        hashed.append(h[order])
        weights.append(weight[order].astype(np.float32))
    index = []
    for k in keys:  # where the hashes with the same leading bits begin, so that a look-up starts next to its place
        bits = min(20, max(4, int(np.ceil(np.log2(len(k)))) + 3))
        index.append((64 - bits, np.searchsorted(k, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)))
    return Model(languages, keys, sorted_logs, hashed, weights, unseen.astype(np.float32), index)


def _look_up(model: Model, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashes in the arrays of order n+1, and which are there."""
    keys, (shift, begin) = model.keys[n], model.index[n]
    last = len(keys) - 1
    at = np.minimum(begin[wanted >> np.uint64(shift)], last)
    there = keys[at] == wanted
    open_ = np.flatnonzero(~there & (keys[at] < wanted) & (at < last))
    while len(open_):
        at[open_] += 1
        there[open_] = keys[at[open_]] == wanted[open_]
        open_ = open_[(keys[at[open_]] < wanted[open_]) & (at[open_] < last)]
    return at, there


def entropies(model: Model, texts: list[str | None], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Per text: characters counted (0 without a letter) and the cross-entropy per character in each language."""
    codes, bounds = normalise(texts)
    total = np.zeros((len(texts), len(model.languages)))
    packed = grams(codes, bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for low in range(0, len(codes), chunk):
        part = slice(low, low + chunk)
        scores = np.empty((len(doc[part]), len(model.languages)), np.float32)
        todo, carried = np.arange(len(scores)), None
        for n in range(ORDER - 1, -1, -1):
            gram = packed[n][part][todo]
            at, there = _look_up(model, n, mix(gram))
            found = model.logs[n][at[there]]
            scores[todo[there]] = found if carried is None else found + carried[there]
            todo, gram = todo[~there], gram[~there]
            carried = np.zeros((len(todo), len(model.languages)), np.float32) if carried is None else carried[~there]
            if n and len(todo):
                at, known = _find(model.contexts[n - 1], mix(gram >> np.uint64(16)))
                carried[known] += model.backoff[n - 1][at[known]]
        scores[todo] = model.unseen + carried
        here, first = np.unique(doc[part], return_index=True)
        total[here] -= np.add.reduceat(scores, first, axis=0, dtype=np.float64)
    letters = np.concatenate([[0], np.cumsum(codes != SPACE)])
    n_letters = letters[bounds[1:]] - letters[bounds[:-1]]
    n = np.where(n_letters > 0, np.diff(bounds), 0)
    return n, total / np.maximum(n, 1)[:, None]


def _spread(n: np.ndarray) -> np.ndarray:
    """How much wider cross-entropy scatters in short texts."""
    return np.sqrt(1 + 100 / np.maximum(n, 1))


def _confidence(entropy: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    """Probability of the best language: a softmax over what the first couple of hundred characters would say."""
    z = -(entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(n, 200)[:, None] / temperature
    return 1 / np.exp(z).sum(axis=1)


def calibrate(model: Model, langs: list[str], n: np.ndarray, entropy: np.ndarray) -> list[str]:
    """Set the temperature of least log loss and the limit of rejection from scored texts that gave no counts.

    Returns the languages with fewer than RARE rightly predicted ones; calibrate_rare() sets their centre and spread.
    """
    own = np.array([model.languages.index(x) if x in model.languages else -1 for x in langs], int)
    use = (n > 0) & (own >= 0)
    n, entropy, own = n[use], entropy[use], own[use]
    model.centre, model.spread = np.full(len(model.languages), np.nan), np.full(len(model.languages), np.nan)
    z = np.zeros(len(n))
    if len(n):
        best, right = entropy.min(axis=1), entropy.argmin(axis=1) == own
        losses = []
        for t in np.geomspace(0.5, 200, 40):
            p = np.clip(_confidence(entropy, n, t), 1e-6, 1 - 1e-6)
            losses.append((-np.where(right, np.log(p), np.log(1 - p)).sum(), t))
        model.temperature = float(min(losses)[1])
        for i in range(len(model.languages)):
            mine = (own == i) & right
            if mine.sum() >= RARE:
                model.centre[i] = np.median(best[mine])
                model.spread[i] = max(0.02, 1.4826 * np.median(np.abs(best[mine] - model.centre[i])))
                z[mine] = (best[mine] - model.centre[i]) / (model.spread[i] * _spread(n[mine]))
    # Half as far again as all but the oddest hundredth of a language's own texts: one odd label moves neither its own limit nor another's.
    limits = [float(np.quantile(z[own == i], 0.99)) if (own == i).any() else 0.0 for i in range(len(model.languages))]
    model.limit = 1.5 * np.maximum(8.0, np.array(limits))
    return [x for x, c in zip(model.languages, model.centre) if np.isnan(c)]


def cross_entropies(texts: list[str], alphabet: int, folds: int = CALIBRATION) -> tuple[np.ndarray, np.ndarray]:
    """Characters and cross-entropy of one language's texts, each scored by a model of the others, in at most `folds` parts.

    A single text is cut into halves that score each other.
    """
    texts = [t for t in texts if (normalise([t])[0] != SPACE).any()]
    if len(texts) == 1:
        half = len(texts[0]) // 2
        texts = [t for t in (texts[0][:half], texts[0][half:]) if (normalise([t])[0] != SPACE).any()]
    if len(texts) < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    sizes, found = [], []
    for fold in range(min(folds, len(texts))):
        others = [t for i, t in enumerate(texts) if i % folds != fold]
        n, entropy = entropies(merge({"": count_language(others)}, alphabet), texts[fold::folds])
        sizes.append(n)
        found.append(entropy[:, 0])
    return np.concatenate(sizes), np.concatenate(found)


def calibrate_rare(model: Model, scored: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
    """Centre and spread of languages with few calibration texts, from cross_entropies() of all their texts.

    With fewer than RARE of them the spread is that of the other languages at least. Where there is none, the centre is pooled too.
    """
    known = ~np.isnan(model.centre)
    centre = float(np.median(model.centre[known])) if known.any() else math.log10(len(model.keys[0]) + 1) / 2
    spread = float(np.median(model.spread[known])) if known.any() else 0.02
    for i in np.flatnonzero(~known):
        n, entropy = scored.get(model.languages[i], (np.zeros(0), np.zeros(0)))
        model.centre[i] = np.median(entropy) if len(n) else centre
        scatter = 1.4826 * np.median(np.abs(entropy - model.centre[i]) / _spread(n)) if len(n) else 0.0
        model.spread[i] = max(0.02, scatter, spread if len(n) < RARE else 0.0)


def train(docs: DataFrame, id_column: str, text: str, lang: str, allowed: Column) -> Model | None:
    """Count in one task for each language over the bounded sample; merge and calibrate the arrays, whose size the sample bounds."""
    chosen = sample(docs, id_column, text, lang, allowed)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values("id")
        counted = texts[texts["fold"] != 0]["text"].tolist() or texts["text"].tolist()
        rows = [(pdf["lang"].iloc[0], n, gram.tobytes(), c.astype(np.int64).tobytes()) for n, (gram, c) in enumerate(count_language(counted))]
        return pd.DataFrame(rows, columns=["lang", "n", "gram", "counts"])

    counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    rows = chosen.groupBy("lang").applyInPandas(count, "lang string, n int, gram binary, counts binary").collect()
    for r in sorted(rows, key=lambda r: r.n):
        gram, n = np.frombuffer(bytes(r.gram), np.uint64), np.frombuffer(bytes(r["counts"]), np.int64)
        if len(gram):
            counts.setdefault(r.lang, []).append((gram, n))
    if not counts:
        return None
    model = merge(counts)
    each = max(20, 2_000 // len(counts))  # of each language, for the driver's share of the work
    left_out = (chosen.filter("fold = 0").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(7)), "id", "text")))
                .filter(F.col("rank") <= each).select("lang", "id", "text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, entropy = entropies(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n, pa.int64()), pa.array(list(entropy.astype(np.float64)), pa.list_(pa.float64()))],
                                             ["lang", "n", "entropy"])

    scored = left_out.mapInArrow(score, "lang string, n long, entropy array<double>").collect()
    rare = calibrate(model, [r.lang for r in scored], np.array([r.n for r in scored], np.int64),
                     np.array([r.entropy for r in scored], float).reshape(len(scored), len(model.languages)))
    if rare:
        alphabet = len(model.keys[0]) + 1

        def cross(pdf: pd.DataFrame) -> pd.DataFrame:
            n, entropy = cross_entropies(pdf.sort_values(["id", "text"])["text"].tolist(), alphabet)
            return pd.DataFrame({"lang": pdf["lang"].iloc[0], "n": n, "entropy": entropy})

        few = chosen.filter(F.col("lang").isin(rare)).groupBy("lang").applyInPandas(cross, "lang string, n long, entropy double").collect()
        by_lang: dict[str, list[tuple[int, float]]] = {}
        for r in few:
            by_lang.setdefault(r.lang, []).append((r.n, r.entropy))
        calibrate_rare(model, {x: tuple(np.array(sorted(v), float).T) for x, v in by_lang.items()})
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The table with lang_pred, score (0 to 1), rejected and entropy (of the predicted language, per character)."""
    names = fresh(docs, "lang_pred", "score", "rejected", "entropy")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            size = batch.num_rows
            if model is None:
                lang, score, rejected, best = [UND] * size, np.zeros(size), np.ones(size, bool), np.zeros(size)
            else:
                n, entropy = entropies(model, batch.column(batch.schema.get_field_index(text)).to_pylist())
                pick, best = entropy.argmin(axis=1), entropy.min(axis=1)
                lang = [model.languages[i] if k else UND for i, k in zip(pick.tolist(), n.tolist())]
                score = np.where(n > 0, _confidence(entropy, n, model.temperature), 0.0)
                far = (best - model.centre[pick]) / (model.spread[pick] * _spread(n)) > np.broadcast_to(model.limit, len(model.languages))[pick]
                rejected, best = (n == 0) | far, np.where(n > 0, best, 0.0)
            extra = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType(), T.DoubleType())
    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]]))
