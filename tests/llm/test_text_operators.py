"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import chosen_path, language_id, license_scan, line_crf, maxent_lm, queries, secret_ledger
from panelwright.llm.common import windows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n\t ", "one", "two words", "a\x0bb\x0cc\rd", "é ü x \U0001F600 ok", "x" * 50_000, "word " * 3_000]


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


# --- words ---------------------------------------------------------------------------------------

def test_words_agree_with_a_pattern_and_hash_alike_everywhere():
    texts = pa.array([*ODD, "The the THE", "the"]).slice(0)
    w = words(texts, lower=True)
    expected = [WORD.findall(t or "") for t in texts.to_pylist()]
    assert w.count.tolist() == [len(e) for e in expected]
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert got == [x for e in expected for x in e]
    by_hash = collections.defaultdict(set)
    for x, h in zip(got, w.hash.tolist()):
        by_hash[h].add(re.sub("[A-Z]", lambda m: m[0].lower(), x))
    assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len({y for v in by_hash.values() for y in v})
    assert words(texts.slice(3, 4)).hash.tolist() == words(pa.array(texts.to_pylist()[3:7])).hash.tolist()


def test_windows_of_short_texts_are_the_text():
    w = words(pa.array(["a b", "a b c d e f", "", "a b"]))
    hashes, place = windows(w, 5)
    assert len(hashes) == 1 + 2 + 0 + 1 and hashes[0] == hashes[3]


# --- secrets -------------------------------------------------------------------------------------

def brute_base(text: str | None) -> tuple[int, int, int, str]:
    text, spans = text or "", []
    for i, (kind, pattern, flags, group, least) in enumerate([
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 0, 20), ("hex", r"[0-9a-f]+", 0, 0, 24)]):
        spans += [(m.start(), i, kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    n = collections.Counter(s[2] for s in spans)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()


SECRETS = [
    'Password = "abc"', "token: abcdef", "é API_KEY='a+/b_c.d=' and apikey:short", "secret: token:abcdefgh", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 12 + "z", "0" * 23,
    "0" * 24 + "g" + "f" * 30, "paſsword=abcdefg", "toKen=abcdefg", "password=" + "a1" * 20_000, "x" * 100_000 + " token=0123456789abcdef0123456789abcdef",
    "-----BEGIN RSA PRIVATE KEY----- eyJhbGciOi.eyJzdWIiOiIx.abcdefghijkl", *ODD]


def test_secret_ledger_matches_a_direct_scan(spark):
    texts = [*SECRETS, *SECRETS[:4], SECRETS[1]]
    df = spark.createDataFrame([(i if i != 3 else None, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, blob string")
    found = secret_ledger.scan(df)
    name = found.columns[-1]
    out = found.select("doc_id", "blob", *[secret_ledger.count_of(F.col(name), k).alias(k) for k in secret_ledger.BASE_KINDS],
                       F.sha2(secret_ledger.in_order(F.col(name), secret_ledger.BASE_KINDS), 256).alias("sha"), secret_ledger.in_order(F.col(name)).alias("spans")).collect()
    assert len(out) == len(texts) and all(r.blob == "b" for r in out)
    for r in out:
        text = texts[3 if r.doc_id is None else r.doc_id]
        assert (r.assign, r.access, r.hex, r.sha) == brute_base(text), text
    assert any("jwt" in r.spans and "pem" in r.spans for r in out)
    assert secret_ledger.scan(df.limit(0)).count() == 0


def test_ledger_scans_only_unseen_blobs(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    old = spark.createDataFrame([("a", "token=abcdef"), ("b", "token=abcdef"), ("c", None)], "path string, text string")
    secret_ledger.update(old, ledger, first=True)
    assert spark.read.parquet(ledger).count() == 2
    new = old.union(spark.createDataFrame([("d", "secret=ghijkl"), ("e", "token=abcdef")], "path string, text string"))
    secret_ledger.update(new, ledger)
    assert spark.read.parquet(ledger).count() == 3
    secret_ledger.update(new, ledger, rules="another")
    assert spark.read.parquet(ledger).count() == 6
    assert {r.path: len(r.findings) for r in secret_ledger.findings(new, ledger).collect()} == {"a": 1, "b": 1, "c": 0, "d": 1, "e": 1}


def test_redaction_blanks_every_span(spark):
    df = spark.createDataFrame([("é token=abcdef, AKIA" + "Q" * 16 + " end",), ("clean",), (None,)], "text string")
    found = secret_ledger.scan(df, keep_text=True)
    out = {r.text: r.out for r in found.select("text", secret_ledger.redact(F.col("text"), F.col(found.columns[-1])).alias("out")).collect()}
    assert out["clean"] == "clean" and out[None] is None
    assert [v for k, v in out.items() if k and k[0] == "é"] == ["é [assign], [access] end"]


KEY = [f"{i}MIIEvQ+/" + "aB3x" * 14 for i in range(4)] + ["Zz9k3Q=="]


def test_no_key_body_survives_redaction(spark):
    begins, texts = ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"], []
    for begin in begins:
        for between in ("\n", "\r\n", "\\n", " ", "\n# ", "\n    // ", '" +\n  "'):
            for closed in (True, False):
                header = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B2C"] if between == "\n" else []
                key = between.join([begin, *header, *KEY] + [begin.replace("BEGIN", "END")] * closed)
                texts.append(f"é before\n{key}\nafter it stays\n{begin}\n{KEY[0]}\n-----BEGIN CERTIFICATE-----\nmine\n{begin} is a marker only")
    found = secret_ledger.scan(spark.createDataFrame([(t,) for t in texts], "text string"), keep_text=True)
    for text, out in found.select("text", secret_ledger.redact(F.col("text"), F.col(found.columns[-1]))).collect():
        assert not any(line in out for line in KEY) and "DEK-Info" not in out and "PRIVATE KEY" not in out, text
        assert re.fullmatch(r"é before\n\[pem\]\nafter it stays\n\[pem\]\n-----BEGIN CERTIFICATE-----\nmine\n\[pem\] is a marker only", out), (text, out)


ADVERSE = {
    "headers": "-----BEGIN RSA PRIVATE KEY-----" + "A: b " * 200_000, "header lines": "-----BEGIN RSA PRIVATE KEY-----" + "A: b\n" * 200_000, "one run": "eyJ" * 350_000,
    "runs": "eyJa." * 200_000, "short runs": ".eyJ" * 250_000, "markers": "-----BEGIN RSA PRIVATE KEY-----" * 30_000, "open marker": "-----BEGIN " + "A " * 500_000,
    "gaps": "-----BEGIN PRIVATE KEY-----" + "\\n" * 500_000, "names": "-----BEGIN PRIVATE KEY-----" + "Ab-" * 300_000, "signs": "+ " * 500_000, "spaces": "token" + " " * 1_000_000,
    "values": "password=abcdefg\n" * 60_000}


@pytest.mark.parametrize("name", ADVERSE)
def test_no_text_holds_a_scan_up(name):
    text = ADVERSE[name]
    start = time.process_time()
    found = secret_ledger.scan_text(text)
    out = secret_ledger.redacted(text, found)
    assert time.process_time() - start < 5  # a second or less on an idle machine; the forms it replaces would take hours
    assert len(found) == (60_000 if name == "values" else 30_000 if name == "markers" else 1 if "PRIVATE KEY" in text else 0)
    assert name != "values" or out == "[assign]\n" * 60_000


def test_web_tokens_are_those_of_the_pattern():
    rng = random.Random(12)
    pattern = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
    for _ in range(20_000):
        text = "".join(rng.choice(["eyJ", "eyJhbGciOiJI", ".", "abc", "-", "_", " ", "é", "A" * 20]) for _ in range(rng.randrange(12)))
        want = [m.span() for m in pattern.finditer(text) if m.end() - m.start() >= 30]
        assert [(f["start"], f["end"]) for f in secret_ledger.scan_text(text) if f["kind"] == "jwt"] == want, text


def test_overlapping_spans_become_one():
    spans = [{"start": a, "end": b, "kind": k} for a, b, k in [(2, 5, "x"), (4, 8, "y"), (8, 9, "z"), (6, 7, "w")]]
    assert secret_ledger.redacted("0123456789", spans) == "01[x][z]9"


# --- near duplicates -----------------------------------------------------------------------------

def shingles(text: str | None) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(docs: list[tuple]) -> list[tuple]:
    sets = [shingles(t) for _, t in docs]
    parent, links = list(range(len(docs))), [0] * len(docs)

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        root = find(i)
        least[root] = min((x for x in (least.get(root), doc) if x is not None), default=None)
    return sorted(((doc, t, least[find(i)], links[i]) for i, (doc, t) in enumerate(docs)), key=str)


def test_a_tile_with_itself_counts_what_is_shared():
    rng = np.random.RandomState(5)
    sets = [np.unique(rng.randint(0, 200, 40).astype(np.uint32)) for _ in range(50)]
    got = chosen_path._shared(sets, sets)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == want[off]).all()
    assert (chosen_path._shared(sets[:20], sets[20:]) == want[:20, 20:]).all()


def family(rng: random.Random, n: int, size: int, changes: int) -> list[str]:
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(size)] = f"c{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def near_fixture() -> list[tuple]:
    rng = random.Random(3)
    texts = [*family(rng, 60, 120, 3), *family(rng, 25, 40, 2), *family(rng, 3, 800, 20), *family(rng, 4, 5, 1), *family(rng, 2, 3, 0)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) for _ in range(40)]
    texts += texts[:7] * 3 + [t.replace(" ", "  ") for t in texts[:3]] + ODD
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(2, texts[2]), (2, texts[2])]


@pytest.mark.parametrize("limits", [{}, {"leaf": 6, "tile": 8, "tile_tokens": 3_000}, {"leaf": 4, "tile": 1_000}])
def test_near_duplicates_equal_all_pairs(spark, limits):
    docs = near_fixture()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, node int, path int")
    found = chosen_path.near_duplicates(df, recall=0.9995, **limits)
    got = found.join(spark.createDataFrame(docs, "doc_id long, text string").dropDuplicates().select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text"),
                     found["doc_id"].eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_links(docs)


def test_keep_one_of_each_class(spark):
    docs = near_fixture()
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, source string")
    kept = [tuple(r) for r in chosen_path.keep_one(df).select("doc_id", "text").collect()]
    classes = collections.defaultdict(list)
    wordless = [d for d in docs if not shingles(d[1])]
    for doc, text, least, n in brute_links(docs):
        if shingles(text):
            classes[(least, n if least is None else None)].append(doc)
    assert len([k for k in kept if not shingles(k[1])]) == len(wordless)
    ids = collections.Counter(k[0] for k in kept if shingles(k[1]) and k[0] is not None)
    assert max(ids.values()) == 1 and set(ids) == {c[0] for c in classes if c[0] is not None}


def test_near_duplicates_of_an_empty_table(spark):
    assert chosen_path.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_reach_the_recall():
    runs = chosen_path.runs_for(0.8, 0.9995, chosen_path.DEPTH)
    assert (1 - chosen_path.survival(0.8, chosen_path.DEPTH)) ** runs <= 0.0005
    assert chosen_path.root_picks(0.8, runs) < chosen_path.HASHES


# --- language model ------------------------------------------------------------------------------

def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_base_scores_are_exact_and_the_model_is_better(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    tokens = {d: [*WORD.findall(lower(t or "")), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = collections.Counter(x for d, t in tokens.items() if not held[d] for x in t)
    n, v = sum(count.values()), len(count)
    base = model = 0.0
    for r in queries.queries()["op4_maxent_lm"](spark, sf).collect():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(x in count for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own), rel=1e-9)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def test_model_is_a_distribution_and_odd_rows_are_scored(spark):
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate([*ODD, *ODD, "b a c a b", "a b a b c d"])], "doc_id long, text string")
    model, counts = maxent_lm.train(docs, F.col("doc_id"), rounds=2)
    out = maxent_lm.score(docs, model, counts).collect()
    assert len(out) == 2 * len(ODD) + 2 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    seen = {r.word: r.n for r in counts.collect()}
    t = maxent_lm.tokens(pa.array(["a b"]))
    last = maxent_lm.Tokens(t.hash[:2], np.array([0, 2]))
    total = 0.0  # words seen and one unknown word in each bucket, after the context "a"
    logs = {}
    for b in range(maxent_lm.BUCKETS):
        cls, member = divmod(b, maxent_lm.MEMBERS)
        rows = [(f[1:2] & np.uint64(maxent_lm.ROWS - 1)).astype(np.int64) for f in maxent_lm.features(last)]
        m = [(maxent_lm.mix(f[1:2] + np.uint64(cls)) & np.uint64(maxent_lm.ROWS - 1)).astype(np.int64) for f in maxent_lm.features(last)]
        x, y = maxent_lm._scores(model, np.array([cls]), rows, m)
        logs[b] = maxent_lm._softmax(x)[0][0, cls] * maxent_lm._softmax(y)[0][0, member]
    for word, n in seen.items():
        b = int(maxent_lm.bucket(np.array([word], np.int64).view(np.uint64))[0])
        total += logs[b] * (n + 1) / 10 ** model.size[b]
    total += sum(p / 10 ** model.size[b] for b, p in logs.items())
    assert total == pytest.approx(1, abs=1e-4)
    extra = docs.select("doc_id", "text", F.lit("kept").alias("Score"), F.lit(1).alias("row"), F.lit(2).alias("more_logs"), F.lit(3).alias("word"), F.lit(4).alias("times"))
    clashing = maxent_lm.score(extra, model, counts)
    assert clashing.columns == ["doc_id", "Score", "row", "more_logs", "word", "times", "n_tokens", "n_known", "base_score", "score_"]
    assert sorted(r.score_ for r in clashing.collect()) == pytest.approx(sorted(r.score for r in out))
    assert {(r.Score, r.row, r.more_logs, r.word, r.times) for r in clashing.collect()} == {("kept", 1, 2, 3, 4)}
    empty = docs.limit(0)
    none, no_counts = maxent_lm.train(empty, F.col("doc_id"))
    assert none.n_tokens == 0 and maxent_lm.score(empty, none, no_counts).count() == 0 and maxent_lm.score(docs, none, no_counts).count() == 2 * len(ODD) + 2


# --- languages -----------------------------------------------------------------------------------

def test_languages_of_held_out_texts(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries.queries()["op7_language_id"](spark, sf).collect()
    assert len(out) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and sum(r.rejected for r in out) <= 0.01 * len(out)


def test_kneser_ney_is_a_distribution():
    counts = {"x": language_id.count_language(["abab abba cab", "bca"]), "y": language_id.count_language(["zzz aaz"])}
    model = language_id.merge(counts)
    letters = sorted({c for lang in counts for c in counts[lang][0][0].tolist()})
    for history in ("ab", "a", "zq", ""):
        total = np.zeros(2)
        for c in letters:
            text = history + chr(c)
            n, e = language_id.entropies(model, [text])
            n0, e0 = language_id.entropies(model, [history]) if history else (np.array([0]), np.zeros((1, 2)))
            if c != 32:
                total += 10 ** -(e[0] * n[0] - e0[0] * n0[0])
            else:
                total += 10 ** -(e_space(model, history))
        total += 10 ** -(e_unseen(model, history))
        assert total == pytest.approx([1, 1], abs=1e-4)


def e_space(model, history: str):
    """A space after the history, scored by the arrays' own rules (a text keeps single inner spaces)."""
    if not history:
        return -scored(model, [32, 32, 32, 32])
    n, e = language_id.entropies(model, [history + " "])
    n0, e0 = language_id.entropies(model, [history])
    return e[0] * n[0] - e0[0] * n0[0]


def e_unseen(model, history: str):
    n, e = language_id.entropies(model, [history + "Ж"])
    n0, e0 = language_id.entropies(model, [history]) if history else (np.array([0]), np.zeros((1, 2)))
    return e[0] * n[0] - e0[0] * n0[0]


def scored(model, codes: list[int]):
    total = np.zeros(len(model.languages))
    for n in range(language_id.ORDER - 1, -1, -1):
        gram = 0
        for c in codes[-n - 1:]:
            gram = gram << 16 | c
        at, there = language_id._look_up(model, n, language_id.mix(np.array([gram], np.uint64)))
        if there[0]:
            return total + model.logs[n][at[0]]
        if n:
            at, known = language_id._find(model.contexts[n - 1], language_id.mix(np.array([gram >> 16], np.uint64)))
            total = total + (model.backoff[n - 1][at[0]] if known[0] else 0)
    return total + model.unseen


def test_texts_without_letters_are_undetermined(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["der", "und", "nicht", "the", "and", "not"][3 * (i % 2):][:3]) for _ in range(60)), ["de", "en"][i % 2], "x") for i in range(200)]
    odd = [(1_000 + i, t, None, "x") for i, t in enumerate([*ODD, "123 $$$ 45", "中文 文字", "\U00010400\U00010401"])] + [(None, "der und", "de", "x"), (5, "and the", "en", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = language_id.train(df, "doc_id", "text", "lang", F.lit(True))
    out = language_id.identify(df, model)
    found = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred", "score_", "rejected", "entropy"] and out.count() == len(rows) + len(odd)
    assert [found[1_000 + i].lang_pred for i in (0, 1, 2, len(ODD))] == ["und"] * 4 and found[1_000].rejected and found[1_000].score_ == 0
    assert all(found[i].lang_pred == ["de", "en"][i % 2] and not found[i].rejected for i in range(200))
    assert found[1_000 + len(ODD) + 1].rejected  # a script that no language has
    assert {r.lang_pred for r in language_id.identify(df, language_id.train(df, "doc_id", "text", "lang", F.lit(False))).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.entropies(model, ["der und " * 9_000], chunk=1_000)[1] == pytest.approx(language_id.entropies(model, ["der und " * 9_000])[1])


def test_a_rare_language_rejects_what_is_foreign(spark):
    rng = random.Random(4)
    de, en, fr = "der und nicht das ein mit".split(), "the and not with from this".split(), "le vous nous être avec pour".split()
    text = lambda of: " ".join(rng.choice(of) for _ in range(60))
    foreign = ["".join(chr(rng.randrange(low, low + 40)) for _ in range(200)) for low in (0x4E00, 0x0430, 0x05D0, 0x3041)]
    foreign += ["".join(rng.choice("qxzjkvwp") for _ in range(200)) for _ in range(3)]
    for labelled in (0, 60):  # others with enough texts, or rare languages alone
        for texts in ([text(fr) for _ in range(3)], [" ".join(text(fr) for _ in range(20))]):
            rows = [(i, t, "fr") for i, t in enumerate(texts)]
            rows += [(100 + i, text((de, en)[i % 2]), ("de", "en")[i % 2]) for i in range(labelled)]
            own = [(1_000 + i, text(fr), None) for i in range(10)]
            df = spark.createDataFrame(rows + own + [(2_000 + i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string")
            model = language_id.train(df, "doc_id", "text", "lang", F.lit(True))
            assert np.isfinite(model.centre).all() and np.isfinite(model.spread).all()
            found = {r.doc_id: r for r in language_id.identify(df, model).collect()}
            assert all(found[2_000 + i].rejected for i in range(len(foreign)))
            assert all(found[k].lang_pred == "fr" and not found[k].rejected for k in [r[0] for r in rows + own if r[2] != "de" and r[2] != "en"])


# --- lines ---------------------------------------------------------------------------------------

def brute_counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_of_texts(spark, sf):
    texts = [*ODD, "a\na\n a\n\n\nb b\nb b", "# $ <x>\n" * 3, "a b c d e f g h a b c d e f g h i", "a " * 9, "éé |\n" * 40, "x\ny\n", "\n"]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    out = line_crf.judge(df, line_crf.Chain(np.zeros(line_crf.N_BINS), np.zeros((2, 2)), 0.0))
    assert out.columns[-1] == "kept_" and out.columns[2] == "kept"
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept_ == (not r.base_failed)


def test_verdicts_agree_with_labels(spark, sf):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in queries.queries()["op8_line_crf"](spark, sf).collect() if r.doc_id in quality and not r.base_failed]
    assert sum(r.kept for r in out if quality[r.doc_id]) >= 0.97 * sum(quality[r.doc_id] for r in out)
    assert not any(r.kept for r in out if not quality[r.doc_id])


def test_viterbi_equals_trying_all_labels():
    rng = np.random.RandomState(2)
    for _ in range(30):
        chain, scores = line_crf.Chain(np.zeros(1), rng.randn(2, 2)), rng.randn(rng.randint(1, 8)).tolist()
        best = max((sum(s * y for s, y in zip(scores, ys)) + sum(chain.step[a, b] for a, b in zip(ys, ys[1:])), ys)
                   for ys in ([int(c) for c in f"{k:0{len(scores)}b}"] for k in range(2 ** len(scores))))
        assert line_crf.decode(chain, scores) == best[1]


def test_lines_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    chain = line_crf.train(docs, labels)
    assert not chain.weights.any() and line_crf.judge(docs, chain).count() == 3 and line_crf.judge(docs.limit(0), chain).count() == 0


# --- licences ------------------------------------------------------------------------------------

def test_licences_are_found_and_clean_texts_left(spark, sf):
    notices = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
               "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary"}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.queries()["op1_license_scan"](spark, sf).collect()
    assert len(out) == len(text)
    for r in out:
        expected = {f for notice, f in notices.items() if notice in text[r.doc_id]}
        assert set(filter(None, r.families.split(","))) == expected and (r.license in expected if expected else r.license == "none")


def test_licence_variations_and_odd_texts(spark):
    model = license_scan.fit([["a", "text", "about", "the", "weather"], ["free", "software", "is", "nice"]])
    cases = {"# Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
             "Redistributions of source code must retain the above copyright notice, this list of conditions": "bsd",
             "// SPDX-License-Identifier: MPL-2.0": "mpl", "the rights of the people": None, "license": None, "This program is fun and easy to use for any person": None}
    for text, family in cases.items():
        assert [x["family"] for x in license_scan.scan_text(model, text)] == ([family] if family else []), text
    rows = [*ODD, "x\n\nReleased under the MIT License.\ny", "z " * 5_000 + "Released under the MIT License. " + "q " * 5_000]
    df = spark.createDataFrame([(i % 3 or None, t, "l") for i, t in enumerate(rows)], "doc_id long, text string, licences string")
    out = license_scan.scan(df, model)
    assert out.columns[-1] == "licences_" and out.count() == len(rows) and license_scan.scan(df.limit(0), model).count() == 0
    found = [r.licences_ for r in out.collect() if r.licences_]
    assert sorted([(x.line, x.family) for x in f] for f in found) == [[(0, "mit")], [(2, "mit")]]
    assert license_scan.train(df.limit(0)).families


def test_every_licence_of_one_line_is_found():
    model = license_scan.fit([["a", "text", "about", "the", "weather"], ["free", "software", "is", "nice"]])
    mit, gpl = license_scan.TEMPLATES["mit"][0], license_scan.TEMPLATES["gpl"][0]
    text = "z\n" + "z " * 500 + mit + " q" * 500 + " " + gpl + " q" * 100
    found = license_scan.scan_text(model, text)
    assert [(x["line"], x["family"]) for x in found] == [(1, "mit"), (1, "gpl")]
    assert all(x["start"] <= text.index(notice) + 40 and x["end"] >= text.index(notice) + len(notice) - 60 and x["end"] - x["start"] < 2 * len(notice)
               for x, notice in zip(found, (mit, gpl)))
    both = {"Licensed under the MIT License or the Apache License, Version 2.0": ["apache", "mit"],
            "Dual licensed under the MIT License and the GNU General Public License, version 3.": ["gpl", "mit"]}
    for line, families in both.items():
        assert [x["family"] for x in license_scan.scan_text(model, line)] == families, line
    rest = "; either version {} of the License, or (at your option) any later version. This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"
    for family, version, what in (("agpl", "3", "program"), ("lgpl", "2.1", "library")):
        assert [x["family"] for x in license_scan.scan_text(model, license_scan.TEMPLATES[family][0] + rest.format(version, what))] == [family]


def test_notices_of_other_licences_are_unknown(spark, tmp_path):
    notices = ["Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "# Distributed under the Boost Software License, Version 1.0.",
               "This program is made available under the terms of the Artistic License", "This software is released under the zlib license",
               "z " * 300 + "Licensed under the Eclipse Public License 2.0" + " z" * 300]
    clean = ["the rights of the people", "He lost his driving license under the new law.", "A license is needed.", "permission was denied", "", None]
    mixed = ["Released under the MIT License.\nSPDX-License-Identifier: EPL-2.0"]
    rows = [(i, t) for i, t in enumerate(notices + clean + mixed)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.queries()["op1_license_scan"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        expected = ("unknown", "unknown") if text in notices else ("none", "") if text in clean else ("mit", "mit,unknown")
        assert (out[i].license, out[i].families) == expected, text
    assert all(out[i].n_paragraphs == 1 and 0 <= out[i].probability <= 1 for i in range(len(notices)))


def test_a_few_wrong_labels_leave_the_threshold():
    rng = random.Random(8)
    good, bad = [rng.uniform(0.8, 1) for _ in range(340)], [rng.uniform(0, 0.1) for _ in range(300)]
    assert line_crf.keep_threshold(good, bad) == line_crf.keep_threshold([*good, 0.0, 0.0, 0.01, 0.02, 0.0], [*bad, 1.0, 0.9]) == 0.5
    assert line_crf.keep_threshold([], bad) == 0.0 and line_crf.keep_threshold(good, []) == 0.5
    assert line_crf.keep_threshold([0.3] * 50 + good, bad) <= 0.3  # many good texts of little content are worth more than some bad ones


def test_one_odd_text_moves_no_language_s_limit(spark):
    rng = random.Random(9)

    def text(letters: str) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(80))

    rows = [(i, text(letters), lang) for k, (lang, letters) in enumerate((("aa", "abcdeio"), ("bb", "uvwxyst"))) for i in range(1_000 * k, 1_000 * k + 300)]
    foreign = [(5_000 + i, text("βγδεζη"), None) for i in range(20)]
    odd = [(9_000 + i, text("#0é1"), "aa") for i in range(1)]
    df = spark.createDataFrame(rows + odd + foreign, "doc_id long, text string, lang string")
    model = language_id.train(df, "doc_id", "text", "lang", F.lit(True))
    assert np.all(np.asarray(model.limit) <= 1.5 * 12)
    found = {r.doc_id: r.rejected for r in language_id.identify(df, model).collect()}
    assert not any(found[i] for i, _, _ in rows) and all(found[i] for i, _, _ in foreign)
