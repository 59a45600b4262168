"""Conversation repair, byte-level BPE and spelling variants against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import functools
import hashlib
import random
import re
import sys
import zlib

import public_tokenizers
import pytest
import regex
import tiktoken

from panelwright.llm import byte_bpe, dialogue_repair, pivotal_grams, queries


sys.setrecursionlimit(5_000)  # the brute force goes down a row at a time


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


# --- conversations -------------------------------------------------------------------------------

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out[conv]
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        held += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def brute_repair(rows):
    """Every way by memoised recursion: least cost, then least audit."""
    faults, seen = [], set()
    for _, role, text in rows:
        left = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if inserts < 2:
            c, a, out = best(i, NEXT[state], inserts + 1)
            ways.append((c + 5, "I" + a, ({"u": "user:", "a": "assistant:"}[NEXT[state]], *out)))
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
            return min(ways, default=(10**9, "", ()))
        _, role, text = rows[i]
        c, a, out = best(i + 1, state, 0)
        ways.append((c + 2, "D" + a, out))
        if faults[i] not in ("blank", "duplicate"):
            extra = 5 if faults[i] == "truncated" else 0
            initial = role[:1]
            if initial and (initial == NEXT[state] or (initial == "s" and state == "")):
                c, a, out = best(i + 1, initial, 0)
                ways.append((c + extra, "K" + a, (f"{role}:{text}", *out)))
            for to in "ua":
                if to == NEXT[state]:
                    c, a, out = best(i + 1, to, 0)
                    ways.append((c + extra + 1, "R" + a, ({"u": "user", "a": "assistant"}[to] + ":" + text, *out)))
        return min(ways, key=lambda w: (w[0], w[1]), default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = sorted({r[0] for r in rows if r[0] is not None})
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {"gaps": turns[-1] - turns[0] + 1 - len(turns) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"),
            "truncated": faults.count("truncated"), "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def talks(seed: int, n: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(n)]:
        for turn in [*([None] if rng.random() < 0.2 else []), *range(rng.randrange(longest))]:
            role = rng.choice(["user", "assistant"] * 6 + ["system", None, "", "tool", "unknown"])
            text = rng.choice(["Yes.", "No!", "cut", "  ", "", None, "a b.\n", "why?", f"t{rng.randrange(9)}.", f"é{rng.randrange(99)}"])
            for _ in range(2 if rng.random() < 0.1 else 1):
                out.append((conv, turn, role, text))
                if rng.random() < 0.05:
                    out.append((conv, turn, rng.choice(["user", "assistant"]), "other."))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [3, 4_096])
def test_repairs_are_the_least_of_all(spark, block):
    rows = talks(block, 60, 14)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.pop("conv_id"): r for r in rows_of(dialogue_repair.repair(dialogue_repair.damage(df), block_rows=block))}
    want = {c: brute_repair(x) for c, x in brute_damage(rows).items()}
    assert got == want


def test_one_conversation_over_many_tasks_and_blocks(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}.", f"{t}!", " "])) for t in range(250)] + [(9, 1, "user", "x.")] * 50
    got = {r.pop("conv_id"): r for r in rows_of(dialogue_repair.repair(dialogue_repair.damage(spark.createDataFrame(rows, SCHEMA)), block_rows=16))}
    assert got == {c: brute_repair(x) for c, x in brute_damage(rows).items()}


def test_checkpoints_change_nothing():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 17, 60):
        rows = [(rng.choice("uas?"), rng.random() < 0.3) for _ in range(n)]
        vectors = [dialogue_repair.END]
        for row in reversed(rows):
            vectors.append(dialogue_repair.before(row, vectors[-1]))
        assert dialogue_repair.through(rows, dialogue_repair.END) == vectors[-1]
        costs = dialogue_repair.steps(rows)
        ahead = [min(costs[4 * s + t] + dialogue_repair.END[t] for t in range(4)) for s in range(4)]
        assert dialogue_repair.closed(ahead) == vectors[-1]


def test_repair_of_empty_tables_dropped_rows_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(dialogue_repair.repair(dialogue_repair.damage(empty))) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.", 1, 2)], SCHEMA + ", again int, conv int")
    got = rows_of(dialogue_repair.repair(dialogue_repair.damage(df)))
    assert got == [{"conv_id": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
                    "repaired_sha256": hashlib.sha256(b"").hexdigest()}]
    text = "word " * 200_000 + "."
    one = spark.createDataFrame([(1, 3, "user", text), (1, 5, "assistant", "ok.")], SCHEMA)
    assert {r["conv_id"]: r for r in rows_of(dialogue_repair.repair(one))}[1] == {"conv_id": 1} | brute_repair([(3, "user", text), (5, "assistant", "ok.")])


def test_repair_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.pop("conv_id"): r for r in rows_of(queries.queries()["op11_dialogue_repair"](spark, sf))}
    assert got == {c: brute_repair(x) for c, x in brute_damage(rows).items()} and len(got) > 10


# --- byte-level BPE ------------------------------------------------------------------------------

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PARTS = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'re", "é", "ü", "1", "23", "!", "--", "\U0001F600", "中", "文", "\x1c", "\x85", " ", "x" * 30, "<|endoftext|>", "\t",
         "ing", "́", "İ", "ß", " 'll", "\r\n"]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(RANKS)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})


def mixed_text(rng: random.Random, most: int = 40) -> str:
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(most)))


def test_ids_are_the_library_s(vocabulary, library):
    rng, pieces, split = random.Random(2), byte_bpe.Pieces(vocabulary), regex.compile(public_tokenizers.PATTERN)
    for text in [mixed_text(rng) for _ in range(1_500)] + [chr(c) * 2 + "a" + chr(c) for c in range(1, 0x3000)]:
        assert b"".join(pieces[p] for p in split.findall(text)) == byte_bpe.pack(library.encode_ordinary(text)), text


def test_every_prefix_has_the_encoding_of_its_bytes(vocabulary, library):
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice(["ing", "th", "e", "x", "re", "s", "é", "tion"]) for _ in range(rng.randrange(1, 12)))
        held = byte_bpe.Prefixes(vocabulary, word.encode())
        for n in range(1, len(word) + 1):
            at = len(word[:n].encode())
            assert held.ids(at) == library.encode_ordinary(word[:n])


def test_pairs_hold_as_merging_says(vocabulary):
    rng = random.Random(5)
    ranks = [r for r in vocabulary.token if vocabulary.merged(vocabulary.token[r]) == [r]]
    for _ in range(20_000):
        left, right = rng.choice(ranks), rng.choice(ranks)
        assert vocabulary.hold(left, right) == (vocabulary.merged(vocabulary.token[left] + vocabulary.token[right]) == [left, right])


def test_edits_and_appends_give_the_encoding_of_the_new_text(vocabulary, library):
    rng = random.Random(6)
    for _ in range(600):
        held = byte_bpe.Encoded(vocabulary, public_tokenizers.PATTERN, mixed_text(rng))
        for _ in range(4):
            a = rng.randrange(len(held.text) + 1)
            b = min(len(held.text), a + rng.randrange(5))
            new = mixed_text(rng, 3)
            want = held.text[:a] + new + held.text[b:]
            if rng.random() < 0.3:
                want, _ = held.text + new, held.append(new)
            else:
                held.replace(a, b, new)
            assert held.text == want and held.ids() == library.encode_ordinary(want)


def test_an_edit_computes_only_what_is_near(vocabulary):
    rng = random.Random(7)
    one = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    held = byte_bpe.Prefixes(vocabulary, one.encode())
    assert held.replace(50_000, 50_003, b"zz") < 2_000
    assert held.last == byte_bpe.Prefixes(vocabulary, held.data).last
    assert held.append(b"tail") == 4
    text = byte_bpe.Encoded(vocabulary, public_tokenizers.PATTERN, "some words " * 5_000)
    assert text.replace(20_000, 20_001, "Q") < 100 and text.ids() == byte_bpe.Encoded(vocabulary, public_tokenizers.PATTERN, text.text).ids()


def test_encode_and_decode_tables(spark, library):
    rng = random.Random(8)
    texts = [None, "", " ", "x" * 200_000, "same", "same", *[mixed_text(rng) for _ in range(40)]]
    df = spark.createDataFrame([(i % 7 or None, t, "mine", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    rows = rows_of(byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, "ids_"))
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids_"] == byte_bpe.pack(library.encode_ordinary(r["text"] or "")) and r["n_tokens_"] == len(r["ids_"]) // 4
        assert r["decoded"] == (r["text"] or "").encode() and r["ids"] == "mine"
    assert rows_of(byte_bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN)) == []


def test_revised_tables(spark, library):
    data = [("a text of words", 2, 6, "book"), (None, None, None, " more"), ("end", None, None, None), ("short", 2, 99, "x"), ("it's", -3, 0, "")]
    df = spark.createDataFrame(data, "text string, a int, b int, new string")
    rows = rows_of(byte_bpe.revise(df, RANKS, public_tokenizers.PATTERN, "a", "b", "new"))
    assert {r["text"] for r in rows} == {"a book of words", " more", "end", "shx", "it's"}
    assert all(r["ids"] == byte_bpe.pack(library.encode_ordinary(r["text"])) for r in rows)


def test_bpe_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = rows_of(queries.queries()["op12_byte_bpe"](spark, sf))
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(byte_bpe.pack(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# --- spelling variants ---------------------------------------------------------------------------

def brute_counts(rows, every=97, least=3):
    total = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= least and len(w) >= 5}


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_variants(counts):
    by_length = collections.defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    out = {}
    for w, n in counts.items():
        close = [v for d in (-1, 0, 1) for v in by_length[len(w) + d] if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = {"form": form, "n": n, "n_near": len(close), "form_n": counts[form] if form else None}
    for w in out:
        root = w
        while out[root]["form"]:
            root = out[root]["form"]
        out[w]["root"] = root
    return out


def test_pivots_are_the_cheapest_two_apart():
    rng = random.Random(9)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randrange(3, 7)))
        costs = [rng.randrange(9) for _ in places]
        got = pivotal_grams.pivots(places, costs)
        price = dict(zip(places, costs))
        want = min(price[a] + price[b] for a in places for b in places if b - a >= 2)
        assert got[1] - got[0] >= 2 and sum(price[p] for p in got) == want


def test_variants_equal_all_pairs(spark):
    rng = random.Random(10)
    words = {"".join(rng.choice("abÀé×") for _ in range(rng.randrange(5, 9))) for _ in range(700)} | {"aaaaa", "aaaaaa", "aaaaaaa", "ababab", "babab"}
    counts = {w: rng.choice([3, 3, 4, 6, 7, 12, 24, 50]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = {r.pop("word"): r for r in rows_of(pivotal_grams.variants(df))}
    assert got == brute_variants(counts)


def test_a_chain_of_forms_ends_at_its_root(spark):
    words = ["zzzzz" + "abcdefghijklmnopqrstuvwxyz"[:i] for i in range(27)]
    counts = {w: 3 * 2**i for i, w in enumerate(words)}
    got = {r.pop("word"): r for r in rows_of(pivotal_grams.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert got == brute_variants(counts) and {r["root"] for r in got.values()} == {words[-1]}


def test_word_counts_with_odd_rows(spark):
    rng = random.Random(11)
    rows = [(None, "Hello hello HELLO"), (1, None), (2, ""), (3, "12 _ \n"), (4, "naïve NAÏVE naïve" * 2), (5, "wörld " * 30_000), (5, "wörld " * 3), (6, "a×b÷c×d÷e " * 4)]
    rows += [(i, " ".join(rng.choice(["colour", "color", "flavour", "flavor", "Straße"]) for _ in range(20))) for i in range(7, 200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, word int, n string").repartition(3)
    got = pivotal_grams.word_counts(df)
    assert {r["word"]: r["n"] for r in rows_of(got)} == brute_counts(rows)
    assert rows_of(pivotal_grams.variants(pivotal_grams.word_counts(df.limit(0)))) == []


def test_variants_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.pop("word"): r for r in rows_of(queries.queries()["op13_pivotal_grams"](spark, sf))}
    assert got == brute_variants(brute_counts(rows)) and sum(r["form"] is not None for r in got.values()) > 10
