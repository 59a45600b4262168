"""Secret scans by an incremental blob ledger.

Every version of every path is addressed by its content (SHA-256). A ledger table keeps the findings
of each (blob, rule version) pair, also when there are none. A scan hashes all versions, reduces them
to distinct blobs, anti-joins the ledger and runs the rules over what is left; the findings are
then joined back to every path that holds the blob.

Defined cases: a null text is the empty blob; paths may be null or repeat, each row gets its own result;
an empty table gives an empty result; columns besides path and text are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.llm.common import fresh, shared_dir, slices, stage

# The base kinds, in the order in which they sort.
BASE_KINDS = ("assign", "access", "hex")
EXTRA_KINDS = ("jwt", "pem", "prefixed")
KINDS = BASE_KINDS + EXTRA_KINDS
RULES_VERSION = "3"

#: kind: (pattern, group whose length counts, least length, characters of which one must occur)
_RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ":="),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, "K"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, "0123456789abcdef"),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-"),
    "prefixed": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 1, "_-"),
}
_COMPILED = {
    kind: (re.compile(pattern, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), group, least, need)
    for kind, (pattern, group, least, need) in _RULES.items()
}
# A private key's span runs from its BEGIN marker to the next END marker of one, unless another block begins before it. Without an END marker it runs over
# the base64 that follows: header lines, runs of 16 characters or more between line ends (real or escaped), quotes and comment signs, and a shorter last run.
_BLOCK = "-----BEGIN "
_KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_GAPS = re.compile(r"(?:\\[nrt]|[^A-Za-z0-9+/=-]|(?:\+|//)\s)*+")
_HEADER = re.compile(r"[A-Z][A-Za-z0-9-]*+:\x20[^\n\\]*+")
_BASE64 = re.compile(r"[A-Za-z0-9+/=]++")
_LONG_BASE64 = re.compile(r"[A-Za-z0-9+/=]{16,}+")
# A web token: three runs joined by dots, the first two of which begin with "eyJ" (the first run may have more in front).
_TOKEN_LEAST = 30
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_TOKEN_REST = re.compile(r"\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", re.ASCII)
_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SCANNED = pa.schema([("blob", pa.binary()), ("findings", pa.list_(_FINDING))])
LEDGER = "blob binary, rules string, findings array<struct<kind:string,start:bigint,end:bigint>>"


def _body_end(text: str, at: int, stop: int) -> int:
    """Where the key's base64 ends that begins at `at`, read forward once; `at` if there is none."""
    end, headers = at, True
    while at < stop:
        at = _GAPS.match(text, at, stop).end()
        header = _HEADER.match(text, at, stop) if headers else None
        if header:  # long runs in it count if nothing follows
            begin, at = at, header.end()
            for run in _LONG_BASE64.finditer(text, begin, at):
                end = run.end()
            continue
        run = _BASE64.match(text, at, stop)
        if run and run.end() - at >= 16:
            headers, end, at = False, run.end(), run.end()
            continue
        return run.end() if run and not headers else end
    return end


def _key_end(text: str, at: int) -> int:
    """Where the private key ends whose BEGIN marker ends at `at`."""
    stop = text.find(_BLOCK, at)
    stop = len(text) if stop < 0 else stop
    m = _KEY_END.search(text, at, stop)
    return m.end() if m else _body_end(text, at, stop)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of web tokens, the leftmost first, none overlapping. Each run of characters is read a bounded number of times."""
    done, dot = 0, text.find(".eyJ")
    while dot >= 0:
        start = dot
        while start > done and text[start - 1] in _TOKEN_CHARS:
            start -= 1
        start = text.find("eyJ", start, max(dot - 1, 0))  # a character at least between "eyJ" and the dot
        rest = _TOKEN_REST.match(text, dot) if start >= 0 else None
        if rest:
            done = rest.end()
            yield start, done
        dot = text.find(".eyJ", max(done, dot + 1))


def scan_text(text: str) -> list[dict]:
    """All findings of one text: leftmost, non-overlapping per kind, those too short dropped after matching."""
    found = []
    for kind, (pattern, group, least, need) in _COMPILED.items():
        if any(c in text for c in need):
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append({"kind": kind, "start": m.start(), "end": _key_end(text, m.end()) if kind == "pem" else m.end()})
    if ".eyJ" in text:
        found += [{"kind": "jwt", "start": a, "end": b} for a, b in _tokens(text) if b - a >= _TOKEN_LEAST]
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [scan_text(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob").cast(pa.binary()), pa.array(found, _SCANNED.field("findings").type)],
                                         schema=_SCANNED)


def content_address(text: str | Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def read_ledger(spark: SparkSession, ledger: str, rules: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == rules).select("blob", "findings")


def update(versions: DataFrame, ledger: str, text: str = "text", rules: str = RULES_VERSION, first: bool = False) -> None:
    """Scan the blobs that the ledger doesn't hold for this rule version and append them.

    first: the ledger folder does not exist yet. A key's copies are merged in the map tasks, so a blob with
    very many copies costs one row for each task.
    """
    spark = versions.sparkSession
    blobs = (versions.select(content_address(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
             .groupBy("blob").agg(F.first("text").alias("text")))
    if not first:
        seen = read_ledger(spark, ledger, rules).select("blob")
        unseen = versions.select(content_address(text).alias("blob")).distinct().join(seen, "blob", "left_anti")
        blobs = blobs.join(unseen, "blob", "left_semi")
    scanned = blobs.mapInArrow(_scan, "blob binary, findings array<struct<kind:string,start:bigint,end:bigint>>")
    scanned.select("blob", F.lit(rules).alias("rules"), "findings").write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, text: str = "text", rules: str = RULES_VERSION, keep_text: bool = False) -> DataFrame:
    """Every row of versions with its blob's findings, an array of (kind, start, end); the text stays only if asked.

    Blobs without findings are implied. Those with some are written on their own first, so that Spark knows
    their size: where it is small they are broadcast and no version is shuffled.
    """
    blob, found = fresh(versions, "blob", "findings")
    kept = versions if keep_text else versions.drop(text)
    book = read_ledger(versions.sparkSession, ledger, rules).filter(F.size("findings") > 0).dropDuplicates(["blob"])
    book = stage(book, "secret-findings").select(F.col("blob").alias(blob), F.col("findings").alias(found))
    rows = versions.withColumn(blob, content_address(text)).select(*[versions[c] for c in kept.columns], blob)
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.join(book, blob, "left").withColumn(found, F.coalesce(F.col(found), none)).select(*kept.columns, blob, found)


def scan(versions: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """findings() over a ledger of its own."""
    ledger = shared_dir(versions.sparkSession, "secret-ledger")
    update(versions, ledger, text, first=True)
    return findings(versions, ledger, text, keep_text=keep_text)


def in_order(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Findings of the given kinds by start, then kind as listed, as kind:start:end texts joined by commas."""
    rank = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    ranked = F.transform(F.filter(found, lambda x: x["kind"].isin(*kinds)),
                         lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def redacted(text: str, spans: list[dict]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    pieces, at = [], 0
    for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if start >= at:
            pieces += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def redact(text: Column, found: Column) -> Column:
    """redacted() as a column; texts without findings stay in the JVM."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    hit = F.size(found) > 0
    return F.coalesce(F.when(hit, run(F.when(hit, text), F.when(hit, found))), text)
