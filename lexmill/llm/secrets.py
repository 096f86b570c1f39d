"""Secret scans with corpus-wide ownership.

Base spans, leftmost non-overlapping per kind, are found in every whole text: `assign` (a named assignment
whose value has 6 or more characters), `access` (AKIA keys of 20 or more), `hex` (runs of 24 or more). The
whole match is the span, in code points, end exclusive.

Candidates are the values of the base spans (of an assignment what is assigned) and, where no base span
touches, runs of 20 or more of [A-Za-z0-9+/_-] with a digit, an upper and a lower case letter. For each
candidate's hash the distinct repositories and the distinct owners over the whole corpus are counted. A value
in the hands of more than `most_owners` owners or in more than `most_repos` repositories is a copied example;
one that isn't, and has LEAST_KINDS different characters, is a live-looking credential of its owner. The
method adds a span of kind `live` over the place of every such value; base spans stay always.

Skew: a widely copied value is one key. Counting first drops repeats of (value, repository, owner) on the
map side. Only live values are joined back; one that a third of all rows hold (of one owner) is counted,
found to be hot and salted.

Defined cases: null text has no spans and the digest of the empty string; repeated rows give repeated
result rows; null owner or repository is one of its own; two candidates at one place are one; a null doc_id comes
through as it is. Texts of any length are scanned whole, in time in proportion to them and to the logarithm of their spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_batches
from lexmill.operators.joins import salted_join
from lexmill.sources.shared import park

#: Fixed patterns of the base kinds, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "live")
LIVE = 3
#: Different characters that a credential has at least.
LEAST_KINDS = 8
#: A live secret may stand in a few repositories of its owner; in more it is an example.
MOST_REPOS = 3

#: No assignment can match a text without one of these.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int], str]]:
    """Spans (start, kind number, end), sorted, and the candidate values by their place (start, end)."""
    spans, values = [], {}
    low = text.lower()
    if any(name in low for name in _NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, m.end()))
                values[m.span(2)] = m[2]
    for kind, found in ((1, ACCESS.finditer(text) if "AKIA" in text else ()), (2, HEX.finditer(text))):
        for m in found:
            if m.end() - m.start() >= (20, 24)[kind - 1]:
                spans.append((m.start(), kind, m.end()))
                values[m.span()] = m[0]
    return sorted(spans), values


def random_runs(text: str, base: list[tuple[int, int, int]]) -> dict[tuple[int, int], str]:
    """Runs that look random and that no base span touches, by their place."""
    starts, ends = [b[0] for b in base], list(accumulate((b[2] for b in base), max))

    def touched(s: int, e: int) -> bool:
        """Whether one of the spans that begin before e ends behind s."""
        before = bisect_left(starts, e)
        return before > 0 and ends[before - 1] > s

    return {m.span(): m[0] for m in TOKEN.finditer(text) if not touched(*m.span()) and all(c.search(m[0]) for c in _CLASSES)}


_CLASSES = tuple(map(re.compile, ("[0-9]", "[A-Z]", "[a-z]")))
_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))
_VALUES = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("v", pa.binary()), ("varied", pa.bool_())]))


def _scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
    digests, spans, values = [], [], []
    for text in batch.column("text").to_pylist():
        base, found = base_spans(text)
        digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
        spans.append([{"s": s, "k": k, "e": e} for s, k, e in base])
        found |= random_runs(text, base)
        values.append([{"s": s, "e": e, "v": xxhash.xxh3_128_digest(v.encode("utf-8", "surrogatepass")), "varied": len(set(v)) >= LEAST_KINDS} for (s, e), v in sorted(found.items())])
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "repo", "owner")), pa.array(digests), pa.array(spans, _SPANS), pa.array(values, _VALUES)], names=["doc_id", "repo", "owner", "base_sha256", "spans", "candidates"])


def secrets(docs: DataFrame, repo: str = "source", owner: str = "source", most_owners: int = 1, most_repos: int = MOST_REPOS) -> DataFrame:
    """docs(doc_id, text, repo, owner) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    n_live counts the candidates that are live-looking (the added spans), n_copied those that more than
    `most_owners` owners or `most_repos` repositories hold.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), own(repo).alias("repo"), own(owner).alias("owner"))
    schema = "doc_id long, repo string, owner string, base_sha256 string, spans array<struct<s: long, k: int, e: long>>, candidates array<struct<s: long, e: long, v: binary, varied: boolean>>"
    rows = park(map_batches(rows, _scanned, schema).withColumn("row", F.monotonically_increasing_id()), "secret-rows")

    held = rows.select("repo", "owner", F.explode("candidates.v").alias("v")).distinct()
    owners = held.groupBy("v", "owner").agg(F.count("*").alias("repos")).groupBy("v").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    few = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    values = rows.where(F.size("candidates") > 0).select("row", F.inline("candidates"))
    judged = salted_join(values, owners.where(few).select("v", F.lit(True).alias("few")), "v", "row", "left").withColumn("few", F.coalesce("few", F.lit(False)))
    live = F.col("few") & F.col("varied")
    place = F.struct("s", F.lit(LIVE).alias("k"), "e")
    per = judged.groupBy("row").agg(F.collect_list(F.when(live, place)).alias("live"), F.count(F.when(live, 1)).alias("l"), F.count(F.when(~F.col("few"), 1)).alias("x"))
    joined = rows.select("row", "doc_id", "base_sha256", "spans").join(per, "row", "left")
    every = F.when(F.col("l") > 0, F.array_sort(F.concat("spans", "live"))).otherwise(F.col("spans"))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.k + 1), x.s, x.e)), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x.k == k)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", text.alias("spans"), zero("l").alias("n_live"), zero("x").alias("n_copied"))
