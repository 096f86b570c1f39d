"""Removal of passages of 20 or more words that occur earlier in the corpus.

A window is 20 consecutive words (runs of anything but ASCII white space, unchanged) of one document. Each
word covered by a window whose word sequence also starts earlier (smaller doc_id, or same doc_id and
earlier start) goes; windows are judged on the input.

1. Confirm. Of the 16 five-word phrases in a window the one with the smallest hash is its anchor; equal
   windows have equal anchors at equal places. Phrases that are an anchor at two or more places of the
   corpus are confirmed: only windows around them can recur. About one place in eight is an anchor.
2. Locate. Documents are taken in blocks of some MB; the confirmed phrases of a block are compiled into an
   Aho-Corasick automaton (a shard of the whole, of bounded size), which streams the block's documents and
   finds every occurrence. Around each occurrence the snippet of all windows that it anchors is cut out.
   Equal snippets of a task are merged at once: all but the earliest are known to be covered.
3. Compare. Snippets meet by phrase hash; in the order of (doc_id, start) each window's words are looked up
   among those seen before. The comparison is of the words themselves, hash collisions change nothing.
4. Remove. The covered ranges go back to their documents.

Skew. Phrases with more places than a task should get are hot (see joins.py): their places are confirmed by a join with those
phrases alone, which are broadcast where they are few, and their windows travel one by one, dealt by a hash of the
whole window instead of the phrase. Equal windows of a task are merged before they travel, so a passage in a
third of all documents sends one row per task. Memory is bounded by the block, the merge table (emptied at
MERGE_LIMIT rows or MERGE_BYTES) and the snippets of one phrase that is not hot.

Defined cases: null text has no words; the digest of no words is that of the empty string; rows with the
same doc_id are one document (of two equal starts none is earlier); a null doc_id sorts last, and all such
rows count as one document; repeated rows give repeated result rows. The doc_id 2**63 - 1 is taken for none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import NO_ID, WordHashes, binary_rows, keyed, map_batches, window_hashes
from lexmill.operators import joins
from lexmill.sources.shared import park

WINDOW = 20
PHRASE = 5
MERGE_LIMIT, MERGE_BYTES = 60_000, 48_000_000
BLOCK_BYTES = 3_000_000
BLOCK_WORDS = 100_000
_BLANK = re.compile(" ")
_PLACE = np.uint64((1 << 24) - 1)
#: Phrases whose anchors are sought at once: places must fit _PLACE.
CHUNK = 1 << 22


def anchors(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> np.ndarray:
    """For each window start, the place of the smallest phrase hash in the window.

    Hashes are compared in their upper 40 bits, the leftmost of equal ones wins: the place goes into the
    lower 24 bits, and a minimum over 2, 4, 8 and so on phrases gives hash and place at once. Long inputs
    are taken in chunks that overlap by a window; a window's anchor doesn't depend on where chunks begin.
    """
    wide = window - phrase + 1
    n = len(hashes) - wide + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    if n > CHUNK:
        return np.concatenate([anchors(hashes[s : min(s + CHUNK, n) + wide - 1], window, phrase) + s for s in range(0, n, CHUNK)])
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while 2 * reach <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[:n], low[wide - reach : wide - reach + n])
    return (low[:n] & _PLACE).astype(np.int64)


def _anchor_rows():
    hashed = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = binary_rows(batch, "text")
        found: list[np.ndarray] = []
        places: list[np.ndarray] = []
        counts: list[int] = []
        block: list[list[bytes]] = []

        def flush() -> None:
            """Anchors of a block of documents in one go; windows across their borders are left out."""
            sizes = np.array([len(w) for w in block], dtype=np.int64)
            ends = np.cumsum(sizes)
            hashes = window_hashes(hashed.of(list(chain.from_iterable(block))), PHRASE)
            at = anchors(hashes)
            owner = np.repeat(np.arange(len(block)), sizes)[: len(at)]
            inside = np.arange(len(at)) + WINDOW <= ends[owner]
            at = np.unique(at[inside])
            counts.extend(np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(block)).tolist())
            found.append(hashes[at].view(np.int64))
            places.append((at - (ends - sizes)[np.searchsorted(ends, at, side="right")]).astype(np.int32))
            block.clear()

        size = 0
        for text in texts:
            block.append(text.split())
            size += len(block[-1])
            if size >= BLOCK_WORDS:
                flush()
                size = 0
        if block:
            flush()
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.empty(0, t), t())) for x, t in ((found, pa.int64), (places, pa.int32))] if texts else [pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column("at"), *lists], names=["at", "hs", "ps"])

    return run


def _automaton(block: list[tuple]) -> ahocorasick.Automaton:
    """Of the confirmed phrases of a block's documents, between blanks so that only whole words match."""
    shard = ahocorasick.Automaton()
    for _, _, words, places in block:
        for p in places:
            # hot phrases are marked by a place below zero; one phrase is hot everywhere
            at, hot = (-1 - p, 1) if p < 0 else (p, 0)
            if at + PHRASE > len(words):
                # the place belongs to another text of the same doc_id
                continue
            shard.add_word(f" {' '.join(words[at : at + PHRASE])} ", hot)
    shard.make_automaton()
    return shard


def snippets(key: int, th: int, words: list[str], shard: ahocorasick.Automaton, hashed: WordHashes) -> Iterator[tuple[int, int, int, int, int, str]]:
    """(hash, key, th, first window start, number of windows, words) around each located anchor.

    The hash is the phrase's; windows of a hot phrase come one by one with the hash of all their words.
    """
    n = len(words) - WINDOW + 1
    if n < 1:
        return
    joined = f" {' '.join(words)} "
    # a match ends at the blank behind a word
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    found = np.array(list(shard.iter(joined)), dtype=np.int64).reshape(-1, 2)
    if not len(found):
        return
    hashes = window_hashes(hashed.of(joined.encode("utf-8", "surrogatepass").split()), PHRASE)
    # 0: not confirmed, 1: confirmed, 2: hot
    located = np.zeros(len(hashes), dtype=np.int8)
    located[np.searchsorted(ends, found[:, 0]) - PHRASE + 1] = 1 + found[:, 1]
    places = anchors(hashes)
    bounds = np.flatnonzero(np.diff(places)) + 1
    starts = np.concatenate(([0], bounds))
    chosen = places[starts]
    hs = hashes[chosen].view(np.int64).tolist()
    stops = np.concatenate((bounds, [n])).tolist()
    before = np.concatenate(([0], ends)).tolist()
    for s, e, h, confirmed in zip(starts.tolist(), stops, hs, located[chosen].tolist(), strict=True):
        if confirmed == 1:
            yield h, key, th, s, e - s, joined[before[s] + 1 : before[e + WINDOW - 1]]
        elif confirmed:
            for k in range(s, e):
                window = joined[before[k] + 1 : before[k + WINDOW]]
                yield _signed(window.encode("utf-8", "surrogatepass")), key, th, k, 1, window


def _signed(data: bytes) -> int:
    """64-bit hash as a signed number."""
    x = xxhash.xxh3_64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


_SNIPPET = "h long, key long, th long, start int, n int, snippet string"
_SNIPPET_ARROW = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("snippet", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets of a task's documents; those known to be covered come without words."""
    earliest: dict[bytes, tuple] = {}
    out: list[tuple] = []
    gone: list[tuple] = []
    held = waiting = 0
    hashed = WordHashes()

    def covered(row: tuple) -> None:
        gone.append((*row[1:4], row[3] + row[4] - 1 + WINDOW))

    def table() -> pa.RecordBatch:
        # neighbouring covered snippets of a document are one range; there is nothing to compare, so they are spread by document
        rows = [(_signed(b"%d %d" % (key, start)), key, th, start, end - start - WINDOW + 1, None) for key, th, start, end in (_merged(sorted(gone)) if gone else ())]
        gone.clear()
        return _table([*out, *rows], _SNIPPET_ARROW)

    def blocks() -> Iterator[list[tuple]]:
        block, size = [], 0
        for batch in batches:
            for key, th, text, found in zip(*(batch.column(c).to_pylist() for c in ("key", "th", "text", "found")), strict=True):
                words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
                block.append((key, th, words, found))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield block
                    block, size = [], 0
        if block:
            yield block

    for block in blocks():
        shard = _automaton(block)
        for key, th, words, _ in block:
            for row in snippets(key, th, words, shard, hashed):
                mark = xxhash.xxh3_128_digest(row[5].encode("utf-8", "surrogatepass"))
                best = earliest.get(mark)
                if best is None:
                    earliest[mark] = row
                    held += len(row[5])
                elif (row[1], row[3]) > (best[1], best[3]):
                    covered(row)
                elif (row[1], row[3]) < (best[1], best[3]):
                    covered(best)
                    earliest[mark] = row
                else:
                    out.append(row)
                    waiting += len(row[5])
                if len(earliest) >= MERGE_LIMIT or held >= MERGE_BYTES:
                    out += earliest.values()
                    waiting += held
                    earliest, held = {}, 0
                if len(out) >= 20_000 or len(gone) >= MERGE_LIMIT or waiting >= MERGE_BYTES:
                    yield table()
                    out, waiting = [], 0
    out += earliest.values()
    if out or gone:
        yield table()


_RANGE_ARROW = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets sorted by (h, key, start) -> covered word ranges."""
    now, seen = None, {}
    for batch in batches:
        out = []
        for h, key, th, start, n, snippet in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if snippet is None:
                out.append((key, th, start, start + n - 1 + WINDOW))
                continue
            if h != now:
                now, seen = h, {}
            blanks = [-1, *(m.start() for m in _BLANK.finditer(snippet)), len(snippet)]
            for i in range(n):
                sequence = snippet[blanks[i] + 1 : blanks[i + WINDOW]]
                if seen.setdefault(sequence, (key, start + i)) < (key, start + i):
                    out.append((key, th, start + i, start + i + WINDOW))
        if out:
            yield _table(_merged(out), _RANGE_ARROW)


def _merged(ranges: list[tuple]) -> list[tuple]:
    """Neighbouring ranges of one document as one."""
    out = [ranges[0]]
    for r in ranges[1:]:
        last = out[-1]
        if r[:2] == last[:2] and last[2] <= r[2] <= last[3]:
            out[-1] = (*last[:3], max(last[3], r[3]))
        else:
            out.append(r)
    return out


def remove_ranges(words: list[bytes], ranges: list[dict]) -> list[bytes]:
    gone = np.zeros(len(words), dtype=bool)
    for r in ranges:
        gone[r["from"] : r["to"]] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _removed(batch: pa.RecordBatch) -> pa.RecordBatch:
    totals, kept, digests = [], [], []
    for text, ranges in zip(binary_rows(batch, "text"), batch.column("ranges").to_pylist(), strict=True):
        words = text.split()
        left = remove_ranges(words, ranges) if ranges else words
        totals.append(len(words))
        kept.append(len(words) - len(left))
        digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(kept, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def covered_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents(at, key, text, th), ranges(at, ranges array<struct<th, from, to>>)); th is a hash of the text.

    Documents are joined by `at`, their doc_id or, where it is null, th. Several texts of one doc_id share it:
    they share confirmed phrases, which does no harm, and ranges name the text they are for.
    """
    at = lambda: F.when(F.col("key") == NO_ID, F.col("th")).otherwise(F.col("key")).alias("at")
    rows = keyed(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text", F.xxhash64("text").alias("th")).select(at(), "key", "text", "th")
    found = park(map_batches(rows.select("at", "text"), _anchor_rows(), "at long, hs array<long>, ps array<int>"), "substring-anchors")
    confirmed = park(found.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "substring-confirmed")
    hot = joins.hot_keys(confirmed, "h")
    each = found.select("at", F.inline(F.arrays_zip(F.col("hs").alias("h"), F.col("ps").alias("p"))))
    if hot.table is None:
        rare, common = each, each.where(F.lit(False)).select("at", "p")
    else:
        marked = each.join(hot.known, "h", "left")
        rare, common = marked.where("_hot is null"), marked.where("_hot is not null").select("at", (-1 - F.col("p")).alias("p"))
        confirmed = confirmed.join(hot.known, "h", "left_anti")
    rare = rare.join(confirmed.select("h"), "h").select("at", "p")
    wanted = rare.unionByName(common).groupBy("at").agg(F.collect_set("p").alias("found"))
    located = rows.join(wanted, "at").select("key", "th", "text", "found").mapInArrow(_located, _SNIPPET)
    sorted_ = located.repartition("h").sortWithinPartitions("h", "key", "start")
    ranges = sorted_.mapInArrow(_compared, "key long, th long, `from` int, `to` int")
    ranges = ranges.groupBy(at()).agg(F.collect_list(F.struct("th", "from", "to")).alias("ranges"))
    return rows, ranges


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    rows, ranges = covered_ranges(docs)
    # both joins of the documents ask for the same columns by the same key: they are shuffled once
    own = F.filter("ranges", lambda r: r["th"] == F.col("th"))
    joined = rows.join(ranges, "at", "left").select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "text", own.alias("ranges"))
    return map_batches(joined, _removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
