"""SentencePiece encoding and decoding in batched numpy.

A text becomes pieces as the model's library would make them: blanks turn into U+2581, one is put in front,
and pieces merge by rank. No merge crosses a border between two code points that stand side by side in no piece,
so a text falls there into units that are encoded apart; a worker keeps the ids of the units it has met.

The candidates of all units of a batch are found together: from every code point on, hashes of ever longer
substrings go on while they begin some piece, and probe the sorted hashes of the pieces; the code points of a
hit are compared. Then the units advance together, one code point at a time. For every unit the last piece of the
encoding of its first s code points is known for all s < e; the candidates for e are the pieces that end
there. In a model that
merges by rank a sequence of pieces is the encoding if, and only if, each two neighbours encode to
themselves when joined (merges inside two pieces go on independently unless one crosses their border).
Hence exactly one candidate fits behind the last piece of its prefix; a maximum over the lengths, where
fitting counts most and length next, picks it and stores the backpointer. Whether two pieces fit is worked
out once per pair and kept.

Code points without a piece become their UTF-8 bytes. A unit of more than LONG code points, which would
advance all alone, merges by rank through a heap instead, with the same result.

Defined cases: null text has no ids (null) and decodes to null, empty text has an empty list. Decoding gives
the text back exactly, except that U+2581 in a text comes back as a blank. Repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 4_096
#: Code points of the units that advance together, but for the last unit.
BATCH_CODES = 400_000
#: Units, and their code points, that a worker keeps; beyond it starts anew.
KEEP, KEEP_CODES = 300_000, 6_000_000
#: Places for pairs of pieces whose fit is known.
PAIR_BITS = 20
#: Leading bits of a hash by which pieces, their beginnings and neighbours in them are marked.
MARK_BITS = 20


@dataclass
class Vocabulary:
    """The pieces of a model (few ten thousand, sent to the workers) by id, with the rank of their merge."""

    pieces: list[str]
    scores: list[float]
    bytes_from: int

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        return cls([model.id_to_piece(i) if ok else "" for i, ok in enumerate(normal)], [model.get_score(i) for i in range(n)], next(i for i in range(n) if model.is_byte(i)))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _spread(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of up to `length`, padded with zeros."""
    return np.frombuffer("".join(w.ljust(length, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), length)


def _top(hashes: np.ndarray, bits: int = MARK_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _neighbours(codes: np.ndarray) -> np.ndarray:
    """A hash, cut to MARK_BITS, of each code point and the next."""
    codes = codes.astype(np.uint64)
    return _top(((codes[:-1] << np.uint64(21)) | codes[1:]) * _BASE)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    spread = _spread(codes)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + spread[:, k]
    return out


@dataclass
class Encoder:
    vocabulary: Vocabulary
    ids: dict[str, int] = field(init=False)
    #: Number of each unit kept; the ids of unit k are flat[starts[k] : starts[k + 1]].
    known: dict[str, int] = field(default_factory=dict)
    held: int = 0

    def __post_init__(self) -> None:
        pieces = self.vocabulary.pieces
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        self.rank = {p: -self.vocabulary.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        by_length: dict[int, list[str]] = {}
        for p in self.ids:
            by_length.setdefault(len(p), []).append(p)
        hashes, ids = [], []
        # by leading bits of a hash: 1 if a piece has them, 2 if a longer piece begins so
        self.marks = np.zeros(1 << MARK_BITS, dtype=np.uint8)
        self.codes = np.zeros((len(pieces), self.longest), dtype=np.uint32)
        # pairs of code points side by side in some piece; another pair may share the mark, which only spares a cut
        self.joined = np.zeros(1 << MARK_BITS, dtype=bool)
        for length, group in by_length.items():
            ids.append(np.array([self.ids[p] for p in group], dtype=np.int64))
            self.codes[ids[-1], :length] = codes = _codes(group, length)
            prefixes = _prefix_hashes(codes)
            hashes.append(prefixes[:, -1])
            self.marks[_top(prefixes[:, -1])] |= 1
            for k in range(1, length):
                self.marks[_top(prefixes[:, k])] |= 2
                self.joined[_neighbours(codes[:, k - 1 : k + 1].ravel())[::2]] = True
        order = np.argsort(np.concatenate(hashes))
        self.keys, self.key_ids = np.concatenate(hashes)[order], np.concatenate(ids)[order]
        # the first key with given leading bits, and how many further ones may have the same
        tops = _top(self.keys)
        self.first = np.minimum(np.searchsorted(tops, np.arange(1 << MARK_BITS)), len(tops) - 1).astype(np.int32)
        self.further = int(np.bincount(tops).max()) - 1
        # whether two pieces fit, as 2 * pair + fit, by a hash of the pair; a later pair takes the place of an earlier one
        self.pairs = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.held, self.flat, self.starts = 0, np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def merged(self, text: str) -> list[str]:
        """Merging by rank, the leftmost first: the definition that the batches are held to."""
        if len(text) <= 2 * self.longest:
            return self._merged_short(list(text))
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if (r := self.rank.get(both)) is not None:
                heapq.heappush(heap, (r, i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _merged_short(self, parts: list[str]) -> list[str]:
        get = self.rank.get
        ranks = [get(a + b) for a, b in itertools.pairwise(parts)]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1])

    def out_ids(self, parts: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in parts:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.vocabulary.bytes_from + b for b in p.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether piece `right` can stand behind piece `left`; left -1 is the start, -2 a code point without a piece."""
        n = len(self.vocabulary.pieces)
        pairs = (left.astype(np.int64) + 2) * n + right
        slots = _top(pairs.astype(np.uint64) * _BASE, PAIR_BITS)
        stored = self.pairs[slots]
        good = (stored & 1).astype(bool)
        missed = np.flatnonzero(stored >> 1 != pairs)
        if len(missed):
            new, at = np.unique(pairs[missed], return_inverse=True)
            fits = np.empty(len(new), dtype=bool)
            for k, pair in enumerate(new.tolist()):
                a, b = divmod(pair, n)
                b = self.vocabulary.pieces[b]
                a = self.vocabulary.pieces[a - 2] if a >= 2 else ""
                fits[k] = self.merged(a + b) == ([a, b] if a else [b])
            good[missed] = fits[at]
            self.pairs[slots[missed]] = 2 * pairs[missed] + good[missed]
        return good

    def _candidates(self, codes: np.ndarray, left: np.ndarray):
        """For each size: the places where pieces of that size begin, and the ids of these. left: how far each place's unit reaches."""
        spread = _spread(codes)
        places = np.flatnonzero(left)
        hashes = spread[places]
        for size in range(1, self.longest + 1):
            tops = _top(hashes)
            marks = self.marks[tops]
            hit = np.flatnonzero(marks & 1)
            h = hashes[hit]
            k = self.first[tops[hit]]
            for _ in range(self.further):
                k += self.keys[k] < h
                np.minimum(k, len(self.keys) - 1, out=k)
            real = self.keys[k] == h
            found, ids = places[hit[real]], self.key_ids[k[real]]
            same = (np.lib.stride_tricks.sliding_window_view(codes, size)[found] == self.codes[ids, :size]).all(axis=1)
            yield size, found[same], ids[same]
            on = (marks & 2).astype(bool) & (left[places] > size)
            places = places[on]
            if not len(places):
                return
            hashes = hashes[on] * _BASE + spread[places + size]

    def _batch(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in one array, and how many each word has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        # one place before each word stands for its start
        codes = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths
        left = np.repeat(ends, lengths + 1) - np.arange(len(codes))
        left[starts - 1] = 0
        # the last piece of the encoding up to each place, and its size; a code point without a piece stands for itself
        last, back = np.full(len(codes), -2, dtype=np.int32), np.ones(len(codes), dtype=np.int32)
        last[starts - 1] = -1
        places, pieces, sizes = [], [], []
        for size, found, ids in self._candidates(codes, left):
            if size == 1:
                last[found] = ids
            else:
                places.append(found)
                pieces.append(ids.astype(np.int32))
                sizes.append(np.full(len(found), size, dtype=np.int32))
        if places:
            begins, pieces, sizes = np.concatenate(places), np.concatenate(pieces), np.concatenate(sizes)
            # by the length of the prefix that they end (LONG fits 16 bits), the longest piece last
            prefix = (np.repeat(lengths, lengths + 1) - left)[begins] + sizes
            order = np.argsort(prefix.astype(np.uint16), kind="stable")
            begins, pieces, sizes = begins[order], pieces[order], sizes[order]
            bounds = np.concatenate(([0], np.cumsum(np.bincount(prefix)))).tolist()
            for a, b in itertools.pairwise(bounds):
                if a < b:
                    fits = np.flatnonzero(self._fitting(last[begins[a:b] - 1], pieces[a:b])) + a
                    e = begins[fits] + sizes[fits] - 1
                    last[e], back[e] = pieces[fits], sizes[fits]
        # follow the backpointers of all units at once, marking where pieces end
        count = np.zeros(len(codes), dtype=np.int64)
        e, stop = ends - 1, starts
        while len(e):
            count[e] = 1
            e = e - back[e]
            more = e >= stop
            e, stop = e[more], stop[more]
        at = np.flatnonzero(count)
        ids = last[at]
        if len(bare := at[ids < 0]):
            count[bare] = 1 + (codes[bare] > 0x7F) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)
            is_byte = np.repeat(ids < 0, count[at])
            text = codes[bare].tobytes().decode("utf-32-le", "surrogatepass")
            spelled = np.empty(len(is_byte), dtype=np.int32)
            spelled[~is_byte] = ids[ids >= 0]
            spelled[is_byte] = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int32) + self.vocabulary.bytes_from
            ids = spelled
        return ids, np.add.reduceat(count, starts)

    def learn(self, units: set[str]) -> None:
        """Encode the units not known yet."""
        if len(self.known) > KEEP or self.held > KEEP_CODES:
            self._forget()
        new = sorted(units.difference(self.known), key=len)
        if not new:
            return
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        self.held += int(lengths.sum())
        short = int(np.searchsorted(lengths, LONG, side="right"))
        turns = np.cumsum(lengths[:short]) // BATCH_CODES
        cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), short]
        parts = [self._batch(new[a:b]) for a, b in itertools.pairwise(cuts) if a < b]
        for w in new[short:]:
            out = self.out_ids(self.merged(w))
            parts.append((np.array(out, dtype=np.int32), np.array([len(out)])))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([counts for _, counts in parts]))])

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids begin and the last ones end; a null text has none."""
        whole = "".join([SPACE + t for t in texts if t]).replace(" ", SPACE)
        if not whole:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts])))
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cut = np.ones(len(codes) + 1, dtype=bool)
        cut[1:-1] = ~self.joined[_neighbours(codes)]
        cut[begins] = True
        cuts = np.flatnonzero(cut)
        units = [whole[a:b] for a, b in itertools.pairwise(cuts.tolist())]
        self.learn(set(units))
        numbers = np.fromiter(map(self.known.__getitem__, units), dtype=np.int64, count=len(units))
        starts = self.starts[numbers]
        counts = self.starts[numbers + 1] - starts
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(cuts, begins)]

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        ids, at = self.encode_flat(texts)
        return [None if t is None else ids[a:b].tolist() for t, a, b in zip(texts, at.tolist(), at[1:].tolist(), strict=False)]


def _byte_table(vocabulary: Vocabulary) -> list[bytes]:
    table = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in vocabulary.pieces]
    for b in range(256):
        table[vocabulary.bytes_from + b] = bytes([b])
    return table


#: Encoders and tables live as long as a worker.
_WORKER: dict[str, object] = {}
_BLOCK_CHARS = 1_000_000


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, ids array<int>. Further columns, of whatever names, are left out."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        encoder = _WORKER.get(model)
        if encoder is None:
            encoder = _WORKER[model] = Encoder(vocabulary.value)
        for batch in batches:
            turns = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(), dtype=np.int64) // _BLOCK_CHARS
            for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)]):
                if a < b:
                    part = batch.slice(a, b - a)
                    ids, at = encoder.encode_flat(part.column("text").to_pylist())
                    ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=part.column("text").is_null())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids], names=["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>")


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """A table with ids array<int> -> the same and `decoded`, the text."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _WORKER.get(f"{model} bytes")
        if table is None:
            table = _WORKER[f"{model} bytes"] = _byte_table(vocabulary.value)
        out = []
        column = batch.column("ids")
        for k in range(len(column)):
            ids = column[k].values
            # the first blank is the one that encoding puts in front
            out.append(None if ids is None else b"".join(map(table.__getitem__, ids.to_numpy().tolist()))[1:].decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_batches(tokens, run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))
