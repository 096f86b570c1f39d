"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word (A-Z lower-cased, punctuation at its ends cut off) are a word embedding and the mean of the
embeddings of its character 3-, 4- and 5-grams, both hashed. A window of WINDOW words passes two recurrent
layers, one in each direction; attention over the words pools the states, a linear layer gives the window's
logit. Windows start every STRIDE words and the last one ends with the text, so every word is in a window
and every window is scored; a document's logit is the largest one, a logistic map fitted on the training
rows turns it into the score.

Training: labels say whether a document is toxic, not where. The first windows of toxic documents are those
with the word of the largest log-odds in the sample, later ones those with the model's largest logit;
clean documents give a random window and the one with the largest logit. The sample is bounded: at most
MOST_TOXIC toxic and MOST_CLEAN clean labelled rows (those with the smallest hash of doc_id) among texts of
up to MOST_CHARS code points. Rows whose crc32(doc_id) mod 5 is 0 are held out and never looked at.

Defined cases: null, empty and wordless texts are one window without words and get its score; a label
without a document, or null, is not used; of repeated labels the largest counts; without toxic or without
clean labels the score is the share of toxic ones; repeated rows give repeated rows; columns of docs may have
any names, one that has the name asked for the score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, STRIDE = 48, 32
HIDDEN, WIDTH = 8, 12
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 15
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1500, 2500, 8000
#: Passes over the windows; more of them if the sample is so small that they hold fewer than LEAST_STEPS batches.
EPOCHS, LEAST_STEPS, BATCH = 4, 200, 64
EDGE = b".,;:!?\"'()[]{}<>*#%&$|-_"
#: Words whose inputs a worker keeps.
KEEP = 200_000


def words_of(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every 3-, 4- and 5-gram of <word>, (3, positions); the first position of each word; number of grams."""
    joined = b"".join(b"<" + w + b">" for w in words)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(joined))
    codes = np.concatenate((np.frombuffer(joined, dtype=np.uint8), np.zeros(4, np.uint8))).astype(np.uint32)
    n, out = len(joined), []
    rolled = codes[:n] * np.uint32(31) + codes[1 : n + 1]
    for k in (3, 4, 5):
        rolled = rolled * np.uint32(0x01000193) + codes[k - 1 : k - 1 + n]
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append(np.where(left >= k, (mixed >> np.uint32(17)).astype(np.int64) % GRAM_ROWS, GRAM_ROWS))
    return np.stack(out), starts, np.maximum(sizes - 2, 0) + np.maximum(sizes - 3, 0) + np.maximum(sizes - 4, 0)


def _summed(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids and, for each, the sum of its rows of values (..., rows, columns)."""
    order = np.argsort(ids, kind="stable")
    found, starts = np.unique(ids[order], return_index=True)
    return found, np.add.reduceat(values[..., order, :], starts, axis=-2)


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % WORD_ROWS for w in words), dtype=np.int64, count=len(words))


def window_starts(n: int) -> list[int]:
    """Starts of the windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


@dataclass
class Network:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        g = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        h, d = HIDDEN, WIDTH
        p = {"word": g(WORD_ROWS, d, s=0.05), "gram": g(GRAM_ROWS + 1, d, s=0.1), "wx": g(2, d, 3 * h, s=0.4), "bx": np.zeros((2, 1, 3 * h), np.float32), "u": g(2, h, 3 * h, s=0.3), "va": g(2 * h, s=0.3), "w": g(2 * h, s=0.3), "b": np.zeros(1, np.float32)}
        p["gram"][-1] = 0
        return cls(p)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        grams, starts, count = _grams(words)
        total = sum(np.add.reduceat(self.p["gram"][row], starts, axis=0) for row in grams)
        return self.p["word"][_buckets(words)] + total / count[:, None].astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(2, words, 3 * HIDDEN)."""
        return np.matmul(x, self.p["wx"]) + self.p["bx"]

    def forward(self, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray, trace: bool = False):
        p, h = self.p, HIDDEN
        n, steps = ids.shape
        state = np.zeros((2, n, h), np.float32)
        states = np.zeros((2, steps, n, h), np.float32)
        kept = []
        for t in range(steps):
            at = (t, steps - 1 - t)
            inp = np.stack((proj[0][ids[:, at[0]]], proj[1][ids[:, at[1]]]))
            m = np.stack((mask[:, at[0]], mask[:, at[1]]))[:, :, None]
            rec = np.matmul(state, p["u"])
            gates = np.clip(0.25 * (inp[..., : 2 * h] + rec[..., : 2 * h]) + 0.5, 0, 1)
            z, r = gates[..., :h], gates[..., h:]
            c = np.tanh(inp[..., 2 * h :] + r * rec[..., 2 * h :])
            if trace:
                kept.append((state, gates, c, rec[..., 2 * h :], m))
            state = state + m * z * (c - state)
            states[0, at[0]], states[1, at[1]] = state[0], state[1]
        both = np.concatenate((states[0], states[1]), axis=2).transpose(1, 0, 2)
        a = np.where(mask > 0, both @ p["va"], -1e9)
        a = np.exp(a - a.max(axis=1, keepdims=True)) * mask
        alpha = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", alpha, both)
        logit = pooled @ p["w"] + p["b"][0]
        return (logit, both, alpha, pooled, kept) if trace else logit

    def gradients(self, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean log loss: by parameter, and by the projected inputs."""
        p, h = self.p, HIDDEN
        logit, both, alpha, pooled, kept = self.forward(proj, ids, mask, trace=True)
        n, steps = ids.shape
        d = ((1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
        g = {"w": pooled.T @ d, "b": np.array([d.sum()])}
        d_pool = d[:, None] * p["w"]
        d_alpha = np.einsum("nth,nh->nt", both, d_pool)
        d_a = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("nt,nth->h", d_a, both)
        d_both = alpha[..., None] * d_pool[:, None, :] + d_a[..., None] * p["va"]
        d_states = np.stack((d_both[..., :h], d_both[..., h:]))
        g["u"] = np.zeros_like(p["u"])
        d_proj = np.zeros_like(proj)
        d_inputs = np.zeros((2, steps, n, 3 * h), np.float32)
        carry = np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            at = (t, steps - 1 - t)
            carry = carry + np.stack((d_states[0][:, at[0]], d_states[1][:, at[1]]))
            state, gates, c, rec_c, m = kept[t]
            z, r = gates[..., :h], gates[..., h:]
            d_c = carry * m * z * (1 - c * c)
            d_gates = np.concatenate((carry * m * (c - state), d_c * rec_c), axis=2) * (0.25 * ((gates > 0) & (gates < 1)))
            d_rec = np.concatenate((d_gates, d_c * r), axis=2)
            d_in = np.concatenate((d_gates, d_c), axis=2)
            g["u"] += np.matmul(state.transpose(0, 2, 1), d_rec)
            carry = carry * (1 - m * z) + np.matmul(d_rec, p["u"].transpose(0, 2, 1))
            d_inputs[0, at[0]], d_inputs[1, at[1]] = d_in[0], d_in[1]
        found, summed = _summed(ids.T.ravel(), d_inputs.reshape(2, steps * n, 3 * h))
        d_proj[:, found] = summed
        return g, d_proj

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))


def _packed(docs: list[list[int]], picks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of the windows (document, start)."""
    ids = np.zeros((len(picks), WINDOW), np.int64)
    mask = np.zeros((len(picks), WINDOW), np.float32)
    for k, (d, s) in enumerate(picks):
        own = docs[d][s : s + WINDOW]
        ids[k, : len(own)] = own
        mask[k, : len(own)] = 1
    return ids, mask


def window_logits(net: Network, proj: np.ndarray, docs: list[list[int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    picks = [(d, s) for d, words in enumerate(docs) for s in window_starts(len(words))]
    out = np.empty(len(picks), np.float32)
    for k in range(0, len(picks), 512):
        out[k : k + 512] = net.forward(proj, *_packed(docs, picks[k : k + 512]))
    return out, picks


def _largest(values: np.ndarray, picks: list[tuple[int, int]], n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    best, where = np.full(n, -np.inf, np.float32), [(d, 0) for d in range(n)]
    for v, pick in zip(values.tolist(), picks, strict=True):
        if v > best[pick[0]]:
            best[pick[0]], where[pick[0]] = v, pick
    return best, where


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    y = np.array(labels, dtype=np.float32)
    net = Network.fresh(seed)
    if len(y) == 0 or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    index: dict[bytes, int] = {}
    docs = [[index.setdefault(w, len(index)) for w in words_of(t)] for t in texts]
    words = list(index)
    if not words:
        net.constant = float(y.mean())
        return net
    r = np.random.default_rng(seed)
    held = np.zeros((2, len(words)), np.float64)
    for words_in, label in zip(docs, y, strict=True):
        held[int(label), list(set(words_in))] += 1
    odds = np.log((held[1] + 0.5) / (y.sum() + 1)) - np.log((held[0] + 0.5) / (len(y) - y.sum() + 1))
    odds[held.sum(axis=0) < 2] = 0
    best = []
    for d, words_in in enumerate(docs):
        at = int(np.argmax(odds[words_in])) if words_in else 0
        fit = [s for s in window_starts(len(words_in)) if s <= at < s + WINDOW]
        best.append((d, fit[len(fit) // 2] if fit else 0))
    grams, starts, count = _grams(words)
    buckets = _buckets(words)
    ends = np.concatenate((starts[1:], [grams.shape[1]]))
    seen = {k: np.zeros_like(v) for k, v in net.p.items()}

    def update(name: str, grad: np.ndarray, rows: np.ndarray | None = None, rate: float = 0.05) -> None:
        at = slice(None) if rows is None else rows
        seen[name][at] += grad**2
        net.p[name][at] -= rate * grad / (np.sqrt(seen[name][at]) + 1e-6)

    windows = len(y) + int((y == 0).sum())
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // windows))):
        other = [(d, int(s)) for d in np.flatnonzero(y == 0) for s in [r.choice(window_starts(len(docs[d])))]]
        picks = np.array(best + other, dtype=np.int64)[r.permutation(len(best) + len(other))]
        for k in range(0, len(picks), BATCH):
            batch = [tuple(x) for x in picks[k : k + BATCH].tolist()]
            ids, mask = _packed(docs, batch)
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            # the grams of the words of the batch
            spans = [np.arange(starts[w], ends[w]) for w in used]
            owner = np.repeat(np.arange(len(used)), [len(s) for s in spans])
            rows = grams[:, np.concatenate(spans)]
            x = net.p["word"][buckets[used]].copy()
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            parts = sum(np.add.reduceat(net.p["gram"][row], first, axis=0) for row in rows)
            share = (1 / count[used]).astype(np.float32)[:, None]
            x += parts * share
            g, d_proj = net.gradients(net.projected(x), local, mask, y[[d for d, _ in batch]])
            d_x = np.matmul(d_proj, net.p["wx"].transpose(0, 2, 1)).sum(axis=0)
            update("wx", np.matmul(x.T, d_proj))
            update("bx", d_proj.sum(axis=1, keepdims=True))
            for name, grad in g.items():
                update(name, grad.astype(np.float32))
            for name, at, grad in (("word", buckets[used], d_x), ("gram", rows.ravel(), np.tile((d_x * share)[owner], (3, 1)))):
                touched, summed = _summed(at, grad)
                update(name, summed, touched)
            net.p["gram"][-1] = 0
        best_logit, best = _largest(*window_logits(net, net.projected(net.inputs(words)), docs), len(docs))
    # the map from a document's logit to its score, by Newton steps
    a = np.array([1.0, 0.0])
    z = np.stack((np.clip(best_logit, -20, 20), np.ones(len(y))), axis=1).astype(np.float64)
    for _ in range(20):
        q = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        hess = (z * (q * (1 - q))[:, None]).T @ z + 0.05 * np.eye(2)
        a -= np.linalg.solve(hess, z.T @ (q - y) + 0.05 * (a - [1.0, 0.0]))
    net.slope, net.shift = float(a[0]), float(a[1])
    return net


class Scorer:
    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.proj = np.zeros((2, KEEP + 100_000, 3 * HIDDEN), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            start = len(self.index)
            if start + len(part) > self.proj.shape[1]:
                self.proj = np.concatenate((self.proj, np.zeros_like(self.proj)), axis=1)
            self.index.update(zip(part, range(start, start + len(part)), strict=True))
            self.proj[:, start : start + len(part)] = self.net.projected(self.net.inputs(part))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        if len(self.index) > KEEP:
            self.clear()
        split = [words_of(t) for t in texts]
        new = {w for words in split for w in words if w not in self.index}
        if new:
            self._learn(list(new))
        docs = [list(map(self.index.__getitem__, words)) for words in split]
        return self.net.score(_largest(*window_logits(self.net, self.proj, docs), len(docs))[0].astype(np.float64))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """docs(doc_id, text), labels(doc_id, toxic) -> a network fitted on the bounded sample."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    short = docs.where(F.length("text") <= MOST_CHARS).select("doc_id", F.length("text").alias("n"))
    order = F.struct(F.xxhash64("doc_id"), F.col("doc_id"))
    known = known.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = known.where("toxic = 1").orderBy(order).limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy(order).limit(MOST_CLEAN))
    rows = docs.where(F.length("text") <= MOST_CHARS).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = sorted((r.doc_id, r.text, r.toxic) for r in rows.toLocalIterator())
    return train([t.encode("utf-8", "surrogatepass") for _, t, _ in rows], [y for _, _, y in rows])


def scored(docs: DataFrame, net: Network, column: str = "_score") -> DataFrame:
    """docs with all columns and the score, of the whole text alone, in `column`."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()))

    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.schema.names.index("text")).cast(pa.binary()).to_pylist()]
            out, start, size = [], 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= 400_000 or k == len(texts) - 1:
                    out.append(scorer.scores(texts[start : k + 1]))
                    start, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
