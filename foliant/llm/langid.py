"""Language identification by a bidirectional gated recurrent network over bytes.

A word with its two boundary bytes is a sequence; gated recurrent units read it in both directions,
every position is labelled with language probabilities, and a document's probabilities pool those
of all its positions. Longer words are read in pieces, so all bytes of the text are labelled. Words
that recur are read once and remembered, which changes speed and never a result.

Training is numpy with backpropagation through time, on a sample bounded by documented
parameters: at most `sample_docs` expected documents a language, chosen by hash, and of their words
the `sample_words` of least hash a language. The model has a fixed size and is broadcast.

Defined cases: null texts and texts without a letter are `und` with score 0; without a labelled
document all texts are `und`; ties go to the label that sorts first; repeated rows are predicted alike;
labels of other rows, ids and sources are never inputs; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import _tools as tools

PIECE = 24  # bytes of a word read together
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    sample_docs: int = 400
    sample_words: int = 6000
    hidden: int = 16
    embedding: int = 12
    epochs: int = 6
    batch: int = 256
    rate: float = 0.01
    seed: int = 5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters by name; sequences are columns of a (time, batch) byte array, padded by 0."""

    def __init__(self, labels: list[str], t: Training):
        rng = np.random.default_rng(t.seed)
        h, e, n = t.hidden, t.embedding, len(labels)
        self.labels, self.hidden = labels, h
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": draw(256, e) * np.float32(8), "out": draw(2 * h, n), "bias": np.zeros(n, np.float32)}
        for way in "fb":
            self.p |= {f"{way}_in": draw(e, 3 * h), f"{way}_zr": draw(h, 2 * h), f"{way}_n": draw(h, h), f"{way}_b": np.zeros(3 * h, np.float32)}

    def _read(self, way: str, x: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) of one direction; padded steps hold the state."""
        h, p = self.hidden, self.p
        inputs = (p["embed"] @ p[f"{way}_in"] + p[f"{way}_b"])[x]  # a table of 256 rows
        state = np.zeros((x.shape[1], h), np.float32)
        states, trace = np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            zr = _sigmoid(inputs[t, :, : 2 * h] + state @ p[f"{way}_zr"])
            z, r = zr[:, :h], zr[:, h:]
            held = r * state
            new = np.tanh(inputs[t, :, 2 * h :] + held @ p[f"{way}_n"])
            z = np.where(live[t][:, None], z, np.float32(0))
            if keep:
                trace.append((t, state, z, r, held, new))
            state = state + z * (new - state)
            states[t] = state
        return states, trace

    def probabilities(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """(time, batch, labels) of every position."""
        both = np.concatenate([self._read("f", x, live, False)[0], self._read("b", x, live, False)[0]], axis=2)
        logits = both @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, live: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Weighted mean cross-entropy over live positions, and its gradients."""
        h, p = self.hidden, self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        read = {way: self._read(way, x, live, True) for way in "fb"}
        both = np.concatenate([read["f"][0], read["b"][0]], axis=2)
        logits = both @ p["out"] + p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        w = (live * weight).astype(np.float32)
        w /= w.sum()
        picked = np.take_along_axis(prob, np.broadcast_to(label[None, :, None], (*x.shape, 1)), axis=2)[:, :, 0]
        loss = float(-(w * np.log(picked + 1e-12)).sum())
        d = prob
        d[:, np.arange(x.shape[1]), label] -= 1
        d *= w[:, :, None]
        g["out"] = np.einsum("tbh,tbl->hl", both, d)
        g["bias"] = d.sum((0, 1))
        d_both = d @ p["out"].T
        for k, way in enumerate("fb"):
            d_state = np.zeros((x.shape[1], h), np.float32)
            d_in = np.zeros((*x.shape, 3 * h), np.float32)
            for t, state, z, r, held, new in reversed(read[way][1]):
                d_state = d_state + d_both[t, :, k * h : (k + 1) * h]
                d_new = d_state * z * (1 - new * new)
                d_z = d_state * (new - state) * z * (1 - z)
                d_held = d_new @ p[f"{way}_n"].T
                d_r = d_held * state * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                g[f"{way}_n"] += held.T @ d_new
                g[f"{way}_zr"] += state.T @ d_zr
                d_in[t, :, : 2 * h], d_in[t, :, 2 * h :] = d_zr, d_new
                d_state = d_state * (1 - z) + d_held * r + d_zr @ p[f"{way}_zr"].T
            table = np.zeros((256, 3 * h), np.float32)
            np.add.at(table, x, d_in)
            g[f"{way}_in"] = p["embed"].T @ table
            g[f"{way}_b"] = table.sum(0)
            g["embed"] += table @ p[f"{way}_in"].T
        return loss, g


def columns(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as the columns of a (time, batch) array, with the mask of their positions."""
    sizes = np.array([len(s) for s in pieces])
    live = np.arange(sizes.max())[:, None] < sizes[None, :]
    x = np.zeros(live.shape, np.uint8)
    x.T[live.T] = np.frombuffer(b"".join(pieces), np.uint8)
    return x, live


def pieces(word: bytes) -> list[bytes]:
    """The word between two spaces, cut into pieces."""
    word = b" " + word + b" "
    return [word[i : i + PIECE] for i in range(0, len(word), PIECE)]


def train(words: list[tuple[str, bytes, int]], t: Training = Training()) -> Network:
    """A network from (label, word, count); words in several languages pull both ways."""
    labels = sorted({w[0] for w in words})
    net = Network(labels, t)
    rows = [(s, labels.index(a), n) for a, w, n in words for s in pieces(w)]
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i][0]), rows[i]))
    batches = [order[i : i + t.batch] for i in range(0, len(order), t.batch)]
    rng = np.random.default_rng(t.seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    # languages weigh alike, and common words only by the logarithm of their count
    share = {i: 1e-9 for i in range(len(labels))}
    for _, a, n in rows:
        share[a] += 1 + np.log(n)
    for epoch in range(t.epochs):
        rate = t.rate * (1 - epoch / t.epochs)
        for b in rng.permutation(len(batches)):
            part = [rows[i] for i in batches[b]]
            x, live = columns([s for s, _, _ in part])
            label = np.array([a for _, a, _ in part])
            weight = np.array([(1 + np.log(n)) / share[a] for _, a, n in part], np.float32)
            _, g = net.gradients(x, live, label, weight / weight.max())
            step += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """Pools a network's position probabilities over texts."""

    def __init__(self, net: Network, remember: int = 300_000):
        self.net, self.remember = net, remember
        self.at: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(net.labels) + 1), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        """Adds rows (sum of each label's probabilities over positions, positions) of the words."""
        cut = [(i, s) for i, w in enumerate(words) for s in pieces(w)]
        cut.sort(key=lambda c: len(c[1]))
        out = np.zeros((len(words), len(self.net.labels) + 1), np.float32)
        for i in range(0, len(cut), 2048):
            part = cut[i : i + 2048]
            x, live = columns([s for _, s in part])
            prob = self.net.probabilities(x, live) * live[:, :, None]
            owner = np.array([k for k, _ in part])
            np.add.at(out, owner, np.concatenate([prob.sum(0), live.sum(0)[:, None].astype(np.float32)], axis=1))
        self.at.update(zip(words, range(len(self.sums), len(self.sums) + len(words))))
        self.sums = np.concatenate([self.sums, out])

    def read(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text (rows of zeros for texts without a word)."""
        split = [t.split() for t in texts]
        if len(self.at) > self.remember:
            self.at, self.sums = {}, self.sums[:0]
        new = set().union(*split).difference(self.at) if split else set()
        if new:
            self._learn(sorted(new))
        sizes = np.array([len(w) for w in split])
        total = np.zeros((len(texts), self.sums.shape[1]))
        some = np.flatnonzero(sizes)
        if len(some):
            rows = np.fromiter((i for w in split for i in map(self.at.__getitem__, w)), np.int64, sizes.sum())
            starts = (np.cumsum(sizes) - sizes)[some]
            total[some] = np.add.reduceat(self.sums[rows], starts, axis=0, dtype=np.float64)
        return total[:, :-1] / np.maximum(total[:, -1:], 1)


def sample(docs: DataFrame, doc_id: str, text: str, label: str, learn, t: Training) -> list[tuple[str, bytes, int]]:
    """(label, word, count) of the bounded training sample."""
    labelled = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull())
    n = labelled.groupBy(label).count()
    per = {r[label]: r["count"] for r in n.collect()}  # one row a language
    if not per:
        return []
    # documents under a threshold of hash, expected to be sample_docs of each language
    share = F.element_at(F.create_map(*(F.lit(x) for k, c in per.items() for x in (k, min(1.0, t.sample_docs / c)))), F.col(label))
    mark = F.shiftrightunsigned(F.xxhash64(F.lit(t.seed), F.col(doc_id)), 11) / float(1 << 53)
    words = labelled.where(mark < share).select(F.col(label).alias("label"), F.explode(tools.words(tools.ascii_lower(F.col(text)))).alias("word"))
    counts = words.groupBy("label", "word").count()
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("word"), "word"))
    chosen = counts.withColumn("rank", rank).where(F.col("rank") <= t.sample_words)
    return sorted((r.label, r.word.encode("utf-8", "surrogatepass"), r["count"]) for r in chosen.collect())


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", held_out=None, training: Training = Training()) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learns from the rows not held out."""
    hold = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    words = sample(docs, doc_id, text, label, ~hold, training)
    net = docs.sparkSession.sparkContext.broadcast(train(words, training) if words else None)
    slim = docs.select(F.col(doc_id).alias("doc_id"), hold.alias("held_out"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net.value) if net.value else None
        for batch in batches:
            texts, letters, said, score, begin, size = batch.column(2).to_pylist(), batch.column(3).to_pylist(), [], [], 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size <= 4_000_000 and i + 1 < len(texts):
                    continue
                pooled = reader.read([tools.lower_bytes(x) for x in texts[begin : i + 1]]) if reader else None
                for j in range(begin, i + 1):
                    best = int(pooled[j - begin].argmax()) if reader and letters[j] else None
                    said.append(UNKNOWN if best is None else reader.net.labels[best])
                    score.append(0.0 if best is None else min(1.0, float(pooled[j - begin, best])))
                begin, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
