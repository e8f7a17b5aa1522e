"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A batch's distinct pre-tokens are laid end to end in one integer array. In each round every
sequence finds its lowest-ranked adjacent pair and applies it at all its places at once; a
sequence leaves the batch when no pair of it has a rank. What is left of it is its token count.
A merge only makes pairs of higher rank, so this equals merging one pair at a time.

Counting runs inside the scan's tasks, without a shuffle. Counts of pre-tokens are remembered up
to a fixed number of them per task, a memory that changes speed and never a count.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows are counted each;
an empty table gives an empty table; only the two named columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The usual pre-token pattern of byte-level vocabularies (fixed value, part of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBER = 500_000
_HIGH = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The format's printable stand-ins of the 256 bytes: themselves, or 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranks of a vocabulary file as sorted arrays: pair key, rank, token made."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.base = 1 << max(vocab.values()).bit_length()
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = _byte_letters()
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _HIGH)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty byte sequence."""
        out = np.array([len(s) for s in sequences], np.int64)
        live = np.arange(len(sequences))
        tokens = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(live, out)
        if not len(tokens):
            return out
        ranks = np.full(len(tokens), _HIGH)  # of a token and the one after it
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inner] = self.ranks_of(tokens[inner], tokens[inner + 1])
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(tokens)])
            out[owner[starts]] = sizes
            going = best < _HIGH
            if not going.all():  # the others are done
                stay = np.repeat(going, sizes)
                tokens, owner, ranks, best, sizes = tokens[stay], owner[stay], ranks[stay], best[going], sizes[going]
            if not len(tokens):
                return out
            hit = ranks == np.repeat(best, sizes)
            at = np.flatnonzero(hit)
            # in a run of overlapping places (aaa) every second one merges, from the left
            run = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            tokens[at] = self.made[ranks[at]]
            alive = np.ones(len(tokens), bool)
            alive[at + 1] = False
            fresh = np.zeros(len(tokens), bool)  # whose pair has changed
            fresh[at] = True
            before = at - 1
            before = before[before >= 0]
            before = np.where(alive[before], before, before - 1)
            fresh[before[before >= 0]] = True
            tokens, owner, ranks, fresh = tokens[alive], owner[alive], ranks[alive], np.flatnonzero(fresh[alive])
            ranks[fresh] = _HIGH
            fresh = fresh[fresh + 1 < len(tokens)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            ranks[fresh] = self.ranks_of(tokens[fresh], tokens[fresh + 1])


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts tokens of texts, remembering pre-tokens within a bound."""

    def __init__(self, path: str, remember: int = REMEMBER):
        import regex

        self.merges, self.remember, self.known = _merges(path), remember, {}
        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(regex.escape(s) for s in self.merges.specials)) if self.merges.specials else None

    def count(self, texts: list[str | None]) -> list[int]:
        known, parts, extra = self.known, [], []
        for text in texts:
            text, n = text or "", 0
            if self.specials and any(s in text for s in self.merges.specials):
                pieces = self.specials.split(text)
                n, found = len(pieces) - 1, [t for p in pieces for t in self.find(p)]
            else:
                found = self.find(text)
            parts.append(found)
            extra.append(n)
        new = set().union(*parts).difference(known) if parts else set()
        if new:
            new = list(new)
            if len(known) + len(new) > self.remember:
                known = {t: known[t] for found in parts for t in found if t in known}
            known.update(zip(new, self.merges.count([t.encode("utf-8", "surrogatepass") for t in new]).tolist()))
            self.known = known if len(known) <= self.remember else {}
        get = known.__getitem__
        return [n + sum(map(get, found)) for n, found in zip(extra, parts)]


def _slices(texts: list[str | None], at_most: int = 4_000_000) -> Iterator[slice]:
    """Cut a batch so that a slice's texts are of bounded size (one text at least)."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > at_most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, under the vocabulary file at that path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts, n = batch.column(2).to_pylist(), []
            for part in _slices(texts):
                n += counter.count(texts[part])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    body = F.col(text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"), body.alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
