"""Exact dedup by a tree merge of sorted digest runs.

Rows become (digest, id) pairs, and tasks make sorted runs of them with one entry a digest. Runs then meet in
binomial rounds: in each, a slot cuts its run at the next three bits of the digests and trades the pieces with the
seven slots that differ from it in that digit, and every slot merges what it gets. After the last round a slot
holds all entries of one range of digests and of no other. Equal entries melt at every level, so a text that a third
of the rows share is one entry a run from the start, and no slot ever holds more than its share of the distinct ones.

An entry keeps the whole SHA-256 of its text. Runs are ordered by its first eight bytes; entries
that agree in these are told apart by all 32 (the verification at every level), so a chance agreement
of short digests merges nothing.

Cases: a null text equals an empty one. A null id loses to any other; a group of null ids has a null keep_id. Of
repeated rows (same id and text) exactly one stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import _tools as tools

#: Slots that trade in a round (three bits of a digest), and rows that a first run is made of.
_BITS, RUN_ROWS = 3, 1 << 16
FAN = 1 << _BITS
#: Groups above `hot_groups`-ths of all rows are few, so they may be broadcast.
HOT_ROWS, HOT_GROUPS = 64, 100_000
_PIECE = "slot long, digests binary, ids binary, named binary, rows binary, counts binary"
_GROUP = "digest binary, keep_id long, keep_row long, group_size long"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

#: A run: digests as four big-endian words a row, ids, whether an id is there, row numbers, counts.
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def merged(parts: list[Run], largest: bool) -> Run:
    """One run of several: sorted, one entry a digest, with the id that stays and its first row.

    A stable sort finds the runs that its input consists of and merges them.
    """
    words, ids, named, rows, counts = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(words[:, 0], kind="stable")
    w = words[order]
    near = w[1:, 0] == w[:-1, 0]
    if (near & (w[1:] != w[:-1]).any(axis=1)).any():  # short digests agree, long ones don't
        order = np.lexsort(words.T[::-1])
        w = words[order]
    starts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]).any(axis=1)]))
    ids, named, rows = np.where(named, ids, _LEAST if largest else _MOST)[order], named[order], rows[order]
    best = (np.maximum if largest else np.minimum).reduceat(ids, starts)
    holds = ids == np.repeat(best, np.diff(np.append(starts, len(ids))))
    first = np.minimum.reduceat(np.where(holds, rows, _MOST), starts)
    return w[starts], best, np.maximum.reduceat(named, starts), first, np.add.reduceat(counts[order], starts)


def _pieces(run: Run, slot: int, round_: int) -> pa.RecordBatch:
    """A run cut at the digit of a round, each piece with the slot that it goes to."""
    digit = (run[0][:, 0] >> np.uint64(64 - _BITS * (round_ + 1))) & np.uint64(FAN - 1)
    cuts = np.searchsorted(digit, np.arange(FAN + 1, dtype=np.uint64))
    place = FAN**round_
    own = slot - (slot // place % FAN) * place
    cut = [d for d in range(FAN) if cuts[d] < cuts[d + 1]]
    columns = [pa.array([own + d * place for d in cut], pa.int64())]
    columns += [pa.array([c[cuts[d] : cuts[d + 1]].tobytes() for d in cut], pa.binary()) for c in run]
    return pa.RecordBatch.from_arrays(columns, ["slot", "digests", "ids", "named", "rows", "counts"])


def _run(piece: dict) -> Run:
    kinds = {"ids": np.int64, "named": bool, "rows": np.int64, "counts": np.int64}
    return np.frombuffer(piece["digests"], np.uint64).reshape(-1, 4), *(np.frombuffer(piece[c], k) for c, k in kinds.items())


def _first_runs(rounds: int, largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            slot = (task * 31 + made) % FAN**rounds
            return _pieces(merged(held, largest), slot, 0)

        for batch in batches:
            for at in range(0, batch.num_rows, RUN_ROWS):
                part = batch.slice(at, RUN_ROWS)
                n, ids = part.num_rows, part.column("doc_id")
                words = np.frombuffer(b"".join(part.column("digest").to_pylist()), ">u8").reshape(n, 4).astype(np.uint64)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                held.append((words, ids.fill_null(0).to_numpy(), named, part.column("row").to_numpy(), np.ones(n, np.int64)))
                if sum(len(h[1]) for h in held) >= RUN_ROWS:
                    yield flush()
                    made, held = made + 1, []
        if held:
            yield flush()

    return run


def _trade(round_: int, rounds: int, largest: bool):
    """What a slot does in a round: merge its pieces, then cut them for the next round or tell its groups."""

    def run(pieces: pa.Table) -> pa.Table:
        out = merged([_run(p) for p in pieces.to_pylist()], largest)
        if round_ + 1 < rounds:
            return pa.Table.from_batches([_pieces(out, pieces.column("slot")[0].as_py(), round_ + 1)])
        words, ids, named, rows, counts = (c[out[4] > 1] for c in out)
        raw = words.astype(">u8").tobytes()
        digests = pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())
        return pa.table({"digest": digests, "keep_id": pa.array(ids, mask=~named), "keep_row": rows, "group_size": counts})

    return run


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=None) -> DataFrame:
    """row (unique), doc_id, digest (SHA-256, 32 bytes) of every row; only these leave the scan."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    said: Column = normalise(said) if normalise else said
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(said, 256)).alias("digest")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest")


def groups(keys: DataFrame, n_rows: int, keep: str = "smallest", run_rows: int = RUN_ROWS) -> DataFrame:
    """digest, keep_id, keep_row, group_size of every text that two or more rows hold."""
    largest, rounds = keep == "largest", 1
    while FAN**rounds * run_rows < n_rows:
        rounds += 1
    runs = keys.mapInArrow(_first_runs(rounds, largest), _PIECE)
    for r in range(rounds):
        runs = runs.groupBy("slot").applyInArrow(_trade(r, rounds, largest), _PIECE if r + 1 < rounds else _GROUP)
    return runs


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest", normalise=None, max_broadcast: int = 32 << 20, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, kept ones and others.

    keep is `smallest` or `largest`: which id of a group stays. Groups go back to their rows by a join; groups of more
    than 64 rows and of more than one in 100,000 rows are at most 100,000, so these are broadcast, and what is shuffled has no hot key.
    """
    keys = tools.stage(keyed(docs, doc_id, text, normalise))
    n = keys.count()
    found = tools.stage(groups(keys, n, keep, run_rows))
    hot_rows = max(HOT_ROWS, n // HOT_GROUPS)
    hot, cold = found.where(F.col("group_size") > hot_rows), found.where(F.col("group_size") <= hot_rows)
    told = keys.join(F.broadcast(hot), "digest", "left")
    rest = told.where("group_size is null").select("digest", "row", "doc_id").join(tools.broadcast_if_small(cold, max_broadcast), "digest", "left")
    every = told.where("group_size is not null").unionByName(rest)
    return every.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
