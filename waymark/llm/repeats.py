"""Winnowing of windows of a fixed length over whole corpora: what op7 and op8 share.

A window holds W grams of K symbols (W + K - 1 is its length); the gram of the smallest hash is its anchor, so equal windows
have equal anchors at equal places. An anchor stands for the run of windows that choose it: 2 in W symbols are anchors, not
all. Rows are one for each run:

  h   the hash of the anchor's gram, c the fingerprint of all that the run's windows cover,
  pos the anchor's place and the first and last window's distance to it.

Equal rows of the input (same id and text) are one document: an occurrence is told by id, text hash and place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, Prefix, blocks, mixed, row_key, word_bounds, word_hashes, written

#: Ids that may be broadcast to pick the texts of the next round; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Text bytes that a worker works on at once.
WORK_BYTES = 1 << 20
ROW = "doc_id long, key long, pos long, h long, c long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in ROW.split(", ")])


@dataclass(frozen=True)
class Plan:
    """length: symbols of a window; grams: grams of a window (a power of two, 256 at most); words: symbols are words, else bytes."""

    length: int
    grams: int
    words: bool

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the texts, and the place of each text's first."""
        if not self.words:
            return data, offsets
        starts, ends, first = word_bounds(data, offsets)
        return word_hashes(data, starts, ends), first


def runs(symbols: np.ndarray, first: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """(text, place of the anchor in it, nearest, farthest, h, c) of each run of windows with one anchor."""
    n, length, w = len(symbols), plan.length, plan.grams
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    k = length - w + 1
    a, b = Prefix(symbols, BASE_A), Prefix(symbols, BASE_B)
    rank = mixed((a.sums[k:] - a.sums[:-k]) * a.down[: n - k + 1])
    low, at, step = rank, np.arange(n - k + 1, dtype=np.int32), 1
    while step < w:
        left = low[:-step] <= low[step:]
        at = np.where(left, at[:-step], at[step:])
        low = np.where(left, low[:-step], low[step:])
        step *= 2
    edge = np.zeros(n + 2, np.int32)
    last = np.maximum(first[1:] - length + 1, first[:-1])
    np.add.at(edge, first[:-1], 1)
    np.add.at(edge, last, -1)
    p = np.flatnonzero(np.cumsum(edge[: n - length + 1]) > 0)
    if not len(p):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    anchor = at[p].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    start, end = p[new], p[np.concatenate([new[1:], [len(p)]]) - 1]
    anchor = anchor[new]
    text = np.searchsorted(first, start, "right") - 1
    near, far = anchor - end, anchor - start
    c = b.of(start, end + length) ^ mixed((near * 256 + far).astype(np.uint64))
    return text, anchor - first[text], near, far, rank[anchor], c


def first_round(docs: DataFrame, plan: Plan) -> DataFrame:
    """Rows for every run of windows of docs (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", WORK_BYTES):
                text, place, near, far, h, c = runs(*plan.symbols(data, offsets), plan)
                if len(text):
                    take = pa.array(text)
                    pos = place << 16 | near << 8 | far
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(pos), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], schema=_ARROW)

    return docs.mapInArrow(run, ROW)


def of_documents(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, key, text, hs, ps): the texts of docs that have rows (h, doc_id, key, pos), each once with all its rows."""
    mine = written(rows.groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "pos")).alias("l")).select("doc_id", "key", F.col("l.h").alias("hs"), F.col("l.pos").alias("ps")))
    ids = mine.select("doc_id", "key")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.key") == F.col(f"{y}.key"))
    some = docs.alias("d").join(few.alias("i"), same("d", "i"), "left_semi").alias("d")
    return some.join(mine.alias("m"), same("d", "m")).select("d.doc_id", "d.key", "d.text", "m.hs", "m.ps")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", row_key("doc_id", "text").alias("key"), "text")


def beside(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, text, ps) for each row of keyed docs, ps being the places of its rows in hits (doc_id, key, pos); null where it has none."""
    found = written(hits.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("ps"))).alias("f")
    d = docs.alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key"))
    return d.join(found, on, "left").select("d.doc_id", "d.text", "f.ps")


def covered(ps: np.ndarray | None, size: int, length: int) -> np.ndarray:
    """Which symbols of a text the windows cover."""
    if ps is None or not len(ps):
        return np.zeros(size, bool)
    place, near, far = ps >> 16, ps >> 8 & 255, ps & 255
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, place - far, 1)
    np.add.at(edge, place - near + length, -1)
    return np.cumsum(edge[:size]) > 0
