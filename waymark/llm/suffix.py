"""Removal of long repeated stretches of bytes, by distributed prefix doubling.

A suffix is a place in a text, its rank that of its first bytes. Spark sorts the pairs (rank, rank at an offset), numbers them
in their order, and the new rank is of a prefix twice as long; the offset grows, suffixes whose rank is unique leave, and at
LENGTH bytes those that are left repeat.

A row for each byte and round would move some 100 times the input, so only suffixes take part that can still repeat, several
neighbours as one row where they can only repeat together:

1. A window of LENGTH bytes holds GRAMS grams of LENGTH - GRAMS + 1 bytes; that of the smallest hash is its anchor. Equal windows
   have equal anchors at equal places, so windows whose anchor's gram is unique are unique, and a window has to be compared with
   those of the same gram and the same distance to it only. A row stands for the run of windows that share an anchor.
2. Windows of a run all hold the stretch between the last one's start and the first one's end. Its rank is that of the gram at
   first, and in later rounds it is found by doubling: four ranks of a quarter each, pairs at an offset of one quarter, then
   pairs at an offset of two. If it is unique, so is every window of the run, and the run leaves.
3. The pair (rank, name of the bytes on both sides) tells whole runs apart. Equal runs repeat in every window, and one of them
   goes on for the others. Where runs of one rank differ, they are cut (256, 16, 1 windows): the shared stretch grows from 145
   to 385 to 400 bytes, and at one window it is the window itself.

First names are 64-bit hashes of the text; from then on ranks are numbers given by sorting. Minima and maxima are formed before
rows move, and joins read written tables, so a hot rank is one row for each task, or is split.

Defined results: a null text counts as empty; texts under LENGTH bytes keep all; equal rows (same id and text) are one
document, so they are no repeats of each other; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, Prefix, blocks, discard, mixed, written
from .repeats import WORK_BYTES, Plan, beside, covered, first_round, keyed, of_documents

LENGTH, GRAMS = 400, 256
#: Windows of a run in the rounds after the first.
CUTS = (16, 1)
PLAN = Plan(length=LENGTH, grams=GRAMS, words=False)
#: Parts of a stretch whose names the doubling starts from: two rounds of pairs.
PARTS = 4
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_NAMES = [f"n{k}" for k in range(PARTS)]
_RUNS = ["doc_id", "key", "pos", "at", *_NAMES, "e"]


def _step(length: int) -> int:
    """The first offset of the doubling for a stretch of this length."""
    return length // PARTS


def part_names(text: Prefix, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """The names of PARTS parts of the stretches, equally long and _step(length) apart, the last one to the stretch's end."""
    step = _step(length)
    width = length - (PARTS - 1) * step
    return [text.of(starts + k * step, starts + k * step + width) for k in range(PARTS)]


def cut_runs(docs: DataFrame, left: DataFrame, cut: int, length: int) -> DataFrame:
    """The runs of left (h, doc_id, key, pos) in parts of `cut` windows: pos, the start and the names of their shared stretch, and e, a name of the bytes on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", WORK_BYTES):
                for r in range(len(rows)):
                    own = data[offsets[r] : offsets[r + 1]]
                    a, b = Prefix(own, BASE_A), Prefix(own, BASE_B)
                    h = rows.column(3)[r].values.to_numpy().view(np.uint64)
                    pos = rows.column(4)[r].values.to_numpy()
                    near, far = pos >> 8 & 255, pos & 255
                    many = far // cut - near // cut + 1
                    of = np.repeat(np.arange(len(pos)), many)
                    d0 = ((near // cut)[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * cut
                    place = (pos >> 16)[of]
                    start, shared = place - d0, length - cut + 1
                    names = part_names(a, start, shared)
                    names[0] = mixed(names[0] + mixed(h[of] + d0.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    first, last = start - cut + 1, start + length
                    inside = (first >= 0) & (last <= len(own))
                    ends = mixed(b.of(np.where(inside, first, 0), np.where(inside, start, 0))) + b.of(np.where(inside, start + shared, 0), np.where(inside, last, 0))
                    key = np.full(len(of), rows.column(1)[r].as_py(), np.int64)
                    alone = mixed(key.view(np.uint64) ^ mixed((place * 256 + d0).astype(np.uint64)))
                    part = place << 16 | np.maximum(near[of], d0) << 8 | np.minimum(far[of], d0 + cut - 1)
                    longs = [x.view(np.int64) for x in (*names, np.where(inside, ends, alone))]
                    yield pa.RecordBatch.from_arrays([pa.array([rows.column(0)[r].as_py()] * len(of), pa.int64()), *map(pa.array, (key, part, start, *longs))], names=_RUNS)

    return of_documents(docs, left).mapInArrow(run, ", ".join(f"{c} long" for c in _RUNS))


def _suffix(offset: int = 0) -> Column:
    """Tells suffixes apart: the document's row and the place in it."""
    return F.xxhash64("doc_id", "key", F.col("at") + offset).alias("suffix")


def ranked(pairs: DataFrame) -> DataFrame:
    """(x, y, rank) of the pairs (x, y, suffix) that several suffixes have, numbered in their order. Unique ones have no rank."""
    several = pairs.groupBy("x", "y").agg(F.min("suffix").alias("lo"), F.max("suffix").alias("hi")).where("lo <> hi").select("x", "y")
    return written(several.repartitionByRange("x", "y").sortWithinPartitions("x", "y").withColumn("rank", F.monotonically_increasing_id()))


def doubled(runs: DataFrame, length: int) -> DataFrame:
    """runs (written) whose stretches of this length several suffixes begin with: (doc_id, key, pos, h, e), h being the rank of the stretch."""
    step = _step(length)
    pairs = runs.select(F.col("n0").alias("x"), F.col("n1").alias("y"), _suffix()).unionByName(runs.select(F.col("n2").alias("x"), F.col("n3").alias("y"), _suffix(2 * step)))
    ranks = ranked(pairs)
    of = lambda x, y, name: ranks.select(F.col("x").alias(x), F.col("y").alias(y), F.col("rank").alias(name))
    halves = written(runs.join(of("n0", "n1", "x"), ["n0", "n1"]).join(of("n2", "n3", "y"), ["n2", "n3"]).select("doc_id", "key", "pos", "at", "x", "y", "e"))
    whole = ranked(halves.select("x", "y", _suffix()))
    out = written(halves.join(whole, ["x", "y"]).select("doc_id", "key", "pos", F.col("rank").alias("h"), "e"))
    discard(ranks, halves, whole)
    return out


def whole_runs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of runs that occur more than once as a whole, one run of each kind where a rank has several kinds), both written; rows: (doc_id, key, pos, h, e), written."""
    place = F.struct("doc_id", "key", "pos")
    kinds = written(rows.groupBy("h", "e").agg(F.min(place).alias("first"), F.max(place).alias("last")))
    several = written(kinds.where("first <> last").select("h", "e"))
    hit = written(rows.join(several, ["h", "e"], "left_semi").select("doc_id", "key", "pos"))
    split = written(kinds.groupBy("h").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).where("lo <> hi").select("h"))
    left = written(kinds.join(split, "h", "left_semi").select("h", "first.*"))
    discard(kinds, several, split)
    return hit, left


def repeating(docs: DataFrame, plan: Plan = PLAN, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(doc_id, key, pos): the runs of windows of keyed docs that occur elsewhere too."""
    grams = written(first_round(docs, plan).withColumnRenamed("c", "e"))
    several = written(grams.groupBy("h").agg(F.min(F.xxhash64("doc_id", "key", "pos")).alias("lo"), F.max(F.xxhash64("doc_id", "key", "pos")).alias("hi")).where("lo <> hi").select("h"))
    rows = written(grams.join(several, "h", "left_semi"))
    hit, left = whole_runs(rows)
    discard(grams, several, rows)
    hits = hit
    for cut in cuts:
        if left.isEmpty():
            break
        runs = written(cut_runs(docs, left, cut, plan.length))
        rows = doubled(runs, plan.length - cut + 1)
        if cut == 1:
            return hits.unionByName(rows.select("doc_id", "key", "pos"))
        hit, left = whole_runs(rows)
        discard(runs, rows)
        hits = hits.unionByName(hit)
    return hits


def kept_bytes(data: np.ndarray, ps: np.ndarray | None, plan: Plan = PLAN) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes that stay, which bytes go)."""
    gone = covered(ps, len(data), plan.length)
    return data[~gone], gone


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan = PLAN) -> DataFrame:
    """One row for each row of docs: what was removed, and the digest of what stays."""
    own = keyed(docs, doc_id, text)
    found = beside(own, repeating(own, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", WORK_BYTES):
                out = []
                for r in range(len(rows)):
                    ps = rows.column(2)[r]
                    kept, gone = kept_bytes(data[offsets[r] : offsets[r + 1]], ps.values.to_numpy() if ps.is_valid else None, plan)
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((len(gone), int(gone.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x) for x in zip(*out, strict=True))], schema=_SCHEMA)

    return found.mapInArrow(run, DIGEST)
