"""Removal of repeated passages of words: seed and extend.

Seeds are winnowed anchors, grams of 5 words (see repeats.py): a window of LENGTH words has one anchor, and equal windows have
equal anchors at equal places. Places of one gram meet, and each is matched with the earliest of them, the leader: the match is
extended word by word both ways, as far as windows of that anchor reach, and if it has LENGTH words or more it is a maximal
repeat, whose windows all start earlier in the leader. What a place has beyond its match lies beyond its first mismatch with the
leader on the right or on the left. Places that share a window there share that mismatch too, so they meet again under it, with a
leader of their own, in the next round. A round costs one comparison for each place, whatever a group's size, and the words that
a group shares grow in every round, so there are fewer rounds than LENGTH.

Runs of windows that are equal as a whole are taken once before the rounds: all but the first of them repeat.

Defined results: a null text has no words; texts under LENGTH words keep all; of equal windows the earliest stays, by id, then
place; rows with one id but different texts follow their text hash; equal rows (same id and text) are one document; a null id
comes first; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, mixed, word_bounds, written
from .repeats import WORK_BYTES, Plan, beside, covered, first_round, keyed, of_documents

LENGTH = 20
PLAN = Plan(length=LENGTH, grams=16, words=True)
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
#: A place of a seed: its group, where it is, the first and last window's distance, and the words about it (absent ones are 0).
_PLACE = ["h", "doc_id", "key", "place", "near", "far"]
_PLACES = ", ".join(f"{c} long" for c in _PLACE) + ", words binary"
_ARROW = pa.schema([(c, pa.int64()) for c in _PLACE] + [("words", pa.binary())])


def _binary(matrix: np.ndarray) -> pa.Array:
    """A row's bytes each."""
    width = matrix.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(np.arange(0, (len(matrix) + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def places(docs: DataFrame, left: DataFrame, plan: Plan) -> DataFrame:
    """The seeds of left (h, doc_id, key, pos) with the words that their windows cover."""
    before, width = plan.grams - 1, plan.grams - 1 + plan.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", WORK_BYTES):
                for r in range(len(rows)):
                    own = data[offsets[r] : offsets[r + 1]]
                    words, _ = plan.symbols(own, np.array([0, len(own)]))
                    pos = rows.column(4)[r].values.to_numpy()
                    place, near, far = pos >> 16, pos >> 8 & 255, pos & 255
                    step = np.arange(width)[None, :] - before
                    inside = (step >= -far[:, None]) & (step < plan.length - near[:, None])
                    about = np.where(inside, words[np.where(inside, place[:, None] + step, 0)], np.uint64(0))
                    same = lambda v: pa.array([v] * len(pos), pa.int64())  # noqa: E731, B023
                    longs = [rows.column(3)[r].values, same(rows.column(0)[r].as_py()), same(rows.column(1)[r].as_py()), *map(pa.array, (place, near, far))]
                    yield pa.RecordBatch.from_arrays([*longs, _binary(about)], schema=_ARROW)

    return of_documents(docs, left).mapInArrow(run, _PLACES)


def extended(mine: np.ndarray, led: np.ndarray, near: np.ndarray, far: np.ndarray, near_led: np.ndarray, far_led: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """How many words before the seed's place match the leader's, and how many from it on; both within the windows that each has."""
    before = plan.grams - 1
    step = np.arange(mine.shape[1])[None, :] - before
    inside = lambda n, f: (step >= -f[:, None]) & (step < plan.length - n[:, None])
    equal = (mine == led) & inside(near, far) & inside(near_led, far_led)
    until = lambda e: np.where(e.all(axis=1), e.shape[1], e.argmin(axis=1))
    return until(equal[:, before - 1 :: -1]) if before else np.zeros(len(mine), np.int64), until(equal[:, before:])


def matched(rows: DataFrame, plan: Plan) -> DataFrame:
    """A round: for each place but the leaders, its repeated windows (words is null), and those beyond the match under their new groups."""
    place = F.struct("doc_id", "key", "place", "near", "far", "words")
    leaders = written(rows.groupBy("h").agg(F.min(place).alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", *[F.col(f"l.{c}").alias(f"{c}_led") for c in ("doc_id", "key", "place", "near", "far", "words")]))
    joined = rows.join(leaders, "h").where(~(F.col("doc_id").eqNullSafe(F.col("doc_id_led")) & (F.col("key") == F.col("key_led")) & (F.col("place") == F.col("place_led"))))
    joined = joined.select(*_PLACE, "words", "near_led", "far_led", "words_led")
    before, width = plan.grams - 1, plan.grams - 1 + plan.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            of = lambda k: batch.column(k).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            grid = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(n, width)  # noqa: E731, B023
            mine, near, far, h = grid(6), of(4), of(5), of(0).astype(np.int64).view(np.uint64)
            back, on = extended(mine, grid(9), near, far, of(7), of(8), plan)
            row = np.arange(n)

            def part(take: np.ndarray, group: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, words: bool) -> pa.RecordBatch:
                at = pa.array(np.flatnonzero(take))
                columns = [pa.array(group[take].view(np.int64)), *(batch.column(k).take(at) for k in (1, 2, 3)), pa.array(nearest[take]), pa.array(farthest[take])]  # noqa: B023
                return pa.RecordBatch.from_arrays([*columns, batch.column(6).take(at) if words else pa.nulls(len(at), pa.binary())], schema=_ARROW)  # noqa: B023

            yield part(back + on >= plan.length, h, plan.length - on, back, False)
            # Windows that hold the first word that differs on the right: they start plan.length - 1 words before it at most.
            far_right = np.minimum(far, plan.length - 1 - on)
            right = mixed(h + mixed((on * 2 + 1).astype(np.uint64)) ^ mine[row, np.minimum(before + on, width - 1)])
            yield part(far_right >= near, right, near, far_right, True)
            # Those that hold the first on the left, and none on the right.
            near_left = np.maximum(np.maximum(back + 1, plan.length - on), near)
            left = mixed(h + mixed((back * 2).astype(np.uint64)) ^ mine[row, np.maximum(before - back - 1, 0)])
            yield part(far >= near_left, left, near_left, far, True)

    return joined.mapInArrow(run, _PLACES)


def repeating(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """(doc_id, key, pos): the runs of windows of keyed docs that start earlier elsewhere."""
    seeds = written(first_round(docs, plan))
    token = F.xxhash64("doc_id", "key", "pos")
    several = written(seeds.groupBy("h").agg(F.min(token).alias("lo"), F.max(token).alias("hi")).where("lo <> hi").select("h"))
    rows = written(seeds.join(several, "h", "left_semi"))
    discard(seeds, several)
    at = F.struct("doc_id", "key", "pos")
    kinds = written(rows.groupBy("h", "c").agg(F.min(at).alias("first"), F.max(at).alias("last")))
    copied = written(kinds.where("first <> last").select("h", "c", "first"))
    hits = written(rows.join(copied, ["h", "c"]).where(at != F.col("first")).select("doc_id", "key", "pos"))
    split = written(kinds.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h"))
    left = written(kinds.join(split, "h", "left_semi").select("h", "first.*"))
    discard(rows, kinds, copied, split)
    if left.isEmpty():
        return hits
    work = written(places(docs, left, plan))
    discard(left)
    while True:
        found = written(matched(work, plan))
        pos = F.shiftleft("place", 16).bitwiseOR(F.shiftleft("near", 8)).bitwiseOR(F.col("far"))
        hits = hits.unionByName(found.where("words is null").select("doc_id", "key", pos.alias("pos")))
        work = found.where("words is not null")
        if work.isEmpty():
            return hits


def kept_words(data: np.ndarray, ps: np.ndarray | None, plan: Plan = PLAN) -> tuple[bytes, np.ndarray]:
    """(the words that stay, joined by one space; which words go)."""
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    gone = covered(ps, len(starts), plan.length)
    raw = data.tobytes()
    stay = ~gone
    return b" ".join(raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)), gone


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
                    kept, gone = kept_words(data[offsets[r] : offsets[r + 1]], ps.values.to_numpy() if ps.is_valid else None, plan)
                    out.append((len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x) for x in zip(*out, strict=True))], schema=_SCHEMA)

    return found.mapInArrow(run, DIGEST)
