"""Near-duplicates by SetSketch registers.

Each document's set of word shingles is summed up in registers: the minimum of an exponentially distributed hash, truncated
to a whole power of BASE. Registers merge by their maximum, and two sets agree in a register with about the probability of
their Jaccard similarity. Bands of registers propose pairs, the joint maximum-likelihood estimate from registers that are
equal, larger and smaller discards those far below the threshold, and the full sets decide.

Equal sets form a class, of which one member goes on. A bucket proposes its members to its most central member only;
components follow, and only in buckets that still hold several components do the full sets of the others look for partners, by an
inverted index within the bucket. So a bucket of copies costs its size, no pairs are written but links, and no link between
different sets is lost but by the bands (see miss()): where the estimate errs, the pair is compared in that second pass.

Defined results: null and empty texts have no shingles and are linked with nothing; a text with fewer words than a shingle has
the whole sequence as its one shingle; rows that repeat an id are one document; a null id is linked with nothing, has a null
component and is kept."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, blocks, lowered, mixed, word_bounds, word_hashes, written
from .graph import components

#: Registers' base; near 1, registers tell almost as much as full minima.
BASE = 1.001
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: Registers are truncated to 0 .. LIMIT.
SHIFT, LIMIT = 4096, 32767
#: A pair whose estimate is so far below the threshold (5 standard deviations at REGISTERS) is no candidate.
MARGIN = 0.13
#: Members and shingles of a bucket that one task compares with as many; larger buckets are cut into pairs of blocks.
GROUP_ROWS, GROUP_ITEMS = 1024, 1_000_000
#: Ids that may be broadcast to pick the texts to verify; more are joined by shuffle.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_ROW = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def miss(similarity: float) -> float:
    """MISS: the probability that no band proposes a pair of this similarity."""
    return (1 - similarity**ROWS) ** BANDS


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = lowered(data)
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, BASE_A)
    n = len(words)
    whole = words.copy()
    for k in range(1, width):
        whole[: max(0, n - k)] = mixed(whole[: max(0, n - k)]) + words[k:]
    whole = mixed(whole)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = mixed(np.array([short]) ^ w)[0]
            yield np.array([short], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def registers(items: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    hi, lo = (items >> np.uint64(32)).astype(np.uint32), items.astype(np.uint32)
    for i in range(0, len(items), 1024):
        values = np.multiply.outer(hi[i : i + 1024], _A)
        values += np.multiply.outer(lo[i : i + 1024], _B)
        np.minimum(low, values.min(axis=0), out=low)
    e = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(e) / math.log(BASE)) + SHIFT, 0, LIMIT).astype(np.int16)


SKETCH = "doc_id long, n long, f1 long, f2 long, sketch binary"


def sketches(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, f1, f2, sketch): size, 128-bit fingerprint and registers of each row's set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                n, f1, f2, out = [], [], [], []
                for items in shingles(data, offsets, width):
                    n.append(len(items))
                    f1.append(mixed(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    f2.append(mixed(items + np.uint64(0x1234567812345678)).sum(dtype=np.uint64))
                    out.append(registers(items).tobytes() if len(items) else None)
                as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), as_long(f1), as_long(f2), pa.array(out, pa.binary())], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SKETCH)


def _keys(registers: np.ndarray) -> np.ndarray:
    """The key of each band of each row of registers."""
    k = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    keys = np.zeros((len(registers), BANDS), np.uint64) + _BAND
    for j in range(ROWS):
        keys = mixed(keys + k[:, :, j] * _ROW[j])
    return keys


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, id) for each band of each representative."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys = _keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int16).reshape(len(batch), REGISTERS))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], schema=schema)

    return reps.select("id", "sketch").mapInArrow(run, "key long, id long")


def likeliest(equal: np.ndarray, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 101) -> np.ndarray:
    """The similarity of greatest likelihood, given how many registers of a are equal to, more and less than those of b."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, steps)[None, :] * np.minimum(u / v, v / u)
    slope = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * slope) / math.log(BASE)
    up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    same = np.maximum(1 - up - down, 1e-12)
    score = more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(same)
    return np.take_along_axis(np.broadcast_to(j, score.shape), score.argmax(axis=1)[:, None], 1)[:, 0]


def plausible(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose joint estimate is not far below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            of = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int16).reshape(len(batch), REGISTERS)
            x, y = of(4), of(5)
            size = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
            n_a, n_b = size(2), size(3)
            j = likeliest((x == y).sum(axis=1), (x > y).sum(axis=1), (x < y).sum(axis=1), n_a, n_b)
            fits = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(fits & (j >= threshold - MARGIN)))

    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs (written) whose full sets are similar enough: 100 * intersection >= percent * union."""
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null").join(few, "id", "left_semi")
    texts = written(texts)
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)

        def items(t: str) -> np.ndarray:
            data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            return next(shingles(data, np.array([0, len(data)]), width))

        for batch in batches:
            keep = []
            for t_a, t_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[0] != t_a:
                    last = (t_a, items(t_a))
                x, y = last[1], items(t_b)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(len(x) and len(y)) and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, items): the whole set of each text whose id is in ids (written)."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null").join(few, "id", "left_semi")
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", 1 << 19):
                sets = list(shingles(data, offsets, width))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], schema=schema)

    return texts.mapInArrow(run, "id long, n long, items binary").dropDuplicates()


def links_between(ids: np.ndarray, comps: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The similar enough pairs of a member that asks with one that does not, of another component, by counts over an inverted index."""
    size = np.array([len(x) for x in sets], np.int64)
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(item, kind="stable")
    holders = owner[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(item))])
    start = np.cumsum(size) - size
    out = []
    for x in np.flatnonzero(asks).tolist():
        mine = item[start[x] : start[x] + size[x]]
        a, many = first[mine], first[mine + 1] - first[mine]
        at = np.arange(many.sum()) + np.repeat(a - (np.cumsum(many) - many), many)
        common = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero((100 * common >= percent * (size + size[x] - common)) & (comps != comps[x]) & ~asks)
        out += [(min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))) for y in near.tolist()]
    return sorted({p for p in out if p[0] != p[1]})


def cross_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components within buckets; left: (key, id, comp), sets: (id, n, items).

    Members of a bucket's largest component are not compared with each other: those of the others ask, and all answer. Beyond
    GROUP_ROWS members or GROUP_ITEMS shingles both sides are cut into blocks, and each pair of blocks is a group of its own. So
    what a task holds is bounded whatever a bucket's size, and where one component holds most of it, its sets are copied
    as often as the others fill blocks: once, as a rule."""
    sized = written(left.join(sets.select("id", "n"), "id"))
    parts = written(sized.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")))
    load = parts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.max(F.struct("m", "comp", "n")).alias("l"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    blocks_of = lambda m, n: F.greatest(F.ceil(m / GROUP_ROWS), F.ceil(n / GROUP_ITEMS), F.lit(1)).cast("int")
    load = written(load.select("key", "largest", blocks_of(F.col("m"), F.col("n")).alias("answers"), blocks_of(F.col("m") - F.col("l.m"), F.col("n") - F.col("l.n")).alias("asking")))
    rows = sized.join(load, "key").select("key", "id", "comp", "asking", "answers", (F.col("comp") != F.col("largest")).alias("other"))
    at = lambda cuts: F.pmod(F.xxhash64("id"), F.col(cuts)).cast("int")
    each = lambda cuts: F.explode(F.sequence(F.lit(0), F.col(cuts) - 1))
    asked = rows.select("key", each("asking").alias("i"), at("answers").alias("j"), "id", "comp", F.lit(False).alias("asks"))
    asks = rows.where("other").select("key", at("asking").alias("i"), each("answers").alias("j"), "id", "comp", F.lit(True).alias("asks"))
    both = asked.unionByName(asks).join(sets.select("id", "items"), "id").select("key", "i", "j", "id", "comp", "asks", "items")

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        of = lambda c: table.column(c).to_numpy()
        found = links_between(of("id"), of("comp"), of("asks").astype(bool), sets, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return both.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, component) for each row of docs."""
    sk = written(sketches(docs, width, doc_id, text))
    some = sk.where("n > 0 and doc_id is not null")
    # Written, like other counts below: a side that ends in an aggregation would keep hot partitions of the join from being split.
    classes = written(some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    member = written(sk.join(classes, ["f1", "f2", "n"], "left").select("doc_id", "n", "f1", "f2", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"), F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch")))
    reps = written(member.where("sketch is not null").select(F.col("doc_id").alias("id"), "n", "f1", "f2", "sketch").dropDuplicates(["id", "f1", "f2", "n"]))
    bands = written(band_keys(reps))
    crowd = written(bands.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("m")).where("a < z").select("key", "m"))
    crowded = written(bands.join(crowd, "key"))
    # A bucket's first member is the one that meets most others in all its buckets: of near copies, the one nearest to all.
    degree = crowded.groupBy("id").agg(F.sum("m").alias("d"))
    ranked = crowded.select("key", "id").join(degree, "id")
    first = written(ranked.groupBy("key").agg(F.max_by("id", F.struct("d", -F.col("id"))).alias("first")))
    stars = written(crowded.select("key", "id").join(first, "key").where("id <> first").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct())
    threshold = percent / 100
    links = confirmed(written(plausible(stars, reps, threshold)), docs, width, percent, doc_id, text)
    # An id that stands for several sets links them; a document's row links to its class's representative.
    same = member.where("rep is not null and rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    several = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
    same = same.join(several, F.col("b") == F.col("doc_id"), "left_semi")
    label = components(links.unionByName(same))
    # What is left: pairs of different components in one bucket. Their full sets meet there, and only links leave.
    at = written(crowded.select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")).distinct())
    mixed_keys = written(at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    left = written(at.join(mixed_keys, "key", "left_semi"))
    sets = written(full_sets(docs, written(left.select("id").distinct()), width, doc_id, text))
    more = written(cross_links(left, sets, percent))
    if not more.isEmpty():
        label = components(more, label)
    out = member.select("doc_id", "n", "rep").join(label.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    return out.select("doc_id", "n", F.coalesce("comp", "rep", "doc_id").alias("component"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query over near_duplicates()' rows."""
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with the columns of docs. Rows that repeat an id stay together."""
    gone = written(near_duplicates(docs, width, percent, doc_id, text).where("component < doc_id").select(F.col("doc_id").alias("gone")).distinct())
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("gone"), "left_anti")
