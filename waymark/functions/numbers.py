"""Geometry, schedules and small formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(e1: Column, n1: Column, e2: Column, n2: Column) -> Column:
    """Planar metres."""
    return F.sqrt((e1 - e2) * (e1 - e2) + (n1 - n2) * (n1 - n2))


def cell(x: Column, size: int) -> Column:
    """The largest multiple of size that is not above x."""
    return (F.floor(x / size) * size).cast("long")


def group_index(rounded: Column, size: int, many: int) -> Column:
    """Which of `many` cells of `size` a rounded coordinate has, counted modulo."""
    return F.floor(F.pmod(rounded, F.lit(size * many)) / size).cast("long")


def cosine_lr(epoch: Column, max_epoch: int, init_lr: float, min_lr: float) -> Column:
    return F.lit(init_lr - min_lr) * 0.5 * (1.0 + F.cos(F.pi() * epoch / F.lit(float(max_epoch)))) + min_lr


def warmup_lr(step: Column, max_step: int, init_lr: float, max_lr: float) -> Column:
    return F.least(F.lit(max_lr), F.lit(init_lr) + F.lit(max_lr - init_lr) * step / F.lit(float(max_step)))


def step_lr(epoch: Column, init_lr: float, min_lr: float, decay: float) -> Column:
    return F.greatest(F.lit(min_lr), F.lit(init_lr) * F.pow(F.lit(decay), epoch))


def ramp(alpha: float, i: Column, n: int) -> Column:
    """alpha, reached after n steps."""
    return F.lit(alpha) * F.least(F.lit(1.0), i / F.lit(float(n)))


def ema(values: Column, momentum: float) -> Column:
    """The moving average of an ordered array, from its first element."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)).cast("double"), lambda m, x: m * momentum + x * (1.0 - momentum))


def param_count(n: Column) -> Column:
    """Millions with an M, else thousands with a K."""
    return F.when(n >= 1_000_000, F.concat(_tenths(n / 1e6), F.lit("M"))).otherwise(F.concat(_tenths(n / 1e3), F.lit("K")))


def _tenths(x: Column) -> Column:
    """C's %.1f, which rounds the binary value and exact halves to even; format_string rounds the shortest decimal, halves up."""
    return F.call_function("format_number", x, F.lit("0.0"))


def match_probability(no: Column, yes: Column) -> Column:
    """The softmax of two logits, of the second."""
    return 1.0 / (1.0 + F.exp(no - yes))


def uniform_frames(start: Column, end: Column, length: Column, n: int) -> Column:
    """The frames start, start + length/n, ... below end."""
    step = length / F.lit(float(n))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(start + i * step).cast("long")), lambda f: f < end)


def random_frames(key: Column, length: Column, n: int, seed: int, first: Column | None = None) -> Column:
    """n different frames of first .. length - 1, in order, chosen evenly by key and seed; all of them if there are no more."""
    start = F.lit(0) if first is None else first
    frames = F.when(length > start, F.sequence(start.cast("long"), length.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    drawn = F.array_sort(F.transform(frames, lambda i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("u"), i.alias("i"))))
    return F.sort_array(F.transform(F.slice(drawn, 1, n), lambda x: x["i"]))


def head_and_tail_frames(key: Column, length: Column, n: int, seed: int) -> Column:
    """n // 2 frames of the first half, then n // 2 of the second."""
    half = F.floor(length / 2)
    return F.concat(random_frames(key, half, n // 2, seed), random_frames(key, length, n // 2, seed + 1, half))


def tile_ratio(width: Column, height: Column, size: int = 448, most: int = 12) -> Column:
    """struct(w, h): the grid of at most `most` tiles nearest to the image's shape; of equal ones the larger if the image fills half of it.

    The grids are taken by area, then by width, and folded: a later one wins if it is nearer, or as near and half filled."""
    grids = sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most), key=lambda g: (g[0] * g[1], g[0]))
    options = F.array(*[F.struct(F.lit(i).alias("w"), F.lit(j).alias("h")) for i, j in grids])
    ratio = width / height
    start = F.struct(F.lit(1).alias("w"), F.lit(1).alias("h"), F.lit(1e300).alias("d"))

    def step(best: Column, g: Column) -> Column:
        d = F.abs(ratio - g["w"] / g["h"])
        wins = (d < best["d"]) | ((d == best["d"]) & (width * height > F.lit(0.5 * size * size) * g["w"] * g["h"]))
        mine = F.struct(g["w"].alias("w"), g["h"].alias("h"), F.least(d, best["d"]).alias("d"))
        return F.when(wins, mine).otherwise(best)

    return F.aggregate(options, start, step, lambda b: F.struct(b["w"].alias("w"), b["h"].alias("h")))


def tile_boxes(grid: Column, size: int = 448) -> Column:
    """The boxes (left, top, right, bottom) of a grid's tiles, row by row."""
    return F.transform(
        F.sequence(F.lit(0), grid["w"] * grid["h"] - 1),
        lambda i: F.struct(
            ((i % grid["w"]) * size).alias("left"), (F.floor(i / grid["w"]) * size).cast("int").alias("top"),
            ((i % grid["w"] + 1) * size).alias("right"), ((F.floor(i / grid["w"]) + 1) * size).cast("int").alias("bottom"),
        ),
    )


def batch_rows(memory_gb: Column, model: str = "clip") -> Column:
    """Images in a batch for a GPU's memory."""
    sizes = {"clip": ((16, 64), (8, 32), (4, 16), (2, 8)), "blip": ((24, 16), (16, 8), (8, 4), (4, 2))}[model]
    last = {"clip": 4, "blip": 1}[model]
    out = F.lit(last)
    for least, rows in reversed(sizes):
        out = F.when(memory_gb >= least, F.lit(rows)).otherwise(out)
    return out
