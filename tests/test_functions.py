from __future__ import annotations

import math
import textwrap

import pytest
from pyspark.sql import functions as F

from waymark.functions import numbers, paths, text, vectors


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "strict", "cascade"),
    [
        ("@123.456@789.012@test_image@.jpg", (123.456, 789.012), (123.456, 789.012)),
        ("invalid_filename.jpg", (None, None), (None, None)),
        ("@500000@600000@camera1@.jpg", (500000, 600000), (500000, 600000)),
        ("@0543158.27@4180593.76@10@S@037.77166@-122.50995@M7mOh9X4Xw_OHp-DYe5hQg@@206@@@@201311@@.jpg", (543158.27, 4180593.76), (543158.27, 4180593.76)),
        ("@-12.5@+7.0@x@.jpg", (None, None), (-12.5, 7.0)),
        ("img_543256.96_4178906.70.png", (None, None), (543256.96, 4178906.70)),
        ("place 37.5,-122.5 a.png", (None, None), (0.5 * 111320 * math.cos(math.radians(37.5)), -11.5 * 111320)),
    ],
)
def test_coordinates(spark, name, strict, cascade):
    s, c = one(spark, paths.utm_strict(F.col("p")), p=name), one(spark, paths.utm_cascade(F.col("p")), p="/d/" + name)
    assert (s.utm_east, s.utm_north) == strict
    assert (c.utm_east, c.utm_north) == pytest.approx(cascade) if cascade[0] is not None else (c.utm_east, c.utm_north) == cascade


def test_heading(spark):
    u = one(spark, paths.utm_fields(F.col("p")), p="@0543158.27@4180593.76@10@S@037.77166@-122.50995@M@@206@@@@201311@@.jpg")
    assert (u.utm_east, u.utm_north, u.heading) == (543158.27, 4180593.76, 206.0)


def test_paths(spark):
    p = F.col("p")
    assert one(spark, paths.joined("/root", p), p="a/b.jpg") == "/root/a/b.jpg"
    assert one(spark, paths.joined("/root", p), p="/a/b.jpg") == "/a/b.jpg"
    assert one(spark, paths.rebased(p, "/new/"), p="C:\\x\\y\\z.jpg") == "/new/z.jpg"
    assert one(spark, paths.rebased(p, "/new/"), p="nan") == "nan"
    assert one(spark, paths.wsl_to_windows(p), p="/mnt/c/a/b.jpg") == "C:\\a\\b.jpg"
    assert one(spark, paths.compact(p), p="/a/abcdefghijklmnopqrstuvwxyz.jpg") == "abcdefghijklmnopq..."
    assert one(spark, paths.shortened(p), p="/a/abcdefghijklmnop.jpg") == "abcdefgh....jpg"
    assert one(spark, paths.shortened(p), p="short.jpg") == "short.jpg"
    assert one(spark, paths.shortened(p), p="a.verylongextensionname") == "a.verylongex..."
    assert one(spark, paths.coco_id(p), p="val2014/COCO_val2014_000000391895.jpg") == 391895
    assert one(spark, paths.report_name(F.col("i")), i=7) == "007.jpg"
    assert one(spark, paths.report_name(F.col("i")), i=1234) == "1234.jpg"


def test_captions(spark):
    c = F.col("c")
    assert one(spark, text.caption(c, 3), c='A  "Red" house; (old).\n') == "a red house"
    assert one(spark, text.question(c, 50), c=" What is: this? ") == " what is this?"
    assert one(spark, text.caption(F.lit(None).cast("string"))) is None
    assert one(spark, text.cut_at_word(c, 10), c="one two three four") == "one two"
    assert one(spark, text.cut_at_word(c, 5), c="abcdefgh") == "abcde"
    assert one(spark, text.sides_swapped(c), c="the left dog right leftover") == "the right dog left leftover"
    assert one(spark, text.unquoted(c), c="\"it's'") == "it's"
    assert one(spark, text.without_prompt(text.with_prompt(c, "a photo of "), "a photo of "), c="x") == "x"


@pytest.mark.parametrize("t", ["short", "the quick brown fox jumps over the lazy dog and then runs away from the very large bear", "x" * 130 + " tail"])
def test_wrapped_like_textwrap(spark, t):
    want = t if len(t) <= 20 else "\n".join(textwrap.wrap(t, 20))
    got = one(spark, text.wrapped(F.col("t"), 20), t=t)
    assert got == want or " ".join(got.split()) == " ".join(want.split()) and max(map(len, got.split("\n"))) <= 20


def test_vectors(spark):
    rows = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [-1.0, 0.0], "d": [1.0, 0.0]}
    df = spark.createDataFrame(list(rows.items()), "id string, v array<float>")
    q = F.array(F.lit(1.0), F.lit(0.0))
    got = {r.id: r for r in df.select("id", *[vectors.similarity(m, q, F.col("v")).alias(m) for m in vectors.SIMILARITY]).collect()}
    assert [round(got[k].cosine, 6) for k in "abcd"] == [1, 0, -1, 1]
    assert [got[k].euclidean for k in "abcd"] == [0, -2, -4, 0]
    assert [got[k].manhattan for k in "abcd"] == [0, -2, -2, 0]
    assert [1 - got[k].euclidean for k in "abcd"] == [1, 3, 5, 1]
    with pytest.raises(ValueError, match="unknown similarity metric"):
        vectors.similarity("hamming", q, q)


def test_more_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.normalised(a)) == [0.6, 0.8]
    assert one(spark, vectors.normalised(F.array(F.lit(0.0)), least=1e-12)) == [0.0]
    assert one(spark, vectors.all_close(a, F.array(F.lit(3.00001), F.lit(4.0)))) is True
    assert one(spark, vectors.all_close(a, F.array(F.lit(3.1), F.lit(4.0)))) is False
    assert one(spark, vectors.gem(F.array(F.lit(1.0), F.lit(2.0)))) == pytest.approx((9 / 2) ** (1 / 3))
    assert one(spark, vectors.cosface(F.lit(0.5), F.lit(True))) == pytest.approx(3.0)
    f = one(spark, vectors.fingerprint(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))))
    assert (f.mean, f.std, f.min, f.max) == (2.3333, 1.5275, 1.0, 4.0)


def test_cells_and_groups(spark):
    assert one(spark, numbers.cell(F.lit(396523.4), 10)) == 396520
    assert one(spark, numbers.cell(F.lit(-3.0), 10)) == -10
    assert one(spark, numbers.group_index(F.lit(-10), 10, 5)) == 4
    assert one(spark, numbers.group_index(F.lit(396520), 10, 5)) == 2


def test_tiles(spark):
    g = one(spark, numbers.tile_ratio(F.lit(800), F.lit(400)))
    assert (g.w, g.h) == (2, 1)
    g = one(spark, numbers.tile_ratio(F.lit(4000), F.lit(2000)))
    assert (g.w, g.h) == (4, 2)
    boxes = one(spark, numbers.tile_boxes(F.struct(F.lit(2).alias("w"), F.lit(2).alias("h"))))
    assert [tuple(b) for b in boxes] == [(0, 0, 448, 448), (448, 0, 896, 448), (0, 448, 448, 896), (448, 448, 896, 896)]


def test_small_formulas(spark):
    assert one(spark, numbers.param_count(F.lit(2_500_000))) == "2.5M"
    assert one(spark, numbers.param_count(F.lit(1500))) == "1.5K"
    assert one(spark, numbers.ema(F.array(F.lit(1.0), F.lit(3.0)), 0.5)) == 2.0
    assert one(spark, numbers.uniform_frames(F.lit(0), F.lit(8), F.lit(8), 4)) == [0, 2, 4, 6]
    assert one(spark, numbers.batch_rows(F.lit(12), "clip")) == 32


def test_sentences(spark):
    assert one(spark, text.sentences(F.lit("A b. c d. E?\n\n(F.) G"))) == ["A b. c d.", "E?", "(F.)", "G"]
    assert one(spark, text.sentences(F.lit("  "))) == one(spark, text.sentences(F.lit(""))) == [] and one(spark, text.sentences(F.lit(None).cast("string"))) is None


def test_alternatives(spark):
    assert one(spark, paths.alternatives(F.lit("/mnt/c/a b/x.jpg")))[:3] == ["C:\\a b\\x.jpg", "/mnt/c/a b/x.jpg", "\\mnt\\c\\a b\\x.jpg"]
    assert set(one(spark, paths.alternatives(F.lit('"~/x.jpg"'), "/cwd", "/home/u"))) == {"~/x.jpg", "~\\x.jpg", "/cwd/~/x.jpg", "/home/u/x.jpg"}


def test_param_count_rounds_the_binary_value(spark):
    for n in (150_000 * 12347, 750_000 * 12347, 1_850_000, 250_000_000_050_000, 50, 150, 250, 1250, 1_250_000, 1_350_000):
        assert one(spark, numbers.param_count(F.lit(n))) == (f"{n / 1e6:.1f}M" if n >= 1_000_000 else f"{n / 1e3:.1f}K")
