from __future__ import annotations

import os

import oracle
import pytest

from waymark import catalog

catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.assert_same(catalog.QUERIES[name](spark, oracle.DATA), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, oracle.DATA).count() > 0


def test_samples_have_their_properties(spark):
    pairs = catalog.QUERIES["negative_sampling"](spark, oracle.DATA).collect()
    n = spark.read.parquet(f"{oracle.DATA}/embeddings.parquet").count()
    assert len(pairs) == len({r.i for r in pairs}) == n and all(r.i % 10 != r.j % 10 and r.i // 50 == r.j // 50 for r in pairs)
    d = catalog.QUERIES["derangement"](spark, oracle.DATA).collect()
    assert all(r.vec_id != r.partner for r in d) and {r.vec_id for r in d} == {r.partner for r in d}
    again = catalog.QUERIES["random_of_class"](spark, oracle.DATA).repartition(3)
    assert sorted(again.collect()) == sorted(catalog.QUERIES["random_of_class"](spark, oracle.DATA).collect())


def test_derangement_takes_every_row(spark, tmp_path):
    ids = [*range(0, 600, 2), 10**12]
    spark.createDataFrame([(i,) for i in ids], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = catalog.QUERIES["derangement"](spark, str(tmp_path)).collect()
    assert sorted(r.vec_id for r in d) == sorted(r.partner for r in d) == ids and all(r.vec_id != r.partner for r in d)


def test_entry(spark):
    import __spark_entry__

    rows = {r.k: r.recall for r in __spark_entry__.entry(spark).collect()}
    assert set(rows) == {1, 5, 10, 20} and rows[1] <= rows[5] <= rows[10] <= rows[20]


def test_sampled_frames(spark):
    rows = catalog.QUERIES["sampled_frames"](spark, oracle.DATA).collect()
    for r in rows:
        assert len(r.random) == len(set(r.random)) == len(r.headtail) == 8 and r.random == sorted(r.random) and 0 <= r.random[0] and r.random[-1] < r.length
        head, tail = r.headtail[:4], r.headtail[4:]
        assert head == sorted(set(head)) and tail == sorted(set(tail)) and head[-1] < r.length // 2 <= tail[0] and tail[-1] < r.length
    assert len({tuple(r.random) for r in rows}) > len(rows) // 2
