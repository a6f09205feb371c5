"""The registered queries and the pipeline."""

from __future__ import annotations

import hashlib
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import oracle
import pytest
from edge_texts import EDGES
from test_groups import components, personal
from test_rows import measured

import corpus_pipeline
from waymark.llm import decontam, queries, sql

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, oracle.DATA)
    wanted = oracle.connection().sql(sql.ORACLES[name]).columns
    oracle.assert_same(got.select(*wanted), sql.ORACLES[name])


def test_suffix_dedup_has_the_columns_of_its_sql(spark):
    got = queries.QUERIES["op7_suffix_dedup"](spark, oracle.DATA)
    assert sorted(got.columns) == sorted(oracle.connection().sql(sql.ORACLES["op7_suffix_dedup"]).columns)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, oracle.DATA)
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        kept[k] = {r.doc_id: r.text for r in docs.collect()}
    for i, t in kept[0].items():
        n, _, _, _, again = measured(t)
        assert n >= 50 and 100 * again <= 50 * n and t == before[i]
    roots = components(sorted(kept[0].items()), 5, 80)
    assert set(kept[1]) == {i for i, r in roots.items() if i == r}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{oracle.DATA}/benchmark.parquet").collect()]
    matcher = decontam.Matcher(items)
    assert set(kept[2]) == {i for i, t in kept[1].items() if not matcher.match(t)}
    assert not any(x in t for t in kept[2].values() for _, x in items)
    assert set(kept[3]) == set(kept[2])
    assert all(personal(t)[1] == "" for t in kept[3].values()) and any(personal(t)[1] for t in kept[2].values())
    assert {i for i in kept[2] if kept[3][i] != kept[2][i]} <= {i for i, t in kept[2].items() if personal(t)[1]} | {i for i, t in kept[3].items() if "[TERM]" in t or "[SECRET]" in t}
    last = corpus_pipeline.run(spark, oracle.DATA)
    assert {r.doc_id for r in last.collect()} == set(kept[3])


def test_short_items_are_found_inside_texts(spark, tmp_path):
    items = [(1, "Who wrote it?"), (2, "how many legs has a spider"), (3, "zebra"), (4, "")]
    texts = [(1, "they asked: who wrote it, and when"), (2, "x how many legs has one spider y"), (3, "a zebra here"), (4, "who wrote that"), (5, "zebras"), (6, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id, r.distance) for r in queries.QUERIES["op9_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 0), (2, 2, 1), (3, 3, 0)}
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()} == {4, 5, 6}


def encoded(t):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    model.no_truncation()
    model.no_padding()
    return model.encode(t or "", add_special_tokens=False).ids


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null, empty, long and repeated texts, null and repeated ids, and columns with the operators' own names, through all stages."""
    prose = lambda k, n=80: " ".join("w" + "".join(chr(97 + i) for i in x) for x in np.random.default_rng(k).integers(0, 26, (n, 4)))
    texts = [*EDGES, (20, prose(1)), (21, prose(1)), (21, prose(1)), (22, prose(2) + " mail a.b@c.de"), (None, prose(3)), (None, None), (23, prose(4) + " what is the first item of all"), (24, prose(5, 30000)), (25, prose(6) + " ###" * 60)]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x", "y", 2.0, 3) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fail_bits long, row string, key string, terms double, component long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "What is the FIRST item of all?"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    part = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        part = stage(spark, part, str(tmp_path))
        assert part.dtypes == docs.dtypes
    kept = sorted((str(r.doc_id), r.text, r.n_chars) for r in part.collect())
    want = sorted((str(i), t, len(t)) for i, t in ((20, prose(1)), (22, prose(2) + " mail [EMAIL]"), (None, prose(3)), (24, prose(5, 30000))))
    assert kept == want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in out) == sorted((i, len(encoded(t)), hashlib.sha256(np.array(encoded(t), "<u4").tobytes()).hexdigest()) for i, t, _ in want)
    assert all(r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for r in out for i, t, _ in want if str(r.doc_id) == i)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    docs.limit(0).select("doc_id", "text").withColumnRenamed("doc_id", "item_id").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_entry_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "waymark"):
        (tmp_path / name).symlink_to(root / name)
    code = "import sys; sys.modules['waymark.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
