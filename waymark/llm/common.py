"""What several operators share: the cluster's shared folder, Arrow text buffers, word hashes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the contracts' word pattern [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch; bounds a Python worker's memory where texts are long.
BATCH_ROWS = 512
#: Bytes of text that a Python worker works on at once (a longer text makes a block of its own).
BLOCK_BYTES = 4 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: their workers import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="waymark-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: rows hold whole texts, so the default of 10,000 rows is not bounded in bytes."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _work_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share. A local one is made only where it
    is unset and the master is local (tests); a cluster without the setting is an error, since executors could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/waymark/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{_work_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*dfs: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in dfs:
        _delete(df.sparkSession, df._written_to)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; results that read from it must have been stored."""
    _delete(spark, _work_dir(spark))


def objects(values) -> pd.Series:
    """A column of Python values as they are: strings of any length, none in chunks."""
    return pd.Series(list(values), dtype=object)


def row_key(doc_id: str, text: str) -> Column:
    """Tells apart rows that share an id but not the text; equal rows share it."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is evaluated once however often body uses x."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batch of about size bytes of text: (rows, UTF-8 bytes, offsets of the rows' texts, one more than rows). A null text is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(col):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and for each text the index of its first word (one more entry than texts)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Polynomial hashes modulo 2^64 of every stretch of a sequence of symbols, by prefix sums.

    sum s[j] * base^j over the stretch, divided by base^start: base is odd and so has an inverse."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        up, down = self._powers.get(base, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
        if len(up) <= n:
            size = max(n + 1, 2 * len(up))
            one = np.ones(1, np.uint64)
            up = np.cumprod(np.concatenate([one, np.full(size, base, np.uint64)]))
            down = np.cumprod(np.concatenate([one, np.full(size, pow(base, -1, 1 << 64), np.uint64)]))
            self._powers[base] = (up, down)
        self.down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


#: Odd constants for two independent hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """A 64-bit hash of each word."""
    return Prefix(data, base).of(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
