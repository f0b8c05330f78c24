"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python task holds at once, in bytes; whole documents, one at least.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of our own where it names none (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "orthant-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder; a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """A value that lives as long as the Python worker, shared by its tasks."""
    held = sys.modules.setdefault("_orthant_worker_cache", types.ModuleType("_orthant_worker_cache"))
    values = held.__dict__.setdefault("values", {})
    if key not in values:
        values[key] = make()
    return values[key]


#: Rows in an Arrow batch between the JVM and Python; texts are large, so Spark's own default would hold tens of MB on either side.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with batches of BATCH_ROWS rows at most; a worker gives its free memory back after every task."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(tidy, schema)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts come to about `limit` bytes; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=float))
        at, total = 0, 0.0
        for i, n in enumerate(sizes):
            if i > at and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0.0
            total += n
        yield batch.slice(at)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for every start and length, concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def lower_ascii(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII string, as DuckDB SQL: a byte at a time, eight shifts each."""
    shift = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
    step = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, i: {shift})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::UBIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def held_out(key):
    """Whether crc32 of the key as text is divisible by 5; labels of such rows are never learnt from."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, longest: int, key: str = "doc_id", text: str = "text"):
    """Texts and labels (pandas: key, text, y) of about `limit` labelled rows at most, by a hash of the key; none held out.

    Of a key's several labels the largest counts; null labels and keys, and texts of over `longest` characters, are not learnt from.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("y"))
    total = known.count()
    slots = 1 << 30
    chosen = lambda k: F.pmod(F.xxhash64(k.cast("string")), F.lit(slots)) < int(slots * min(1.0, limit / max(1, total)))
    texts = docs.where(chosen(F.col(key)) & (F.coalesce(F.length(text), F.lit(0)) <= longest)).select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(known.where(chosen(F.col("_key"))), "_key").toPandas().sort_values(["_key", "text"]).reset_index(drop=True)


def portions(items: list, limit: int = 1 << 20) -> Iterator[list]:
    """The items in order, in lists whose lengths come to about `limit`; a longer item is alone."""
    part, size = [], 0
    for item in items:
        if part and size + len(item) > limit:
            yield part
            part, size = [], 0
        part.append(item)
        size += len(item)
    if part:
        yield part
