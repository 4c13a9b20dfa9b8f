"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmill.operators.lineage import spread

#: Characters of text that one Python batch holds at most (one longer text makes a batch alone).
BATCH_CHARS = 4_000_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Returns freed memory of this Python worker to the system, where the C library can."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_STATE: dict = {}


def worker_state(key, make):
    """What a Python worker keeps from task to task, made once: a model, a cache. Only one: another key's goes first."""
    forget(key)
    if key not in _STATE:
        _STATE[key] = make()
    return _STATE[key]


def forget(keep=None) -> None:
    """Frees what this Python worker keeps for other operators' tasks, so that no stage pays for those before it."""
    if gone := [k for k in _STATE if k != keep]:
        for k in gone:
            del _STATE[k]
        gc.collect()
        give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, over all cores however few its files: for work in Python."""
    return spread(table(spark, sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests); on Hadoop's default file system where it names none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if found is None:
        found = f"file://{tempfile.mkdtemp(prefix='docmill-')}"
        sc.setCheckpointDir(found)
    p = sc._jvm.org.apache.hadoop.fs.Path(found)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/docmill-{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of scratch_path by Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside have few rows in an Arrow batch, as rows hold whole texts."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, min(int(before), 2_000) if int(before) > 0 else 2_000)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder, where Spark's cleaner deletes it if it is told to."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def key_bits(keys: DataFrame, hashed: Column):
    """A broadcast table of 2^24 bits (2 MB, whatever the number of keys) with those of the keys' 64-bit hashes set."""
    import numpy as np

    rows = keys.select(hashed.alias("h")).groupBy(F.shiftrightunsigned("h", 46).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("b")).toArrow()
    bits = np.zeros(1 << 18, np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.tobytes())


def hits(bits, hashed: pa.Array):
    """Which of the 64-bit hashes have their bit set in a table of key_bits."""
    import numpy as np

    table, h = np.frombuffer(bits.value, np.uint64), hashed.to_numpy().view(np.uint64)
    return ((table[(h >> np.uint64(46)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)


def marked(rows: DataFrame, hashed: Column, bits) -> DataFrame:
    """Rows whose key's bit is set: all rows of those keys and few others, so that the rest need not move."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(columns).filter(pa.array(hits(bits, b.column(len(columns)))))

    return rows.withColumn("_docmill_hashed", hashed).mapInArrow(run, rows.schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = BATCH_CHARS, keep=None) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about as many bytes of text at most; no text is cut. Worker state of another key than ``keep`` goes."""
    import numpy as np
    import pyarrow.compute as pc

    forget(keep)
    for b in batches:
        if b.num_rows == 0:
            continue
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(n) - n) // chars
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield b.slice(lo, hi - lo)
        del b
        give_back()


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def sample_labelled(rows: DataFrame, label: str, key: list[str], per_label: int, most_labels: int = 1000) -> DataFrame:
    """About ``per_label`` rows of each label (all, if fewer), chosen by a hash of the key columns, with their weight: rows a sampled row stands for.

    The bound on a fit's training rows: ``per_label`` times the number of
    labels, of which at most ``most_labels`` (the most frequent) are learned.
    Rows that agree in label and key are learned once, so that repeated rows
    can't break the bound. One aggregation by label; only sampled rows move.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    found = {r[0]: r.n for r in counts.orderBy(F.desc("n"), label).limit(most_labels).collect()}
    if not found:
        return rows.where("false").withColumn("weight", F.lit(1.0))
    share = F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, per_label / n))])[F.col(label)]
    at = F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    picked = rows.where(F.col(label).isin(list(found))).where(at < share).withColumn("weight", 1 / share)
    return picked.dropDuplicates([label, *key])


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows, sorted by their first columns (integers without nulls), each as one table.

    For the many small groups of a sorted partition this costs less than a call
    of Spark's for each; a task holds one group and one batch.
    """
    import numpy as np

    forget()
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
