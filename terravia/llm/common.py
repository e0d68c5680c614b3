"""What the training-data operators share: tables, the shared folder, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that Python workers are handed at once, at most; Spark's own 64 MB are several times that as Python objects.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and bound what they are handed at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":  # as Spark has it; who sets it keeps it
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; on one machine, where it is unset, a folder of our own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="terravia-")
        sc.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: cuts its lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that stored() wrote, once nothing reads it any more."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        removed(df.sparkSession, name)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are stored by now: it does so when the driver's garbage is
    collected, which may be long after; between large steps this halves the disk that is used at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidied(run):
    """run, a function of record batches; when a task is done the Python worker, which Spark keeps for the next stages,
    gives its free memory back to the system."""
    def outer(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return outer


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


# --- words and their hashes -------------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out; each input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    with np.errstate(over="ignore"):
        while len(_POWERS) < n:
            step = np.uint64(pow(_BASE, len(_POWERS), 2**64))
            _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes outside 20, 09-0D), A-Z taken as a-z, in order."""
    return words(text)[0]


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, where it starts and where it ends."""
    raw = np.frombuffer(text, np.uint8)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(raw):
        return none
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return none
    size = ends - starts
    with np.errstate(over="ignore"):
        # position within the word, so that equal words have equal terms wherever they stand
        place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
        terms = _BYTE[_LOWER[raw]] * _powers(int(place.max()) + 1)[place]
        terms[space] = 0
        return mix(np.add.reduceat(terms, starts) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k) * np.uint64(0xA24BAED4963EE407))
        for i in range(k):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[i : i + n])
    return np.unique(out)


# --- sets of ids as a bitmap of fixed size --------------------------------------------------------

_WORDS = 1 << 18


def bitmap(ids: DataFrame, column: str) -> DataFrame:
    """A filter of the ids in 2^18 words of 64 bits (word, bits): passes each of them, and few others as long as they
    are fewer than 2^24. Its size does not depend on theirs, so it may be broadcast; where it is full it passes all."""
    h = F.xxhash64(F.col(column))
    words = ids.select(
        F.pmod(h, F.lit(_WORDS)).cast("int").alias("bm_word"),
        F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{column}`), 24), 64) as int))").alias("bit")
    )
    return words.groupBy("bm_word").agg(F.bit_or("bit").alias("bm_bits"))


def marked(df: DataFrame, id_column: str, bits: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: whether the bitmap passes its id (false: it is certainly none of them)."""
    word = F.pmod(F.xxhash64(F.col(id_column)), F.lit(_WORDS)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{id_column}`), 24), 64) as int))")
    joined = df.join(F.broadcast(bits), word == F.col("bm_word"), "left")
    return joined.withColumn(name, F.coalesce(F.col("bm_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("bm_word", "bm_bits")
