"""What the operators of this subpackage share: working tables, word hashing and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another system; its allocator is left alone
    _libc = None
#: The working tables of the operator that runs.
_SAVED: ContextVar[list[str]] = ContextVar("saved")
_LOCAL: dict[str, str] = {}

#: Spark's setting by which a query's shuffle files go once it is done, as those of a written table may.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Values by which rolling hashes of words are mixed; odd, so that multiplication loses nothing.
MIX = np.uint64(0x9E3779B97F4A7C15)


def bounded(spark: SparkSession, batch: str = "2m") -> None:
    """Arrow batches between executors and their Python workers hold so many bytes at most, on both sides; by default they
    are many times as large, whatever the length of texts. Spark has this setting for a session only."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="orrery-")
    return _LOCAL[key]


def save(df: DataFrame) -> DataFrame:
    """Cut lineage: write to a table in the shared folder and read it again. Lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/orrery/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "snappy").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before or "false")
    if (held := _SAVED.get(None)) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def read_by(df: DataFrame, paths: list[str]) -> set[str]:
    """Those of the working tables that a DataFrame will read."""
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    return {p for p in paths if p.rpartition("/")[2] in names}


def tidied(f):
    """An operator that deletes its working tables when it returns, but for those that its result reads. The caller may
    ``release`` these once it has written the result."""

    @wraps(f)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        mine: list[str] = []
        around = _SAVED.get(None)
        token = _SAVED.set(mine)
        try:
            out = f(spark, *args, **kwargs)
        finally:
            _SAVED.reset(token)
        needed = read_by(out, mine)
        delete(spark, [p for p in mine if p not in needed])
        if around is not None:
            around.extend(needed)
        return out

    return run


def release(df: DataFrame) -> None:
    """Deletes the working tables that a DataFrame reads; for callers that have written it."""
    folder = work_dir(df.sparkSession).rpartition(":")[2].rstrip("/") + "/orrery/"
    delete(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles() if folder in f})


def delete(spark: SparkSession, paths) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def trim() -> None:
    """Give memory that is free back to the machine: a worker lives on for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str, chars: int = 1_000_000):
    """Parts of a batch whose texts hold about so many bytes, so that memory does not follow the batch's size. They are
    copies: some Arrow string kernels misread views that do not begin at the start of their buffers."""
    part = lambda a, b: batch.take(pa.array(np.arange(a, b)))
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > chars:
            yield part(begin, i)
            pa.default_memory_pool().release_unused()
            begin, held = i, 0
        held += int(n)
    if begin < len(lengths):
        yield part(begin, len(lengths))
        trim()


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def chain(h: np.ndarray) -> int:
    """One hash of a sequence of hashes and its length."""
    return xxhash.xxh64_intdigest(h.tobytes())


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings; each distinct one is hashed once."""
    coded = values.dictionary_encode() if not pa.types.is_dictionary(values.type) else values
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(len(values), np.uint64)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of A-Z lower-cased texts, flat, and where each text's begin and end (null: no words)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        before = np.concatenate([[0], np.cumsum(empty)])
        flat, offsets = flat.filter(pa.array(~empty)), offsets - before[offsets]
    return flat, offsets


def shingle_hashes(texts: pa.Array, k: int = 5, weigh=None) -> tuple[np.ndarray, ...]:
    """Hashes of every k-word shingle in order, flat, with offsets. A text of fewer words gives its whole sequence as one.
    ``weigh``: word hashes -> whole numbers; then a third array has their sum over each shingle."""
    flat, offsets = words_of(texts)
    h = hash_strings(flat)
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * MIX + fmix(h[j : len(h) - k + 1 + j] + np.uint64(j + 1)) if len(rolled) else rolled
    start = np.repeat(offsets[:-1], count) + (np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], count))
    out = np.zeros(out_offsets[-1], np.uint64)
    long = np.repeat(n >= k, count)
    out[long] = rolled[start[long]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[out_offsets[i]] = chain(h[offsets[i] : offsets[i + 1]])
    if weigh is None:
        return fmix(out), out_offsets
    total = np.concatenate([[0], np.cumsum(weigh(h))])
    return fmix(out), out_offsets, total[start + np.minimum(np.repeat(n, count), k)] - total[start]


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component): each node's smallest reachable node, by alternating
    large-star and small-star steps. Each round is a saved table; nothing comes to the driver but a count."""
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its lower neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = save(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.union(edges.select(F.col("b").alias("a"), "b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def small(df: DataFrame, most_bytes: int = 16_000_000) -> DataFrame:
    """A saved table, marked for broadcast where its rows are counted to hold at most so many bytes; else left to a shuffle join."""
    df = save(df)
    width = {"string": F.length, "binary": F.length, "array": lambda c: F.size(c) * 8}
    widths = [F.coalesce(width.get(f.dataType.typeName(), lambda c: F.lit(0))(F.col(f.name)), F.lit(0)) + 16 for f in df.schema.fields]
    held = df.agg(F.sum(sum(widths, F.lit(24)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= most_bytes else df
