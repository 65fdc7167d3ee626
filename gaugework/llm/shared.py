"""Tables, scratch storage and Arrow helpers that the text operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_written: list[tuple[SparkSession, str]] = []


#: Bytes of texts that go to a Python worker at once (rows where a row has more).
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; also bounds the session's Arrow batches by bytes, unless they are bounded more tightly."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts the lineage.

    The files outlive a lost executor. They go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gaugework/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    gc.collect()  # what is not referred to any more lets Spark drop the shuffle files of finished steps
    give_back()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


atexit.register(_sweep)


def salted_lookup(rows: DataFrame, keys: list[str], aggs: list, salts: int = 32) -> DataFrame:
    """rows with the aggregates of each row's key, without sending a hot key to one task.

    aggs: (name, first, merge): ``first`` aggregates rows, ``merge(name)`` aggregates partial results.
    Rows are summed by (key, salt), the sums by key, and the answer goes back by (key, salt):
    a key has at most ``salts`` rows in the steps that need it whole. Keys match null-safely.
    rows must not hold the columns _salt and those named by aggs, and needs a cheap, repeatable plan.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys] or [F.lit(0)]), F.lit(salts)))
    part = salted.groupBy(*keys, "_salt").agg(*[first.alias(name) for name, first, _ in aggs])
    whole = part.groupBy(*keys).agg(*[merge(name).alias(name) for name, _, merge in aggs])
    part, whole = part.select(*keys, "_salt").alias("p"), whole.alias("w")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    back = part.join(whole, same).select(*[F.col(f"p.{k}").alias(k) for k in [*keys, "_salt"]], *[F.col(f"w.{n}").alias(n) for n, _, _ in aggs])
    left, right = salted.alias("l"), back.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_salt"]]
    return left.join(right, same).select("l.*", *[F.col(f"r.{n}").alias(n) for n, _, _ in aggs]).drop("_salt")


def give_back() -> None:
    """Gives the memory that this process holds but does not use back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """``run``, a function for mapInArrow; at its end the worker gives the memory that it holds but does not use back to the system.

    Workers live on between tasks, and what one step has needed would add to what the next one needs.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


# -- Arrow columns as numpy arrays ---------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and the n+1 offsets into them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int):
    """(first, last) of runs of texts that hold about ``most`` bytes; a longer text stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_rng.integers(1, 2**62)) * 8 + 5
INVERSE = pow(BASE, -1, 2**64)
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


KEPT_POWERS = 1 << 22


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64; grown by doubling, and kept up to KEPT_POWERS."""
    p = _powers[base]
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 2**64))])
    if len(p) <= KEPT_POWERS:
        _powers[base] = p
    return p[:n]


class Rolling:
    """Hashes of any stretch of a byte array, after one pass: h(start, end) depends on the bytes between only."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def key64(*columns):
    """A 64-bit key of columns, nulls told apart from any value."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


class Bloom:
    """A set of 64-bit keys of fixed size: members always pass, others mostly do not."""

    BITS, SEGMENTS = 24, 16

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap

    @staticmethod
    def _slots(keys: np.ndarray) -> list[np.ndarray]:
        a = mix64(keys.astype(np.int64).view(np.uint64))
        return [(a >> np.uint64(64 - Bloom.BITS)).astype(np.int64), (a & np.uint64((1 << Bloom.BITS) - 1)).astype(np.int64)]

    def __contains__(self, key):
        return bool(self.passes(np.array([key]))[0])

    def passes(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for slot in self._slots(keys):
            found &= (self.bitmap[slot >> 3] >> (slot & 7)) & 1 == 1
        return found

    @classmethod
    def of(cls, keys: DataFrame) -> Bloom:
        """From a one-column frame of longs. Each segment of the bitmap is made by one task; the driver gets 2 MB in all."""
        name, width = keys.columns[0], 1 << (cls.BITS - 3)

        def slots(batches):
            for batch in batches:
                found = np.unique(np.concatenate(cls._slots(batch.column(0).to_numpy(zero_copy_only=False))))
                yield pa.RecordBatch.from_pydict({"segment": pa.array((found >> (cls.BITS - 4)).astype(np.int32)), "slot": pa.array(found.astype(np.int32))})

        def bitmaps(batches):
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                segment, slot = (batch.column(c).to_numpy() for c in ("segment", "slot"))
                for s in np.unique(segment):
                    own = parts.setdefault(int(s), np.zeros(width // cls.SEGMENTS, np.uint8))
                    at = slot[segment == s] - int(s) * (1 << (cls.BITS - 4))
                    np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
            for s, own in parts.items():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "bits": pa.array([own.tobytes()], pa.binary())})

        rows = keys.select(F.col(name).cast("long")).mapInArrow(slots, "segment int, slot int").distinct()
        rows = rows.repartition(cls.SEGMENTS, "segment").mapInArrow(bitmaps, "segment int, bits binary")
        bitmap = np.zeros(width, np.uint8)
        for segment, bits in rows.collect():
            part = np.frombuffer(bits, np.uint8)
            bitmap[segment * len(part) : (segment + 1) * len(part)] |= part
        return cls(bitmap)

    def filter(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of df whose key (a column of longs) may be in the set."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(shared.value.passes(batch.column(key).to_numpy(zero_copy_only=False))))

        return df.mapInArrow(run, df.schema)


def salted_join(rows: DataFrame, key: str, one: DataFrame, salts: int = 32) -> DataFrame:
    """rows with the columns of ``one`` (at most one row a key) for each row's key, or nulls; a hot key is spread over tasks."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    part = rows.select(key, "_salt").distinct().join(one, key, "left")
    return rows.join(part, [key, "_salt"], "left").drop("_salt")


#: Edges whose components are found in one task.
EDGES = 1 << 20


def _forest(batches):
    """Edges (a, b) to edges from each node to the smallest node of its component, as far as these edges tell."""
    parts = [[batch.column(c).to_numpy(zero_copy_only=False) for c in "ab"] for batch in batches]
    if not parts:
        return
    a, b = (np.concatenate(c) for c in zip(*parts))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b), longs: root is the smallest node of its component.

    Each task first shrinks its own edges to stars, EDGES at a time. Where that leaves a node in several stars,
    large-star and small-star steps follow, each a grouped minimum handed back by (node, salt), so that a node with
    very many neighbours is no single task's work; and again, until all edges are stars.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = salted_lookup(edges, ["a"], [("m", F.min("b"), F.min)])
        known = known.withColumn("m", F.least("m", "a"))
        moved = known.where("b > a" if large else "b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(known.select("a", F.col("m").alias("b")))
        return moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def settled(edges: DataFrame) -> bool:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()

    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        parts = -(-edges.count() // EDGES)
        dealt = edges.coalesce(1) if parts <= 1 else edges.repartition(parts, "b")
        edges = materialize(dealt.mapInArrow(frugal(_forest), "a bigint, b bigint").distinct(), "edges")
        if parts <= 1 or settled(edges):
            break
        edges = materialize(star(materialize(star(edges, True), "edges"), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
