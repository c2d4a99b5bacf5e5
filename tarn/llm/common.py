"""Shared plumbing: durable staging, row identity, connected components, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Small sides up to this many rows (of a few fixed-width columns) may be broadcast.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (local mode only) a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tarn-stage-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: With this a query's shuffle files go when it has ended, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back. Nothing else uses the plan that writes, so its shuffle files go at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, f"{shared_dir(df.sparkSession)}/tarn-{tag}-{uuid.uuid4().hex}")


class Scratch:
    """Staged tables that only steps up to `drop` read; their files go then."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/tarn-{tag}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return written(df, path)

    def drop(self) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.paths.clear()


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if a count shows that df has at most `rows` rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_hash(col: str) -> Column:
    """64-bit content hash that tells apart rows with the same (or no) id."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")), F.col(col).isNull())


def strings_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(starts, ends, buffer) of a string or binary Arrow array; null values are empty."""
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        width = np.int64
    else:
        width = np.int32
    bufs = arr.buffers()
    n = len(arr)
    if n == 0 or bufs[2] is None:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), b""
    off = np.frombuffer(bufs[1], dtype=width)[arr.offset : arr.offset + n + 1].astype(np.int64)
    starts, ends = off[:-1], off[1:].copy()
    if arr.null_count:
        null = np.asarray(arr.is_null())
        ends[null] = starts[null]
    return starts, ends, memoryview(bufs[2])


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes, by vectorised hooking and pointer jumping."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((-lo, hi))  # the last write wins: the smallest partner of each root
        label[hi[order]] = lo[order]
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest reachable node.

    Local contraction: every node adopts the lowest of its two-hop neighbourhood in a
    random order, the graph is contracted to the adopted nodes, and so on until no edge is
    left. Rounds are logarithmic for any shape; every aggregate is a minimum with map-side
    combine, so a hub costs no more than its distinct edges. Self-loops and repeated edges
    are harmless, null ends are ignored, no edges give an empty result.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = stage(e, "cc-edges")
    steps: list[DataFrame] = []
    salt = 0
    while not e.isEmpty():
        salt += 1

        def rank(c: str, s: int = salt) -> Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(s)).alias("h"), F.col(c).alias("n"))

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        one = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u")).alias("m"))
        near = both.join(one.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m2"))
        rep = stage(near.join(one, "u").select("u", F.least("m", "m2").getField("n").alias("r")), "cc-rep")
        steps.append(rep)
        left = e.join(rep, "u").select("v", F.col("r").alias("a"))
        moved = left.join(rep.select(F.col("u").alias("v"), F.col("r").alias("b")), "v").where("a <> b")
        e = stage(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-edges")
    if not steps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = steps[0].select(F.col("u").alias("node"), F.col("r").alias("root"))
    for rep in steps[1:]:
        nodes = nodes.join(rep.select(F.col("u").alias("root"), F.col("r").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    nodes = stage(nodes, "cc-nodes") if len(steps) > 1 else nodes
    lowest = stage(nodes.groupBy("root").agg(F.min("node").alias("component")), "cc-lowest")  # written, so that Spark can split a hot root
    return nodes.join(lowest, "root").select("node", "component")


#: Pattern of a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, *new: Column, row: str = "row") -> DataFrame:
    """The fields of the struct `row` and then the columns `new`, which replace fields of the same name (in any case)."""
    taken = {c.lower() for c in df.select(*new).columns}
    return df.select(*[F.col(f"{row}.`{f}`") for f in df.schema[row].dataType.fieldNames() if f.lower() not in taken], *new)


def sqrt_bits(n: int) -> int:
    """Bits of a bucket number such that buckets, and rows in a bucket, are each about the square root of n."""
    return max(0, (int(n) - 1).bit_length() // 2) if n > 1 else 0


def top_bits(h: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - bits) if bits else F.lit(0).cast("long")


def copies(df: DataFrame, count: str) -> DataFrame:
    """Each row of df as often as its column `count` says, numbered from 1 in `copy`; dealt out in two steps, so that no row makes one huge array."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div 1024")))
    first = F.col("part") * 1024
    return df.withColumn("part", part).withColumn("copy", F.explode(F.sequence(first + 1, F.least(first + 1024, F.col(count))))).drop("part")


def numbered(base: DataFrame, keys: list[str], several: DataFrame) -> DataFrame:
    """base(row, keys) with `copy`, which numbers the rows of equal keys from 1; several: the keys (null counts as a value) that occur more than once.

    Rows that agree in everything collapse to a count first, so no task holds a row's repeats.
    """
    if several.isEmpty():
        return base.withColumn("copy", F.lit(1).cast("long"))
    several = stage(several.select(*[F.col(k).alias(f"s_{k}") for k in keys]), "repeated")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    several = maybe_broadcast(several)
    variants = base.join(several, same, "left_semi").groupBy(*keys, F.xxhash64("row").alias("variant")).agg(F.first("row").alias("row"), F.count("*").alias("times"))
    before = F.sum("times").over(Window.partitionBy(*keys).orderBy("variant").rowsBetween(Window.unboundedPreceding, -1))
    again = copies(variants.withColumn("before", F.coalesce(before, F.lit(0))), "times")
    # written, as nested columns can't be pruned through a Generate on a Window
    again = stage(again.select("row", *keys, (F.col("before") + F.col("copy")).alias("copy")), "copies")
    return base.join(several, same, "left_anti").select("row", *keys, F.lit(1).cast("long").alias("copy")).unionByName(again)
