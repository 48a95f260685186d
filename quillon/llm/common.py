"""Shared pieces: scratch tables, checked broadcasts, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window

#: A table is broadcast only if its counted size stays below this.
BROADCAST_BYTES = 32 << 20

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> None:
    """Keep Arrow batches small, in bytes too if ``size`` is given, since one text may hold many kilobytes; let workers find this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    # workers give memory back that they no longer use
    for name, value in (("PYTHONPATH", root), ("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "1")):
        spark.sparkContext.environment.setdefault(name, value)
    if int(spark.conf.get(ARROW_ROWS, "10000")) > rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    held = spark.conf.get(ARROW_BYTES, "64m")
    if size and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) > size:
        spark.conf.set(ARROW_BYTES, str(size))


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; shared by driver and executors.

    Only a local session that names no such folder (a test) gets one of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillon-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends here and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, folder: str, name: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`saved`, with the rows of equal ``key`` in one of ``buckets`` buckets, so that a join on it leaves them there."""
    spark, table = df.sparkSession, f"quillon_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{folder}/{name}").saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved: only the name goes, the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def finished(df: DataFrame, folder: str, name: str) -> DataFrame:
    """:func:`saved` in a folder of its own, after which the scratch tables of ``folder`` go."""
    out = saved(df, scratch(df.sparkSession), name)
    removed(df.sparkSession, folder)
    return out


def removed(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _weight(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, with some for what a hash table keeps beside it."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            each = F.aggregate(value, F.lit(0).cast("long"), lambda acc, x: acc + _weight(x, inner))
        else:
            each = F.size(value).cast("long") * 8
        return F.coalesce(each, F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((_weight(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(16)


def measured(df: DataFrame) -> int:
    """Bytes of the rows of ``df``, with what a hash table keeps beside them."""
    each = sum((_weight(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields), F.lit(32).cast("long"))
    return df.agg(F.coalesce(F.sum(each), F.lit(0)).alias("n")).first()["n"]


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the measured bytes of ``df`` (a written table) fit; else leave the join to Spark."""
    return F.broadcast(df) if measured(df) <= limit else df


def partitions(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Shuffle partitions for ``df``: the session's number, or more if the input is estimated to be larger than so many bytes each."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, -(-size // bytes_each))  # beyond that no size is known


def least_rows(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of each ``part`` that come first by ``rank`` (a 64-bit hash), then ``id``.

    Rows are counted by the rank's upper 16 bits, in the tasks first, so that only rows up to the slot
    where a part's count reaches ``n`` are sorted: about ``n`` and one slot's rows, however many tasks read.
    """
    slot = F.shiftright("rank", 48).alias("slot")
    counted = df.groupBy("part", slot).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("slot")) - F.col("n")
    last = counted.withColumn("before", before).where(F.col("before") < n).groupBy("part").agg(F.max("slot").alias("last"))
    last = small(saved(last, scratch(df.sparkSession), "last"))
    near = df.join(last, "part").where(F.shiftright("rank", 48) <= F.col("last")).drop("last")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("rank", "id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them (edges: a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(least, "a")
    return (
        met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionAll(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


#: Links that a task contracts at once.
LINKS = 1 << 20


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable over the links) of every node of the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (x, y):  # hang each link's larger root on the smaller one
            np.minimum.at(root, root[side], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _contracted(batches):
    """Links in parts of ``LINKS``, each replaced by its nodes' links to the least one reachable in the part."""

    def part(held):
        node, root = roots_of(*(np.concatenate(x) for x in zip(*held)))
        far = node != root
        return pa.RecordBatch.from_pydict({"a": pa.array(node[far]), "b": pa.array(root[far])})

    held, n = [], 0
    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        n += x.num_rows
        if n >= LINKS:
            yield part(held)
            held, n = [], 0
    if n:
        yield part(held)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node that has a link; root is the component's smallest node.

    ``edges`` has two longs ``a`` and ``b``.  Tasks contract parts of ``LINKS``
    links first.  If there is more than one part, alternating large-star and
    small-star rounds follow, O(log^2 n) whatever the diameter; each round
    pre-aggregates the minimum of a node before it meets its links, so one very
    large component costs no more than many small ones.  Rounds end when a
    checksum over the links no longer changes.
    """
    spark = edges.sparkSession
    bounded_batches(spark)
    links = saved(edges.where("a <> b").select("a", "b"), folder, "links")
    parts = max(1, -(-links.count() // LINKS))
    now = saved(links.coalesce(parts).mapInArrow(_contracted, "a long, b long"), folder, "links-0")
    mark = F.expr("bit_xor(xxhash64(a, b))").alias("x")
    before, k = now.agg(F.count(F.lit(1)).alias("n"), mark).first() if parts > 1 else {"n": 0}, 0
    while before["n"]:
        k += 1
        after = saved(_small_star(_large_star(now)), folder, f"links-{k}")
        seen = after.agg(F.count(F.lit(1)).alias("n"), mark).first()
        removed(spark, f"{folder}/links-{k - 1}")
        now, same, before = after, seen == before, seen
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
