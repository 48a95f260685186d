"""Databases: named sets of tables, and where their rows come from."""

from __future__ import annotations

import gc
import os
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .model import Columns, ColumnDef, Key, Table, Tables, table_of
from .store import Entry, Store, scratch_root
from ..functions.types import Flags

#: When the driver copies rows: bytes in a batch and in a task, by estimate, and rows that it takes at a time; fixed values.
BATCH_BYTES, TASK_BYTES, TAKEN = 16 << 20, 4 << 20, 16


@dataclass(frozen=True)
class Database:
    name: str
    schema: str = ""
    tables: Tables = field(default_factory=Tables)

    def register(self, *models: type | Table) -> Database:
        """Add tables of models; registering a name again replaces it."""
        self.tables.add(*(t.with_schema(self.schema) for t in (m if isinstance(m, Table) else table_of(m) for m in models)))
        return self

    def with_schema(self, schema: str) -> Database:
        """A copy whose tables all belong to a schema."""
        out = Database(self.name, schema)
        out.tables.add(*(t.with_schema(schema) for t in self.tables.values()))
        return out

    def table(self, name: str) -> Table:
        return self.tables[name]

    def t(self, model: type) -> Table:
        return self.tables[table_of(model).name]


def feature_database(name: str) -> Database:
    """A database of its own for the feature named by PROJECT_FEATURE, if any."""
    feature = os.environ.get("PROJECT_FEATURE", "")
    return Database(f"{name}__{feature}" if feature else name)


def masked(url: str) -> str:
    """A connection url whose password is hidden."""
    url = re.sub(r"(://[^:/?#@]*:)[^@/?#]*(@)", r"\1******\2", url)
    return re.sub(r"([?&;]password=)[^&;]*", r"\1******", url, flags=re.I)


@dataclass(frozen=True)
class ServerSource:
    """Tables of a MySQL or PostgreSQL server by JDBC; the driver's jar comes with the session.

    A numeric column with bounds splits the scan, so that many tasks read it.
    An embedded database is open in the driver only: outside of a local session
    read() copies the rows that it holds then to where executors can read them.
    """

    url: str
    options: tuple[tuple[str, str], ...] = ()

    @property
    def embedded(self) -> bool:
        """Whether the url names no host, so that only the driver is known to reach the database."""
        return re.match(r"jdbc:[\w:+.-]*(//[^/]|@)", self.url) is None

    def with_database(self, name: str) -> ServerSource:
        return replace(self, url=re.sub(r"^(jdbc:\w+://[^/]+)/[^?;]*", rf"\1/{name}", self.url))

    def root(self) -> tuple[ServerSource, str]:
        """The server without the database, and the database's name; for an embedded one, the url that creates it."""
        found = re.match(r"^(jdbc:(\w+)://[^/]+)/([^?;]*)(.*)$", self.url)
        if found is None:
            return replace(self, url=f"{self.url};create=true"), ""
        home = "postgres" if found[2] == "postgresql" else ""
        return replace(self, url=f"{found[1]}/{home}{found[4]}"), found[3]

    def read(self, spark: SparkSession, table: str, column: str = "", low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", self.url).option("dbtable", table).options(**dict(self.options))
        if column:
            reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        out = reader.load()
        return copied(spark, out) if self.embedded and not spark.sparkContext._jsc.sc().isLocal() else out

    def __repr__(self) -> str:
        return f"ServerSource({masked(self.url)})"


def copied(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A scan's rows, read by the driver itself, one partition after the other, and written to a scratch store.

    The driver holds one batch, of BATCH_BYTES or, if they are larger, TAKEN rows, and the TAKEN rows after it.
    """
    jvm, store, parts = spark._jvm, Store(spark, scratch_root(spark)), []
    # each name looked up costs a call of the JVM
    buffer, listed = jvm.scala.collection.mutable.ArrayBuffer, jvm.scala.jdk.javaapi.CollectionConverters.asJava
    tasks, estimate = getattr(getattr(jvm.org.apache.spark, "TaskContext$"), "MODULE$"), jvm.org.apache.spark.util.SizeEstimator.estimate
    batch, size = buffer(), 0

    def write() -> None:
        rows = spark._jsparkSession.createDataFrame(spark._jsc.parallelize(listed(batch), 1 + size // TASK_BYTES), df._jdf.schema())
        parts.append(store.add("rows", DataFrame(rows, spark)))

    scan = df._jdf.rdd()
    for part in scan.partitions():
        task = tasks.empty()
        try:
            taken = scan.iterator(part, task).grouped(TAKEN)
            while taken.hasNext():
                rows = taken.next()
                more = estimate(rows)
                if size and size + more > BATCH_BYTES:
                    write()
                    batch, size = buffer(), 0
                    gc.collect()  # py4j's objects refer to themselves, and the JVM keeps what they stand for
                batch.addAll(rows)
                size += more
        finally:  # closes the connection
            task.markTaskCompleted(jvm.scala.Option.empty())
    if size:
        write()
    return store.read(Entry(df.schema.json(), tuple(parts)))


def introspect(df: DataFrame, name: str, keys: tuple[Key, ...] = (), schema: str = "") -> Table:
    """The table that a DataFrame's schema describes."""
    kinds = [ColumnDef(f.name.lower(), f.name, _Described(f.dataType), Flags(null=f.nullable)) for f in df.schema]
    return Table(name, Columns(kinds), keys, schema)


@dataclass(frozen=True)
class _Described:
    """A column type known only by its Spark type."""

    spark_type: object
