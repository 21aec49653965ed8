"""Tables that a job writes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Partitions up to which a task writes rows to their files as they come. For more, it holds and sorts all that it reads.
DIRECT = 200


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session, where one machine does all, may lack it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="clinmill-"))


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/clinmill/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs a reread, not the work above."""
    path = scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that a loop has done with."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *keys: str, piece: int = 4 << 20, rows: int = 1 << 18, of: DataFrame | None = None) -> DataFrame:
    """df by hash of the keys, in a partition for each `piece` bytes of the files that it (or `of`) reads, or for each `rows` rows
    of those that are Parquet, whichever makes more: what a task holds of a key-wise sum stays the same however large they are
    and however well they are packed. Frames spread by the same keys and `of` join as they lie.

    For more than DIRECT partitions rows are dealt out to DIRECT tasks first: a task of the scan may read 128 MB of well-packed
    files, which it would hold, and one of these a DIRECT-th of the rows."""
    jvm = df.sparkSession._jvm
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in (of or df).inputFiles()]  # names are URL-encoded
    size = sum(f.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(f).getLen() for f in files)
    packed = [re.sub(r"([\\*?\[\]{}])", r"\\\1", f.toString()) for f in files if f.getName().endswith(".parquet")]
    n = df.sparkSession.read.schema("__none int").parquet(*packed).count() if packed else 0  # of the footers
    parts = max(8, -(-size // piece), -(-n // rows))
    if parts > DIRECT:
        df = df.withColumn("__d", F.xxhash64(*keys)).repartition(DIRECT, "__d").drop("__d")
    return df.repartition(parts, *keys)


def placed(df: DataFrame, name: str) -> DataFrame:
    """df, which reads one table, with the place of a row in it as `name`: files go by their names, as DuckDB takes them, and not by size as
    Spark's tasks do. To be called before rows are exchanged."""
    files, at = sorted(set(df.inputFiles())), F.monotonically_increasing_id()  # which rises with the place in a file
    if len(files) < 2:
        return df.withColumn(name, at)
    order = df.sparkSession.createDataFrame(list(enumerate(files)), "__f int, __path string")
    d = df.withColumns({"__p": F.input_file_name(), "__m": at})
    return d.join(F.broadcast(order), d["__p"] == order["__path"], "left").select(*df.columns, F.struct("__f", "__m").alias(name))


def if_small(table: DataFrame, most: int = 20_000) -> DataFrame | None:
    """A table marked for broadcast if it has at most `most` rows, else None."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else None
