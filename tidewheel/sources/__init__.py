"""Tables in and out: Parquet, CSV, delimited bulk files, JDBC and SQL text, with one place for null handling."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import execute, jdbc, jdbc_insert  # noqa: F401


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """A parameterised statement; errors are raised."""
    return spark.sql(sql, args=args or None)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_path(spark: SparkSession, root: str, name: str) -> str:
    """Where a table's rows are now: the version that its pointer names, or its plain folder if it has none."""
    pointer, fs = _fs(spark, f"{root}/{name}.current")
    if not fs.exists(pointer):
        return f"{root}/{name}.parquet"
    with contextlib.closing(fs.open(pointer)) as stream:
        return f"{root}/{name}.versions/{bytes(stream.readAllBytes()).decode()}"


def _point(spark: SparkSession, root: str, name: str, version: str) -> None:
    """Switch a table's pointer; a rename replaces it at once, so a reader sees the old version or the new one."""
    jvm = spark.sparkContext._jvm
    new, fs = _fs(spark, f"{root}/{name}.current.{version}")
    with contextlib.closing(fs.create(new, True)) as stream:
        stream.write(version.encode())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.current"), overwrite)


def stored_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current rows of a table that ``refresh``, ``append`` or ``replace_partitions`` wrote."""
    return spark.read.parquet(current_path(spark, root, name))


def refresh(df: DataFrame, root: str, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table anew and return it as read back.

    The rows become a new version, to which the table's pointer is switched when all of them are there: a job that fails leaves the
    old rows, and ``df`` may read the table itself. The version before stays for those who are reading it; older ones are deleted.
    """
    spark = df.sparkSession
    before, version = current_path(spark, root, name), uuid.uuid4().hex
    path = f"{root}/{name}.versions/{version}"
    writer = nan_to_null(df).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _point(spark, root, name, version)
    folder, fs = _fs(spark, f"{root}/{name}.versions")
    for status in fs.listStatus(folder):
        if status.getPath().getName() not in (version, before.rsplit("/", 1)[-1]):
            fs.delete(status.getPath(), True)
    return spark.read.parquet(path)


def replace_partitions(df: DataFrame, root: str, name: str, by: str) -> None:
    """Replace those partitions of a table that ``df`` has rows of, as single calendar years; the others stay.

    The files are swapped when the job is committed; one that fails before leaves all old rows.
    """
    path = current_path(df.sparkSession, root, name)
    nan_to_null(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, root: str, name: str) -> None:
    """Add rows by column name to a table that may not exist yet."""
    nan_to_null(df).write.mode("append").parquet(current_path(df.sparkSession, root, name))


def insert(df: DataFrame, table_name: str) -> None:
    """Add rows to a catalogue table by position."""
    nan_to_null(df).write.insertInto(table_name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    A temporary folder is made only where there is none and the session runs on one machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = getattr(sc, "_tidewheel_tables", None) or tempfile.mkdtemp(prefix="tidewheel-")
        sc._tidewheel_tables = named
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system; silent if it or the session has gone."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewheel-tables/{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, table_name: str, by: str, *, sort: tuple[str, ...] = (), buckets: int = 200) -> DataFrame:
    """A catalogue table in buckets of ``by``, sorted in each: work by that key over it needs no shuffle.

    A table of any size has one file a bucket, so ``buckets`` should put some hundred megabytes into each. Joins on more columns than ``by`` are
    spared the shuffle too where ``spark.sql.requireAllClusterKeysForCoPartition`` is false.
    """
    one = df.repartition(buckets, by)  # as Spark deals its buckets, so that a task writes one
    one.write.mode("overwrite").bucketBy(buckets, by).sortBy(by, *sort).saveAsTable(table_name)
    return df.sparkSession.table(table_name)


def save_csv(df: DataFrame, path: str, *, separator: str = ",", null: str = "") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=separator, nullValue=null)


def save_bulk(df: DataFrame, path: str) -> None:
    """Rows for a bulk load: separated by ``~``, null as ``None``, no header."""
    nan_to_null(df).write.mode("append").csv(path, header=False, sep="~", nullValue="None")


def read_bulk(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="~", nullValue="None")


def copy_as(spark: SparkSession, root: str, old: str, new: str, rename: dict[str, str] | None = None) -> DataFrame:
    """A copy of a table under a new name, with columns renamed."""
    return refresh(stored_table(spark, root, old).withColumnsRenamed(rename or {}), root, new)


def runs(combinations: list[tuple[str, str]], make: Callable[[str, str], dict[str, DataFrame]], root: str) -> list[str]:
    """Write every table that ``make(period, unit)`` gives for each combination; returns their names."""
    names = []
    for period, unit in combinations:
        for name, df in make(period, unit).items():
            full = f"{name}_per_{'semester_' if period == 'semester' else ''}{unit}"
            refresh(df, root, full)
            names.append(full)
    return names
