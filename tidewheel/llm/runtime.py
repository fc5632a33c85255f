"""Shared storage, lineage cuts and size-checked broadcasts for the text operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a single-long-column table that may be broadcast: 16 MB of raw ids.
BROADCAST_IDS = 2_000_000
#: Bytes of text that an Arrow batch loop handles at a time.
BLOCK_BYTES = 8 << 20


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps for its next task of the same kind; at most one such thing."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what was kept and give freed memory back to the machine, for the tasks that share the executor."""
    _KEPT.clear()
    trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A temporary folder is set only where the session names none and runs on one machine (local tests); a cluster
    without the setting is an error, as its executors would write where nobody reads.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = getattr(spark.sparkContext, "_tidewheel_dir", None)
        if at is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="tidewheel-")
            spark.sparkContext._tidewheel_dir = at
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidewheel/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_path``; silent if it or the session has gone."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have stopped already
        pass


_SCOPES: ContextVar[tuple[list[Stored], ...]] = ContextVar("scopes", default=())


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables stored inside are deleted at its end; those stored with ``keep`` at the end of the scope around it, if any."""
    tables: list[Stored] = []
    token = _SCOPES.set((*_SCOPES.get(), tables))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for t in tables:
            t.discard()


class Stored:
    """A DataFrame written to shared storage and reread: lost executors cost only the reading.

    With ``keep`` it outlasts the scope around it, because results are read from it later. Without a scope it is deleted when
    the driver ends.
    """

    def __init__(self, df: DataFrame, name: str, keep: bool = False):
        self.spark = df.sparkSession
        holders = _SCOPES.get()[:-1] if keep else _SCOPES.get()
        if holders:
            holders[-1].append(self)
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        discard(self.spark, self.path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    return Stored(df, name, keep).df


def keep_ids(
    df: DataFrame, column: str | list[str], ids: DataFrame, how: str = "left_semi", limit: int = BROADCAST_IDS, ready: bool = False
) -> DataFrame:
    """Rows of ``df`` whose ``column`` (or columns) is (``left_semi``) or is not (``left_anti``) in the columns of ``ids``.

    The ids are counted: up to ``limit`` values they are broadcast, so that wide rows stay where they are;
    beyond it both sides are shuffled. ``ids`` should be stored already (``ready``), else it is stored first.
    """
    columns = [column] if isinstance(column, str) else column
    names = [f"__tw_id{i or ''}" for i in range(len(columns))]
    ids = ids.toDF(*names) if ready else stored(ids.toDF(*names).distinct(), "ids")
    small = ids.count() * len(columns) <= limit
    on = [df[c] == ids[n] for c, n in zip(columns, names, strict=True)]
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), on, how)


ROW = "__tw_row"
#: Column with the SHA-256 of a text, in stages that tell rows by their texts.
DIGEST = "__tw_sha"


def numbered(df: DataFrame, name: str = "numbered", keep: bool = False) -> DataFrame:
    """``df`` with a row number in the column ``ROW``, stored with it so that it is the same for all that reads it."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name, keep)


def input_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` as long and ``text_col`` as UTF-8 bytes, whatever other columns there are."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").cast("binary").alias("text")
    )


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``limit`` bytes; a longer row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """Lists of ids and of texts (bytes or None) in blocks of bounded size."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, j in blocks(sizes, limit):
            yield ids.slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist()


def per_text(
    df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per text: ``make()`` runs once in a task and gives a function of (ids, texts) to columns."""
    return map_texts(input_texts(df, id_col, text_col), make, schema)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """As ``per_text`` for a frame that has (doc_id long, text binary) first already."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        work = make()  # once in a task
        for ids, texts in text_blocks(batches):
            columns = work(ids, texts)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow
            )
        trim()

    return df.mapInArrow(run, parsed)


def learns(modulus: int, held: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is not ``held``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held, F.lit(False))


def held_out(modulus: int, held: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``held``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
