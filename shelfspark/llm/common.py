"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: one ASCII blank.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for an expression that uses it many times."""
    return F.transform(F.array(value), fn)[0]


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def total(values: Column, kind: str = "long") -> Column:
    """Sum of an array of integers; 0 when it is empty."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array, by doubling: n log n steps instead of growing an array n times."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(
        rounds, F.transform(values, lambda x: x.cast("long")),
        lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0).cast("long"))),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch folder only for a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _scratch()
    return folder.rstrip("/")


_SCRATCH: list[str] = []


def _scratch() -> str:
    if not _SCRATCH:
        _SCRATCH.append("file://" + tempfile.mkdtemp(prefix="llm-"))
    return _SCRATCH[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Paths of tables written since ``start_record``.
_RECORD: list[str] = []


def written(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, label)
    _RECORD.append(path)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def start_record() -> list[str]:
    """Forget which tables were written; returns their paths."""
    paths = list(_RECORD)
    _RECORD.clear()
    return paths


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def batches_by_bytes(items: Iterator, size: Callable, limit: int) -> Iterator[list]:
    """Lists of consecutive items whose sizes add up to about ``limit``; one larger item is a list of its own."""
    held, n = [], 0
    for item in items:
        k = size(item)
        if held and n + k > limit:
            yield held
            held, n = [], 0
        held.append(item)
        n += k
    if held:
        yield held


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """File of a public tokenizer; ``folder`` replaces the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of one Arrow batch on its way to Python; a batch holds one row at least.
ARROW_BYTES = 4 << 20


def map_batches(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so that long texts do not add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, size: Callable | None = None) -> DataFrame:
    """Rows as tuples in, rows as tuples out, one partition at a time; ``size`` gives the bytes of an output row."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    size = size or (lambda row: 200)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        for part in batches_by_bytes(fn(rows()), size, ARROW_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return map_batches(df, run, schema)
