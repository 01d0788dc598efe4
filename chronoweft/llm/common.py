"""Shared helpers: written tables in the shared folder, input scans, fold rule, word caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.sources.written import written

#: Entries of a worker's word cache; at about 250 bytes an entry this is some 50 MB. A full cache
#: only stops growing: words beyond it are computed again, so results don't depend on it.
CACHE_ENTRIES = 200_000

_held: dict = {}


def give_back() -> None:
    """What Python and its allocator hold free goes back to the system."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def worker_cache(key: object, make: Callable[[], object]):
    """What a Python worker keeps under ``key`` from task to task. Workers outlive stages, so asking for another key
    lets the old one go: a chain of operators needs the memory of its largest, not of all."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and reread it: lineage ends in a table that
    survives the loss of any executor, and nothing below it is computed twice."""
    return written(df, name)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing is going to read any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/chronoweft-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """The fold rule: crc32 of the id's decimal text, modulo 4, equals 2; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def with_carried(schema: str, df: DataFrame, carry: Sequence[str]) -> str:
    """``schema`` with the columns of ``df`` that a per-row operator hands on; they must not be named like its results."""
    if taken := {p.split()[0] for p in schema.split(", ")} & set(carry):
        raise ValueError(f"carried columns have names of results: {sorted(taken)}")
    return ", ".join([schema, *(f"`{f.name}` {f.dataType.simpleString()}" for f in (df.schema[c] for c in carry))])


def to_arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert
    from pyspark.sql.types import StructType

    return convert(StructType.fromDDL(ddl))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows, without a copy: only a part's texts need to become Python strings."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    """Texts of a column; null ones are empty."""
    return column.fill_null("").to_pylist()


def with_columns(b: pa.RecordBatch, kinds: pa.Schema, made: dict[str, object]) -> pa.RecordBatch:
    """A batch of the schema ``kinds`` from the values ``made`` and, for other names, the columns of ``b`` as they are."""
    columns = [pa.array(made[f.name], f.type, from_pandas=True) if f.name in made else b.column(f.name).cast(f.type) for f in kinds]
    return pa.RecordBatch.from_arrays(columns, schema=kinds)
