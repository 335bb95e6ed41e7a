"""What the operators share: written intermediate tables, and columns that cannot clash."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Folders of this process's own, by application, for sessions on one machine that name none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, a local install) a temporary folder stands in.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = context.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="cohortry-")
        path = _OWN[app]
    return path.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of some 8 MB, where the session has no other setting of its own: rows may hold very long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == "67108864b":
        spark.conf.set(key, "8m")


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffles of a query that runs here are deleted as it ends, and not some time after the driver's next collection: what is written is read from its files."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Written:
    """A DataFrame written to the shared folder and read again: lineage is cut, lost executors cost nothing, and shuffles behind it go at once."""

    def __init__(self, df: DataFrame, label: str, compression: str | None = None):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        with cleaned(spark):
            df.write.parquet(self.path, compression=compression)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self._spark = spark
        self._fs().deleteOnExit(self._path())

    def _path(self):
        return self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def _fs(self):
        return self._path().getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self) -> None:
        """Delete the files, once nothing reads them any more."""
        self._fs().delete(self._path(), True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other characters stay as they are."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns beside it cannot clash with any of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def with_outputs(df: DataFrame, row: str, outputs: dict[str, Column]) -> list[Column]:
    """The columns of ``df``, packed in ``row``, and then ``outputs``; an output replaces a column of its name."""
    lower = {k.lower() for k in outputs}
    return [F.col(row).getField(c).alias(c) for c in df.columns if c.lower() not in lower] + [v.alias(k) for k, v in outputs.items()]


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    out: str,
    each: Callable[[list], dict[str, list]],
    as_bytes: bool = False,
) -> DataFrame:
    """Run ``each`` over Arrow batches of texts (null as empty); returns columns ``keep`` and those of DDL ``out``.

    Texts are taken in slices of some 2 MB, so that memory does not follow the batch size. A column of ``out`` replaces
    one of its name among ``keep``, whose first column, the id, always stays.
    """
    bounded_batches(df.sparkSession)
    made = {f.name.lower() for f in df.sparkSession.createDataFrame([], f"struct<{out}>").schema}
    keep = [c for i, c in enumerate(keep) if not i or c.lower() not in made]
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    empty = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = df.select(*kept, (empty.cast("binary") if as_bytes else empty).alias("t"))
    schema = df.sparkSession.createDataFrame([], f"struct<{out}>").schema
    for i, c in reversed(list(enumerate(keep))):
        schema.fields.insert(0, type(schema.fields[0])(f"k{i}", source.schema[f"k{i}"].dataType))
        schema.names.insert(0, f"k{i}")
    n = len(keep)
    names = schema.names[n:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for whole in batches:
            step = max(1, whole.num_rows * (2 << 20) // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                got = each(b.column(n).to_pylist())
                cols = [b.column(i).cast(arrow.field(i).type) for i in range(n)]
                cols += [pa.array(got[c], arrow.field(n + i).type) for i, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return source.mapInArrow(run, schema).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"`{c}`") for c in names]
    )
