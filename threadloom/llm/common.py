"""What the corpus operators share: tables, scratch space, Arrow functions over texts."""

from __future__ import annotations

import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch at most; with long texts the usual 10 000 rows would be a large message.
BATCH_ROWS = 500
_shipped: set[str] = set()
_local: dict[str, str] = {}
#: Paths that this process has written to, in order.
_written: list[str] = []
#: Those of the last stage.
_passed: list[str] = []


def ready(spark: SparkSession) -> None:
    """Keep Arrow batches small and make this package importable on the executors."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.realpath(os.path.join(os.path.dirname(__file__), "..", ".."))
    app = spark.sparkContext.applicationId
    if app in _shipped or root in map(os.path.realpath, filter(None, os.environ.get("PYTHONPATH", "").split(":"))):
        return
    path = os.path.join(tempfile.mkdtemp(), "threadloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "threadloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, a local master gets a
    folder of its own; a cluster is told to set it, as its executors would not see such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='threadloom-')}")
    path = f"{base.rstrip('/')}/threadloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder. Lost executors don't lose it."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps. It does so once the driver's garbage is collected, which a driver
    with little to do of its own may put off until disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that keep() wrote."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _written.remove(path)


def stage(fn: Callable) -> Callable:
    """A stage (spark, docs, sf_dir) of a chain whose results are written before the next one begins: the tables that the
    stage before wrote on its way are no longer read then, and go."""

    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, [p for p in _passed if p in _written])
        before = len(_written)
        out = fn(spark, docs, sf_dir)
        _passed[:] = _written[before:]
        return out

    return run


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2... that is not a column of df (names compare without case)."""
    taken, out, k = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def over_texts(fn: Callable[[list], Sequence[Sequence]], schema: pa.Schema):
    """A column function: fn gets a list of texts (None where null) and returns one sequence per field of schema.

    Marked nondeterministic so that the optimiser never evaluates it twice.
    """
    kind = pa.struct(list(schema))

    def call(texts: pa.Array) -> pa.Array:
        cols = fn(texts.to_pylist())
        return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], fields=list(schema))

    from pyspark.sql.pandas.types import from_arrow_type

    call.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, from_arrow_type(kind)).asNondeterministic()


def held(column, modulus: int, remainder: int):
    """crc32 of the id as text, modulo modulus, equals remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, marked for broadcast only where a count finds it small; df should be written (see keep) or cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
