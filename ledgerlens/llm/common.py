"""What the operators of this subpackage share: table access, written intermediate
tables in the shared folder, size-checked broadcasts and the definition of a word."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_root

# A word is a run of characters other than blank, tab, line feed, vertical tab,
# form feed and carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """All words of a text as an array; null or blank text has none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0,
                  F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def text_hash() -> Column:
    """64 bits of a text, which tell the rows of one doc_id (or of none) apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage in a form that outlives any executor; the files are removed when
    the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{shared_root(spark)}/ledgerlens-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Hint a broadcast only for a (narrow, already stored) side of at most ``max_rows``
    rows; beyond that the planner's shuffle join with skew splitting does the work."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application (what
    ``--py-files`` does). Spark's own file distribution carries it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    sources = sorted(os.path.join(d, f) for d, _, files in os.walk(package) for f in files if f.endswith(".py"))
    content = {os.path.relpath(f, root): open(f, "rb").read() for f in sources}
    digest = hashlib.sha256(repr(sorted(content.items())).encode()).hexdigest()[:12]
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-"), f"{os.path.basename(package)}-{digest}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name, data in content.items():
            z.writestr(name, data)
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


# rows of an Arrow batch: they are whole texts or vectors here, and JVM and worker both hold a batch
BATCH_ROWS = 1000
_BATCH_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers, ``BATCH_ROWS`` rows at a time at most (a
    setting of the session that changes memory, not results)."""
    spark = df.sparkSession
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH_ROWS_KEY)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS_KEY, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)
