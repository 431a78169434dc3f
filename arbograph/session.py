"""Session and shared-storage helpers.

Executors can be lost at any time, so intermediate tables are written as
Parquet to the folder every machine can reach (``spark.checkpoint.dir``).  Where
the session names none, a local one gets a temporary folder, as in tests, and
any other raises.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "arbograph", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="arbograph-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what ``materialise`` stores meanwhile once the block ends, with an error too.

    Results must have been written or collected by then: frames that were made
    within read tables that are gone.  An inner block removes its own tables only.
    """
    paths: list[str] = []
    held = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(held)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps
    reuse the rows, and a lost executor loses none of them.

    ``batch_rows``: rows of an Arrow batch meanwhile, for whole texts that go
    to Python; smaller batches need less memory on both sides.  The table stays
    until the session's owner clears the folder, or until a ``scratch`` block ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (stored := _SCRATCH.get()) is not None:
        stored.append(path)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if batch_rows is not None:
            spark.conf.set(key, str(batch_rows))
        df.write.parquet(path)
    finally:
        if batch_rows is not None:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that Spark may send to every task by the size of its files.
SENT_ROWS = 250_000


def sent_by_rows(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins, which isn't sent to every task if it has more than ``SENT_ROWS`` rows.

    Spark goes by the size of files, a few MB of which may hold millions of
    rows; these take some hundred bytes each on the driver that sends them.
    """
    return df.hint("merge") if df.limit(SENT_ROWS + 1).count() > SENT_ROWS else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
