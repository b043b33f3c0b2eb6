"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN_FOLDERS: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and for bench.py; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strataline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of the data folder, pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where the setting is unset the session must be a local one (tests, bench): then a
    temporary folder is made once. On a cluster a missing setting is an error, as a
    folder of the driver's machine would not be seen by the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="strataline-")
    return _OWN_FOLDERS[app]


#: Tables that were written and not removed yet.
_TABLES: dict[str, None] = {}


def _drop(spark: SparkSession, path: str) -> None:
    if _TABLES.pop(path, 0) == 0:
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: only a folder that this machine sees can still be removed
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    Losing an executor afterwards costs no recomputation. The table is compressed and
    columnar, so later steps read only the columns they use. It is removed when the
    driver's process ends, or by ``dropping``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataline/{name}-{uuid.uuid4().hex}"
    _TABLES[path] = None
    atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropping(spark: SparkSession):
    """Remove, at the end of the block, the tables that operators wrote in it: what they returned must have been used by then."""
    before = set(_TABLES)
    try:
        yield
    finally:
        for path in [p for p in _TABLES if p not in before]:
            _drop(spark, path)


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def width(spark: SparkSession) -> int:
    """Tasks that a shuffle is spread over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(column: str):
    """Without spaces, tabs and line ends at both ends."""
    return F.btrim(F.col(column), F.lit(" \t\r\n"))


def tokenizer_path(name: str) -> str:
    """A vocabulary file; the folder can be set by STRATALINE_TOKENIZERS."""
    return os.path.join(os.environ.get("STRATALINE_TOKENIZERS", "/opt/tokenizers"), name)
