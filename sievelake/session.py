"""Sessions with the settings that results depend on, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(name: str = "sievelake", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI errors on, adaptive execution with skew joins; the rest is the cluster's."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, through Spark's own file service."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{here.name}.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)


#: Folders that were made in the shared folder, by application, and the tables that lie in them or in others.
_MADE: dict[str, list[str]] = {}
_TABLES: dict[str, dict[str, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset on a single machine, a
    new temporary one is set; on a cluster it must be set."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sievelake-")
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, for what :func:`discard` deletes."""
    path = f"{shared_folder(spark)}/sievelake/{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def table_name(spark: SparkSession, path: str) -> str:
    """A new name for a table whose files lie under ``path``; :func:`discard` drops the table with that path, and all of them when
    it is to delete all. What such a table is for, its buckets, only a catalog keeps."""
    name = f"sievelake_{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, {})[name] = path
    return name


def made(spark: SparkSession) -> int:
    """How many such paths this application has handed out and not discarded."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, since: int = 0, last: int = 0) -> int:
    """Delete what lies under the paths that this application was handed since there were ``since`` of them, but for the ``last``
    ones, once what reads them is written; how many paths. A job beside which others run in the same application calls it
    when all are done."""
    paths = _MADE.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - last]
    del paths[since : len(paths) - last]
    tables = _TABLES.get(spark.sparkContext.applicationId, {})
    for name in [n for n, path in tables.items() if not since and not last or any(path == g or path.startswith(f"{g}/") for g in gone)]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # files stay, as their place was given
        del tables[name]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)
