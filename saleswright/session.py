"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "saleswright", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or reuse) a session. Shuffle width is left to the cluster and AQE unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a master in this very process may do without that setting (tests): it gets a temporary folder of this
    machine, removed at the end. On a cluster such a folder would be out of the executors' reach: an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = _local_root()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(context.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Removes the scratch folders of this application; call it when no frame that reads them is left."""
    context = spark.sparkContext
    made = _MADE.pop(context.applicationId, [])
    for path in made:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    return len(made)


def _local_root() -> str:
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="saleswright-")
        atexit.register(shutil.rmtree, _LOCAL, ignore_errors=True)
    return _LOCAL


_LOCAL: str | None = None
_MADE: dict[str, list[str]] = {}
