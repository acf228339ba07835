"""Sessions with the settings that the engine expects, and shipping the package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent

#: Settings of new sessions; sessions made elsewhere are used as they are.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}

_shipped: set[str] = set()


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf: more settings, with double underscores for dots."""
    builder = SparkSession.builder.appName("windrow")
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, where they would not find it by their path or working folder."""
    context = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    near = context.master.startswith("local") and (str(ROOT) in paths or (Path.cwd() / "windrow").exists())  # executors share the driver's machine
    if context.applicationId in _shipped or near:
        return
    _shipped.add(context.applicationId)
    where = tempfile.mkdtemp(prefix="windrow-")
    context.addPyFile(shutil.make_archive(f"{where}/windrow", "zip", ROOT, "windrow"))
