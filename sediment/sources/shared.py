"""What executors share with the driver: this package's code, and folders for files that outlive a task."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Makes this package importable on the executors, whatever put it on the driver's path."""
    spark = spark or SparkSession.getActiveSession()
    context = spark.sparkContext if spark else None
    if context is None or getattr(context, "_sediment_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="sediment-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "sediment_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)
    context._sediment_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under spark.checkpoint.dir; where that is unset, a local folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_sediment_shared", None)
        if not base:
            base = tempfile.mkdtemp(prefix="sediment-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext._sediment_shared = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
