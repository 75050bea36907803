"""Sessions and what their workers need."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int = 8, memory: str = "16g", partitions: int | None = None) -> SparkSession:
    """A local session as the bench and the command line use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paperloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where that is unset, a new local folder, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        path = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, path, True)
        _LOCAL.append(f"file://{path}")
    return _LOCAL[0]


def ship_package(spark: SparkSession) -> None:
    """Gives the workers this package where they would not find it: neither the path nor the folder is theirs already."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or Path.cwd() == ROOT or getattr(spark.sparkContext, "_paperloom", False):
        return
    spark.sparkContext._paperloom = True
    path = Path(tempfile.mkdtemp(prefix="paperloom-package-")) / "paperloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "paperloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
