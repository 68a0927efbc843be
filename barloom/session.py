"""Session builder, and the package's way to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once an application, unless their Python finds it anyway:
    installed, on PYTHONPATH, or in the working folder that local workers share."""
    app = spark.sparkContext.applicationId
    paths = {os.path.realpath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if app in _shipped or str(_ROOT) in paths or "site-packages" in _ROOT.parts:
        return
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="barloom-"))) / "barloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted((_ROOT / "barloom").rglob("*.py")):
            out.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow, few shuffle partitions: for one machine."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
    } | conf
    spark = SparkSession.builder.master(master).appName("barloom").config(map=settings).getOrCreate()
    ship(spark)
    return spark
