"""Session settings that the engine's results rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "evenkeel", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use `_` for `.`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that functions of it can run there."""
    done = f"evenkeel-{spark.sparkContext.applicationId}"
    if os.environ.get("EVENKEEL_SHIPPED") == done:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "evenkeel_ship.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    os.environ["EVENKEEL_SHIPPED"] = done
