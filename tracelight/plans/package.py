"""Ships this package to the workers of a session."""

import os
import tempfile
import zipfile

_SHIPPED: set[str] = set()


#: Bytes and rows of the Arrow batches that a worker holds, and the values of Spark's own that they replace.
BATCHES = {"maxBytesPerBatch": ("4m", ("67108864b", "64MB")), "maxRecordsPerBatch": ("2048", ("10000",))}


def bounded(spark) -> None:
    """Batches bounded by bytes: a worker makes many times as much of one in lines. The
    settings must hold until the result is read, so they stay; a session's own are left."""
    for name, (value, default) in BATCHES.items():
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) in default:
            spark.conf.set(name, value)


def ship(spark) -> None:
    bounded(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tracelight-"), "tracelight_engine.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
