"""Brings this package to the executors, wherever the driver found it."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def _archive() -> bytes:
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, names, files in os.walk(root):
            names.sort()
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    with open(path, "rb") as file:
                        info = zipfile.ZipInfo(os.path.join("flowlark", os.path.relpath(path, root)), (2020, 1, 1, 0, 0, 0))
                        archive.writestr(info, file.read(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_flowlark_shipped", False):
        return
    data = _archive()
    folder = tempfile.mkdtemp(prefix="flowlark-")
    path = os.path.join(folder, f"flowlark_{hashlib.sha256(data).hexdigest()[:12]}.zip")
    with open(path, "wb") as file:
        file.write(data)
    context.addPyFile(path)
    context._flowlark_shipped = True
