"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    files, digest = {}, hashlib.sha256()
    for folder, _, names in sorted(os.walk(top)):
        for name in sorted(names):
            if name.endswith(".py"):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    files[os.path.relpath(path, os.path.dirname(top))] = body = f.read()
                digest.update(path.encode() + body)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    folder = tempfile.mkdtemp(prefix="loomspan-ship-")
    path = os.path.join(folder, f"loomspan-{digest.hexdigest()[:12]}.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
