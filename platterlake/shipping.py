"""Sends this package to the executors, so that their Python workers can import it wherever they run."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_FOLDER = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Once for a context; does nothing where the package itself was loaded from an archive that was sent."""
    context = spark.sparkContext
    if getattr(context, "_platterlake_sent", False) or not os.path.isdir(_FOLDER):
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(_FOLDER)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("platterlake", os.path.relpath(path, _FOLDER)))
    path = os.path.join(tempfile.mkdtemp(prefix="platterlake-"), "platterlake-package.zip")
    with open(path, "wb") as f:
        f.write(body.getvalue())
    context.addPyFile(path)
    context._platterlake_sent = True
