"""Makes this package importable in the tasks of a session, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import quantframe

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(quantframe.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quantframe-"), "quantframe.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("quantframe", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
