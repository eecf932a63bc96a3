"""Makes this package importable by the Python workers of a session.

The driver may have found the package through its own working directory or
``sys.path``; executors on other machines have neither.  The package's sources
travel as one small zip by ``SparkContext.addPyFile``, so an executor that
joins later gets them as well.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_MARK = "_weir_shipped"


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once."""
    context = spark.sparkContext
    if getattr(context, _MARK, False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()  # served by the driver as long as it lives
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "weir.zip")
    with zipfile.ZipFile(path, "w") as out:
        for where, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    out.write(full, os.path.join("weir", os.path.relpath(full, root)))
    context.addPyFile(path)
    setattr(context, _MARK, True)
    return spark
