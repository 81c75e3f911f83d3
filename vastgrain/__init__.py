"""A Spark-native engine for large scientific tables, point clouds, matrices, sequences, logs and descriptions."""

from __future__ import annotations

import io
import os
import tempfile
import weakref
import zipfile

_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark) -> None:
    """Make this package importable in the session's Python workers, wherever they run (once a session)."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("vastgrain", os.path.relpath(path, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="vastgrain-code-"), "vastgrain_code.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(path)  # Spark's own file server hands it to executors
    _SHIPPED.add(context)
