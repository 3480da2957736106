"""Making this package importable in Python workers that weren't started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_DONE = "_loomgraph_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a session, unless their path has it already."""
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT in known or os.getcwd() == _ROOT or getattr(spark.sparkContext, _DONE, False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), "loomgraph.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(os.path.join(_ROOT, "loomgraph")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(target)
    setattr(spark.sparkContext, _DONE, True)
