"""Operators of a training-data pipeline, each a function of DataFrames.

Their Python runs on executors, which must be able to import this package: where the path of Python doesn't
name its folder, it is added for workers that start from now on.  On a cluster ship the package with --py-files.
"""

import os
from pathlib import Path

from pyspark import SparkContext

_root = str(Path(__file__).resolve().parents[2])
if _root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [_root, os.environ.get("PYTHONPATH", "")]))
    if (_context := SparkContext._active_spark_context) is not None:
        _context.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]
