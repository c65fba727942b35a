"""Operators for preparing training data: filters, duplicates, mixing, archives and token output.

Their tasks import this package, so its folder is put on the path of Python workers: by the environment for a
session that starts later, and by the context for one that runs. On a cluster, ship the package with ``--py-files``.
"""

import os
from pathlib import Path

from pyspark import SparkContext

_ROOT = str(Path(__file__).resolve().parents[2])


def _with_root(path: str) -> str:
    return path if _ROOT in path.split(os.pathsep) else os.pathsep.join(x for x in (_ROOT, path) if x)


os.environ["PYTHONPATH"] = _with_root(os.environ.get("PYTHONPATH", ""))
if SparkContext._active_spark_context is not None:
    _environment = SparkContext._active_spark_context.environment
    _environment["PYTHONPATH"] = _with_root(_environment.get("PYTHONPATH", ""))
