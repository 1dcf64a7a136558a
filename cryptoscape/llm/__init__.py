"""Operators for preparing training data from document and page tables."""

import os
import site
import sys
from pathlib import Path

from pyspark import cloudpickle


def _workers_find(root: Path) -> bool:
    """Whether Python workers, who search their own path, can import from ``root``."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    return any(p and Path(p).resolve() == root for p in places)


if not _workers_find(Path(__file__).resolve().parents[2]):
    # a package that only the driver can import travels with the functions that use it
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
