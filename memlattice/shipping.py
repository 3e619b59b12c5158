"""Makes this package importable for Python workers that don't have it on their path; and names the folder that all workers share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()
_OWN: dict[str, str] = {}
ROOT = Path(__file__).resolve().parent.parent


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a folder of our own, if all of Spark runs in this process; else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="memlattice-")
    return _OWN[app]


def ship(spark: SparkSession) -> None:
    """Once for each application: unless PYTHONPATH names the package's folder, an archive of it goes to all workers through Spark."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    _DONE.add(app)
    if str(ROOT) in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="memlattice-")), "memlattice.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "memlattice").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
