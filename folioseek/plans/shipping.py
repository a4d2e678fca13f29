"""Make this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from folioseek.plans.sizing import work_path

PACKAGE = Path(__file__).resolve().parents[1]

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once per application: by path where workers share this machine, else as a zip file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    if context.master.startswith("local"):
        known = context.environment.get("PYTHONPATH")
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(PACKAGE.parent), known]))
    else:
        add_zip(spark)
    _shipped.add(context.applicationId)


def add_zip(spark: SparkSession) -> str:
    """Put the zipped package into the shared folder and on the path of all workers."""
    context = spark.sparkContext
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent).as_posix())
    target = context._jvm.org.apache.hadoop.fs.Path(f"{work_path(spark, 'package')}/{PACKAGE.name}.zip")
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(content.getvalue())
    finally:
        stream.close()
    context.addPyFile(target.toString())
    return target.toString()
