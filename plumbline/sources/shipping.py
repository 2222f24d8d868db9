"""Make the package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import sysconfig
import tempfile
import zipfile

from pyspark.sql import SparkSession

import plumbline

_SHIPPED: set[str] = set()


def package_zip() -> str:
    """A zip of the package's sources, made from the folder it was imported from."""
    top = os.path.dirname(os.path.abspath(plumbline.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="plumbline-zip-"), "plumbline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("plumbline", os.path.relpath(full, top)))
    return path


def ship(spark: SparkSession) -> None:
    """Send the sources to the workers once per application, unless the package is installed.

    The driver serves the zip to every executor itself, late ones included, so
    no shared folder is needed.
    """
    sc = spark.sparkContext
    top = os.path.abspath(plumbline.__file__)
    installed = any(top.startswith(os.path.abspath(p) + os.sep) for p in sysconfig.get_paths().values())
    if not installed and sc.applicationId not in _SHIPPED:
        sc.addPyFile(package_zip())
        _SHIPPED.add(sc.applicationId)
