"""Folders for tables that must outlive the task or executor that wrote them."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster session names no folder that its driver and executors share."""


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="cellcast-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only a session that runs in one process may do without that setting; it gets a temporary
    folder of its own, which goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise NoSharedFolder("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
