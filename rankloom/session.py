"""Session for local runs, and the shared scratch folder."""

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus=8, shuffle_partitions=None, memory="12g"):
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_roots = {}


def scratch_dir(spark, name):
    """A new folder name under the folder the cluster shares.

    The cluster names that folder in ``spark.checkpoint.dir``.  Where the setting is
    absent, a session on one machine (tests) takes a temporary folder; on a cluster that
    would lose rows, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting is fixed once a session runs, so the folder is remembered here
        root = _local_roots.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="rankloom-")
        _local_roots[spark.sparkContext.applicationId] = root
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


_shipped = set()


def ship_package(spark):
    """Make this package importable in the Python workers of the session, once.

    Not needed where the package is installed on all machines.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="rankloom-"), "rankloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
