"""Folders that the driver and all executors see, for what is written between steps.

Results may be read from them as long as the session lives, so they go when it has ended: with the driver's process, or by remove_all() before.
What a killed driver leaves stays in the folder of its application.
"""
from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, with its file system. Where that is unset, a new one if the master is local; on a cluster, ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="shared-")
        _own[app] = root
    return qualified(spark, root)


def qualified(spark: SparkSession, root: str) -> str:
    """A folder as Spark itself reads it: without a scheme, on the cluster's default file system."""
    if "://" not in root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return root.rstrip("/")


#: Folders that scratch_folder() has named, with a session of theirs.
_made: dict[str, SparkSession] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; what is written to it is removed at the end."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove_all() -> int:
    """Remove the folders named so far; how many there were. Results that are read from them can't be read any more."""
    n = 0
    while _made:
        path, spark = _made.popitem()
        n += remove(spark, path)
    return n


@atexit.register
def _at_end() -> None:
    with contextlib.suppress(Exception):  # the Java side may be gone already
        remove_all()


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all that is in it, on whatever file system; whether there was one."""
    _made.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark._jsc is None else spark._jsc.hadoopConfiguration()).delete(p, True)
