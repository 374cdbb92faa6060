"""Files that appear whole or not at all, and only once: what makes a revision or a receipt visible."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder; errors in reaching it are raised, not taken for its absence."""
    place, files = _located(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> bool:
    place, files = _located(spark, path)
    return files.delete(place, True)


def commit(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file `path` with `text`, unless there is one: of several writers one succeeds and gets True.

    The text is written under another name first. A hard link (local files) or a rename that replaces nothing (HDFS)
    then gives it its name in one step. Stores whose rename copies, or replaces, make no such promise.
    """
    place, files = _located(spark, path)
    files.mkdirs(place.getParent())
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")  # readers skip such names
    out = files.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getUri().getScheme() == "file":
            to_java = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                jvm.java.nio.file.Files.createLink(to_java(place), to_java(own))
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" in str(e.java_exception):
                    return False
                raise
            return True
        return not files.exists(place) and files.rename(own, place)
    finally:
        if files.exists(own):
            files.delete(own, False)
