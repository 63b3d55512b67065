"""Small files that only one writer can create, for numbering and for swapping pointers.

``put`` creates a file if there is none of its name; among writers at the same time exactly one
succeeds.  Stores that Hadoop's file systems reach do this on creation without overwriting; in
a local folder the operating system's exclusive creation does.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file was created here; one that exists stays as it is."""
    fs, where = _file_system(spark, path)
    fs.mkdirs(where.getParent())
    if fs.getUri().getScheme() == "file":
        # Written aside and linked, so no reader finds it empty.
        name = urlparse(fs.makeQualified(where).toString()).path
        aside = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        with open(aside, "x") as out:
            out.write(text)
        try:
            os.link(aside, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
    try:
        out = fs.create(where, False)
    except Exception as error:
        if fs.exists(where):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read(spark: SparkSession, path: str) -> str | None:
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The names in a folder that are whole numbers, ascending."""
    fs, where = _file_system(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(where)) if n.isdigit())


def next_number(spark: SparkSession, folder: str, text: str, least: int = 1) -> int:
    """The next free number in a folder, taken for good; ``text`` says by whom."""
    while True:
        n = max([least - 1, *numbers(spark, folder)]) + 1
        if put(spark, f"{folder}/{n}", text):
            return n
