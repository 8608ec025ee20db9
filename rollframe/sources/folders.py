"""Folders by value (``column=value``) as Spark names them, and where tasks can open them themselves."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession

#: The folder of null and of an empty text.
DEFAULT = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on a file system that is mounted where the tasks run; None in any other store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(where).toUri().getPath() if store.getUri().getScheme() == "file" else None


def folder_name(column: str, value: str | None) -> str:
    return f"{column.translate(_ESCAPED)}={value.translate(_ESCAPED) if value else DEFAULT}"


def folder_value(name: str) -> str | None:
    """The value in a folder's name."""
    value = name.partition("=")[2]
    return None if value == DEFAULT else unquote(value)
