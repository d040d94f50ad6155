"""Tables that readers always see whole: written under a version, published by one rename.

``folder/versions/<id>`` holds the rows of a version and ``folder/manifests/<number>.json`` names it.  A manifest is
written aside and renamed to the next free number, which fails when another writer took it; that writer's table then stays
and this one comes after it.  Readers take the manifest with the largest number.  A job that ends before the rename leaves an
unnamed version that nobody reads.
"""

from __future__ import annotations

import json
from uuid import uuid4

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _filesystem(spark: SparkSession, folder: str) -> tuple[JavaObject, JavaObject]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _filesystem(spark, f"{folder}/manifests")
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))


def write_version(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """The rows as an unnamed version; the table itself may be read while it is written."""
    version = uuid4().hex
    df.write.partitionBy(*(partition_by or [])).parquet(f"{folder}/versions/{version}")
    return version


def name_version(spark: SparkSession, folder: str, version: str, schema: StructType) -> int:
    """Makes a written version the current one and returns its number."""
    fs, base = _filesystem(spark, f"{folder}/manifests")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fs.mkdirs(base)
    aside = hadoop.Path(f"{folder}/manifests/{version}.part")
    out = fs.create(aside, True)
    out.write(json.dumps({"version": version, "schema": schema.jsonValue()}).encode())
    out.close()
    context = hadoop.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.java.lang.Enum.valueOf(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "NONE")
    while True:
        names = _manifests(spark, folder)
        number = int(names[-1][:-5]) + 1 if names else 1
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(hadoop.Path(f"{folder}/manifests/{number:010d}.json")), options)
            return number
        except Py4JJavaError as error:  # another writer took the number
            if "FileAlreadyExists" not in str(error.java_exception):
                raise


def publish(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> int:
    return name_version(df.sparkSession, folder, write_version(df, folder, partition_by), df.schema)


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    """The current table, or None before the first one is published."""
    names = _manifests(spark, folder)
    if not names:
        return None
    fs, path = _filesystem(spark, f"{folder}/manifests/{names[-1]}")
    stream = fs.open(path)
    try:
        manifest = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    schema = StructType.fromJson(manifest["schema"])
    return spark.read.schema(schema).parquet(f"{folder}/versions/{manifest['version']}").select(*schema.names)
