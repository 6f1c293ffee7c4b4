"""Raster product catalogue, file inventory and checksums."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def catalogue(spark: SparkSession) -> DataFrame:
    """The fixed product list (seven rows)."""
    return spark.createDataFrame(
        [(i + 1, *p) for i, p in enumerate(K.PRODUCTS)],
        "ordinal int, product string, filename string, kind string, resolution_m double, gb double")


def resolve(products: DataFrame, listing: DataFrame, local_root: str, remote_root: str) -> DataFrame:
    """Add `uri`: the local path if `listing` (filename, ...) has the file, else the remote one."""
    local = listing.select("filename").distinct().withColumn(
        "_local", F.concat(F.lit(local_root.rstrip("/") + "/"), "filename"))
    remote = F.concat(F.lit(remote_root.rstrip("/") + "/"), "filename")
    return products.join(local, "filename", "left").withColumn(
        "uri", F.coalesce("_local", remote)).drop("_local")


def total_volume(products: DataFrame) -> DataFrame:
    return products.groupBy().agg(F.count(F.lit(1)).alias("products"), F.sum("gb").alias("gb"))


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, filename, length) of files, from metadata columns only: contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", str(recursive).lower()).load(path))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length")


def checksums(spark: SparkSession, path: str, glob: str = "*", block: int = 1 << 23) -> DataFrame:
    """SHA-256 per file of any size: one file per task, read in blocks from wherever its URI points.

    Empty files are not listed by the scan and have no row.
    """
    def digest(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "sha256": [one(p) for p in pdf["path"]]})

    def one(uri: str) -> str:
        found = hashlib.sha256()
        store, inner = FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
        with store.open_input_stream(inner) as stream:
            while part := stream.read(block):
                found.update(part)
        return found.hexdigest()

    files = list_files(spark, path, glob).select("path", "length")
    return files.repartition("path").mapInPandas(digest, "path string, length long, sha256 string")


def payload_checksums(df: DataFrame, content) -> DataFrame:
    """SHA-256 of a binary or string column, for payloads that live in tables."""
    return df.withColumn("sha256", F.sha2(F.col(content) if isinstance(content, str) else content, 256))
