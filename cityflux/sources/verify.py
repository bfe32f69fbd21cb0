"""Manifest rows and file hashes, checked as tables."""

from __future__ import annotations

import hashlib
import sys
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.contracts import MANIFEST, enforce

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: bytes up to which a file is one value of Spark's reader, and bytes read at once beyond that
WHOLE, PIECE = 256 << 20, 8 << 20


class ChecksumMismatch(RuntimeError):
    """A file on storage does not have the hash its manifest promises."""


def manifest_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Manifest entries as a table; missing, empty, unknown or bad fields are refused."""
    columns = sorted({key for entry in entries for key in entry})
    schema = ", ".join(f"`{c}` string" for c in columns) or "name string"
    rows = [tuple(entry.get(c) for c in columns) for entry in entries]
    df = spark.createDataFrame(rows, schema)
    if "sha256" not in columns:
        df = df.withColumn("sha256", F.lit(None).cast("string"))
    return enforce(df, MANIFEST)


def manifest_entry(manifest: DataFrame, name: str) -> dict:
    found = manifest.where(F.col("name") == name).head(1)
    if not found:
        raise KeyError(f"no manifest entry named {name!r}")
    return found[0].asDict()


def _opened(path: str):
    """A file on storage as a stream."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    store, inside = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return store.open_input_stream(inside)


def _hash_in_pieces(batches):
    """The digest's state goes on from piece to piece, so memory does not depend on the file."""
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["path", "length", "sha256"])


def file_hashes(
    spark: SparkSession, directory: str, pattern: str = "*", whole: int = WHOLE
) -> DataFrame:
    """(name, path, length, sha256) of every file; files are hashed in parallel.

    Files of up to ``whole`` bytes are hashed by Spark, whatever store they are in. Larger ones
    are read in pieces by the tasks, from stores that pyarrow opens (local, HDFS, S3, GCS, ABFS).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    # the length is known from the listing: contents of larger files are not read here
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.select("path", "length").where(F.col("length") > whole)
    large = large.mapInArrow(_hash_in_pieces, "path string, length long, sha256 string")
    base = F.element_at(F.split("path", "/"), -1)
    return small.unionByName(large).select(
        F.regexp_replace(base, r"\.[^.]*$", "").alias("name"), "path", "length", "sha256"
    )


def verify_files(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per file: ok, mismatch, unverified (no hash promised) or unlisted."""
    promised = manifest.select("name", F.lower("sha256").alias("expected"), F.lit(1).alias("_in"))
    status = (
        F.when(F.col("_in").isNull(), "unlisted")
        .when(F.col("expected").isNull(), "unverified")
        .when(F.col("expected") == F.lower("sha256"), "ok")
        .otherwise("mismatch")
    )
    return hashes.join(promised, "name", "left").select(
        "name", "length", "sha256", "expected", status.alias("status")
    )


def require_verified(hashes: DataFrame, manifest: DataFrame) -> None:
    """Raise for any wrong or missing file of the manifest (one row per entry)."""
    report = verify_files(hashes, manifest)
    wrong = [r["name"] for r in report.where("status = 'mismatch'").select("name").collect()]
    gone = [
        r["name"] for r in manifest.join(hashes, "name", "left_anti").select("name").collect()
    ]
    if wrong or gone:
        raise ChecksumMismatch(f"hash differs: {sorted(wrong)}; missing: {sorted(gone)}")
