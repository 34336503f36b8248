"""Folders of files as tables, and files back to folders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions import text as T


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, relative, name, ext, kind, content and sha256 of every file below a folder. Columns that are not used, the
    content among them, are not read. Lock files (~$...) are left out; so are empty files, which Spark's reader passes over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    relative = F.substring_index(plain, root.split(":")[-1].rstrip("/") + "/", -1)
    named = files.select("path", relative.alias("relative"), "content").withColumn("name", F.substring_index("relative", "/", -1))
    return named.select("path", "relative", "name", F.lower(T.suffix(F.col("name"))).alias("ext"), T.kind_of(F.col("name")).alias("kind"), "content", F.sha2("content", 256).alias("sha256")).where("name NOT LIKE '~$%'")


def present(spark: SparkSession, root: str) -> DataFrame:
    """dir and name of the files below a folder, of which none need be there. Contents are not read."""
    try:
        files = scan(spark, root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "dir string, name string")
    return files.select(F.when(F.contains("relative", F.lit("/")), F.regexp_replace("relative", "/[^/]*$", "")).otherwise("").alias("dir"), "name")


def images(spark: SparkSession, root: str) -> DataFrame:
    """Bitmaps below language directories, with language and progress folder."""
    found = scan(spark, root).where("kind = 'bitmap'")
    return found.withColumns({"language": T.language_directory(F.col("relative")), "folder": T.progress_folder(F.col("relative"))}).where("language IS NOT NULL")


def write_files(frame: DataFrame, root: str, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """Writes one file per row below a folder that all tasks share: first beside its place, then renamed, so that a task
    that is run again leaves whole files only. Returns name and error of each."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for b in batches:
            errors = []
            for name, content in zip(b[name_col], b[content_col]):
                path = os.path.normpath(os.path.join(root, name))
                part = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}.tmp")
                try:
                    if not path.startswith(os.path.normpath(root) + os.sep):
                        raise ValueError("the name leaves the folder")
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(part, "wb") as out:
                        out.write(content)
                    os.replace(part, path)
                    errors.append(None)
                except (OSError, ValueError) as error:
                    errors.append(f"{type(error).__name__}: {error}")
                    if os.path.exists(part):
                        os.unlink(part)
            yield pd.DataFrame({"name": b[name_col], "error": pd.array(errors, "object")})

    return frame.select(name_col, content_col).mapInPandas(put, "name string, error string")


def tree_checksum(files: DataFrame) -> DataFrame:
    """One digest of a tree: SHA-256 over path, language and digest of each file, by path components.

    The digests of the files are made where the files are; only they come together, a short row each."""
    rows = files.select(F.split("relative", "/").alias("k"), F.concat_ws("\t", "relative", F.coalesce("language", F.lit("")), "sha256").alias("row"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda r: r["row"]), "\n"), 256).alias("checksum"), F.count("*").alias("files"))
