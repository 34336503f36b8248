"""Names of output files: replacement, suffixes and collisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions import text as T
from textveil.operators.providers import replaced


def new_names(files: DataFrame, provider: str, name_col: str = "name") -> DataFrame:
    """name, the provider's new name with its suffix kept, and whether it is safe."""
    new = replaced(F.col(name_col), provider, True)["text"]
    return files.withColumn("new_name", T.kept_suffix(new, F.col(name_col))).withColumn("safe", T.is_safe_filename(F.col("new_name")))


def numbered_names(files: DataFrame) -> DataFrame:
    """Destinations (dir, new_name, order) where no name looks like a numbered one: numbers by a window."""
    n = F.row_number().over(Window.partitionBy("dir", "new_name").orderBy("order"))
    stem = F.regexp_replace("new_name", r"(?<=[^/])\.[^./]+$", "")
    return files.withColumn("destination", F.when(n == 1, F.col("new_name")).otherwise(F.concat(stem, F.lit(" ("), n, F.lit(")"), T.suffix(F.col("new_name")))))


def exact_names(files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Destinations in full: numbers start again from the first stem, and skip names given before or found on disk.

    taken: dir and name of what is there. A folder is one group, as its names depend on each other."""
    columns = "dir string, new_name string, order long, destination string"
    rows = files.select("dir", "new_name", F.col("order").cast("long").alias("order"))
    if taken is not None:
        rows = rows.unionByName(taken.select("dir", F.col("name").alias("new_name"), F.lit(None).cast("long").alias("order")))

    def deal(folder: pd.DataFrame) -> pd.DataFrame:
        there = folder["order"].isna()
        used, last = set(folder.loc[there, "new_name"]), {}
        out = folder[~there].sort_values("order")
        given = []
        for name in out["new_name"]:
            dot = name.rfind(".")
            stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
            found, n = name, last.get(name, 1)
            while found in used:
                n += 1
                found = f"{stem} ({n}){ext}"
            last[name] = n
            used.add(found)
            given.append(found)
        return out.assign(destination=given)

    return rows.groupBy("dir").applyInPandas(deal, columns)


def in_component_order(frame: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows by path components, so that a/b comes before a-b."""
    return frame.orderBy(F.split(path_col, "/"))


def stale_directories(present: DataFrame, expected: DataFrame) -> DataFrame:
    """Directories (path) that are neither expected nor above an expected one, deepest first."""
    above = expected.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("path")).distinct()
    return present.join(above, "path", "left_anti").withColumn("depth", F.size(F.split("path", "/")))


def resolved(spark_paths: DataFrame, source_col: str, target_col: str, unquote: bool = False) -> DataFrame:
    """target resolved against the folder of source, as a part name; null where it leaves the package."""

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath
        from urllib.parse import unquote as decode

        def one(source: str, target: str) -> str | None:
            target = decode(target) if unquote else target
            path = target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(source), target)
            path = posixpath.normpath(path)
            return None if path == ".." or path.startswith("../") else path

        for b in batches:
            yield b.assign(resolved=[one(s, t) for s, t in zip(b[source_col], b[target_col])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark_paths.schema) + ", resolved string"
    return spark_paths.mapInPandas(resolve, schema)
