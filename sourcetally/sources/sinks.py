"""Result sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def _by_root(table: DataFrame) -> bool:
    return "root" in table.columns and len(table.columns) > 1


def write_results(tables: dict[str, DataFrame], out: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each result table below ``out``, partitioned by root where it has one (so results
    of several roots can be pruned and replaced one by one); returns the paths.  Nothing is there
    yet: a table that exists is an error, see ``replace_roots``."""
    written = {}
    for name, table in tables.items():
        writer = table.write.mode("errorifexists").format(fmt)
        if _by_root(table):
            writer = writer.partitionBy("root")
        written[name] = f"{out.rstrip('/')}/{name}"
        writer.save(written[name])
    return written


def replace_roots(tables: dict[str, DataFrame], out: str, roots: Iterable[str], fmt: str = "parquet") -> dict[str, str]:
    """Put ``tables``, the results of a run over ``roots`` alone, in the place of what ``out`` has of these
    roots, or add them; the files of all other roots stay as they are.

    Each table is staged and its partitions are moved in when it is written whole (Spark's dynamic
    partition overwrite), so a run that fails before has changed nothing of it.  A root that has no
    rows in a table any more loses those it had.  Tables that are not by root are over all roots
    together: they can't be renewed from some, so they are not written; returned are the paths of
    those that are.
    """
    roots = list(dict.fromkeys(roots))
    written = {}
    for name, table in tables.items():
        if not _by_root(table):
            continue
        if not table.where(~F.col("root").isin(roots)).isEmpty():
            raise ValueError(f"{name} holds rows of other roots than {roots}")
        path = written[name] = f"{out.rstrip('/')}/{name}"
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt).partitionBy("root").save(path)
        _drop_empty(table, path, roots)
    return written


def _drop_empty(table: DataFrame, path: str, roots: list[str]) -> None:
    """Remove the partitions of roots without rows in ``table``: a few names, one each."""
    spark = table.sparkSession
    left = set(roots) - {r.root for r in table.select("root").distinct().collect()}      # at most as many as roots were given
    jvm = spark.sparkContext._jvm
    for root in sorted(left):
        named = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("root", root)
        place = jvm.org.apache.hadoop.fs.Path(path, named)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
