"""Corpus filters, file facts and the mapping of files to projects.  All narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import dictionaries as D
from ..functions import paths as P
from ..functions.literals import each

MAX_DEPTH = 3


def ignore_filter(files: DataFrame, rules: P.IgnoreRules | None = None) -> DataFrame:
    """Drop files that an ignore pattern or the hidden-name rule hits on their own path."""
    return files.where(~(rules or P.IgnoreRules()).hit(F.col("path")))


def hidden_filter(files: DataFrame) -> DataFrame:
    return files.where(~P.file_name(F.col("path")).startswith("."))


def max_size_filter(files: DataFrame, max_bytes: int | None = D.MAX_FILE_BYTES) -> DataFrame:
    """Drop oversized files and files of unknown size; ``None`` keeps all."""
    return files if max_bytes is None else files.where(F.col("length") <= max_bytes)


def dropped_by_size(files: DataFrame, max_bytes: int = D.MAX_FILE_BYTES) -> DataFrame:
    """What ``max_size_filter`` leaves out, per root: files, and their bytes where known."""
    left = F.coalesce(F.col("length") > max_bytes, F.lit(True))
    return files.where(left).groupBy("root").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def kept_files(files: DataFrame, rules: P.IgnoreRules | None = None, max_depth: int = MAX_DEPTH,
               max_bytes: int | None = None) -> DataFrame:
    """Files that count, with ``name`` and the ``projects`` they belong to.  A file without any
    project lies below an ignored directory and is left out.  ``max_bytes`` limits the size of a
    file; there is no limit by default."""
    rules = rules or P.IgnoreRules()
    return (ignore_filter(max_size_filter(files, max_bytes), rules)
            .withColumn("name", P.file_name(F.col("path")))
            .withColumn("projects", P.owning_projects(F.col("path"), rules, max_depth))
            .where(F.size("projects") > 0))


def file_facts(kept: DataFrame, max_content: int | None = None) -> DataFrame:
    """Add ext, language, is_key_file, important, analyzed and the size or access error.

    ``analyzed`` marks the files whose text takes part in framework detection: important ones
    that are neither media nor larger than ``max_content`` (no limit by default).
    """
    name, path = F.col("name"), F.col("path")
    oversized, present = over(max_content), F.col("content").isNotNull()
    return (kept
            .withColumns({"ext": P.extension(name), "language": P.language(name),
                          "is_key_file": P.is_key_file(name, path)})
            .withColumn("important", P.is_important(name, F.col("is_key_file")))
            .withColumn("_text", F.col("important") & ~P.is_media(name))
            .withColumns({"analyzed": F.col("_text") & ~oversized & present,
                          "error": F.when(F.col("_text") & oversized, F.lit("File too large for analysis"))
                                    .when(F.col("_text") & ~present, F.lit("No read access"))})
            .drop("_text"))


def important_files(facts: DataFrame) -> DataFrame:
    return facts.where("important")


def media_skip(files: DataFrame) -> DataFrame:
    return files.where(~P.is_media(P.file_name(F.col("path"))))


def over(max_content: int | None) -> Column:
    return F.lit(False) if max_content is None else F.coalesce(F.col("length") > max_content, F.lit(False))


def content_cap(files: DataFrame, max_content: int | None = D.MAX_CONTENT_BYTES) -> DataFrame:
    """Keep every row; text above the cap becomes null and the row gets an error."""
    return (files.withColumn("error", F.when(over(max_content), F.lit("File too large for analysis")))
            .withColumn("content", F.when(~over(max_content), F.col("content"))))


def code_files_for_endpoints(files: DataFrame) -> DataFrame:
    return files.where(P.ends_with_any(F.col("path"), D.ENDPOINT_SUFFIXES))


def code_files_for_calls(files: DataFrame) -> DataFrame:
    return files.where(P.ends_with_any(F.col("path"), D.CALL_SUFFIXES))


def assign_projects(kept: DataFrame) -> DataFrame:
    """One row per file and project.  Whether a directory is a project follows from its path
    alone, so there is no join against a list of directories."""
    return kept.withColumn("project", each("projects")).drop("projects")


def project_dirs(kept: DataFrame) -> DataFrame:
    """The projects: every eligible directory with at least one kept file."""
    return kept.select("root", each("projects").alias("project")).distinct()


def directory_listing(kept: DataFrame, max_depth: int = 4) -> DataFrame:
    """Tree entries of every project: sub-directories first, then by lower-cased name.

    ``level`` counts from 0, ``is_last`` marks the last entry of its directory, ``cut`` a
    directory whose own entries lie below the depth limit.  The order columns are
    (is_file, lower_name, name).  No window over a directory: the last entry is an aggregate,
    marked by a union, so a directory with very many entries is not one task's work.
    """
    parts = F.split("path", "/")
    below = F.col("base")
    entries = (
        kept.select("root", "path", each("projects").alias("project"))
        .withColumn("base", F.size(F.split("project", "/")))
        .withColumn("depth", F.explode(F.sequence(below + 1, F.least(F.size(parts), below + max_depth + 1))))
        .select("root", "project",
                P.prefix(parts, F.col("depth") - 1).alias("parent"),
                F.get(parts, F.col("depth") - 1).alias("name"),
                (F.col("depth") == F.size(parts)).alias("is_file"),
                (F.col("depth") - below - 1).alias("level"))
        .distinct()
        .withColumn("lower_name", F.lower("name"))
        .withColumn("cut", ~F.col("is_file") & (F.col("level") == max_depth)))
    directory = ["root", "project", "parent"]
    entry = ["is_file", "lower_name", "name", "level", "cut"]
    last = (entries.groupBy(*directory).agg(F.max(F.struct(*entry)).alias("e"))
            .select(*directory, "e.*", F.lit(True).alias("is_last")))
    return (entries.withColumn("is_last", F.lit(False)).unionByName(last)
            .groupBy(*directory, *entry).agg(F.bool_or("is_last").alias("is_last")))
