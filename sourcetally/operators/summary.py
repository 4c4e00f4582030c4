"""Distributions, shares, rankings and totals over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring
from ..session import stored
from .projects import PROJECT

FRAMEWORK_BAR10 = 10      # a framework counts for a project above a score of 1.0 (fixed value)


def _count(rows: DataFrame, dimension: str, key: str, by: list[str]) -> DataFrame:
    return (rows.groupBy(*by, F.col(key).alias("key")).agg(F.count("*").alias("n"))
            .select(*by, F.lit(dimension).alias("dimension"), "key", "n"))


def summary_types(projects: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    return _count(projects, "project_type", "project_type", by)


def summary_languages(projects: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    return _count(projects, "language", "primary_language", by)


def summary_confidence(projects: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    return _count(projects, "confidence", "confidence_text", by)


def summary_frameworks(framework_scores: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    """Projects per framework, counting scores above 1.0."""
    return _count(framework_scores.where(F.col("score10") > FRAMEWORK_BAR10), "framework", "name", by)


def summary_key_files(key_files: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    return _count(key_files, "key_file", "name", by)


def summary_extensions(histogram: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    return (histogram.groupBy(*by, F.col("ext").alias("key")).agg(F.sum("n").alias("n"))
            .select(*by, F.lit("extension").alias("dimension"), "key", "n"))


def counting_frameworks() -> Column:
    """Aggregate of a project's tally: ``frameworks`` scored above 1.0, no more than the dictionary has."""
    counts = (F.col("family") == "framework") & (F.col("score10") > FRAMEWORK_BAR10)
    return F.collect_list(F.when(counts, F.col("entry"))).alias("frameworks")


def _entry(dimension: str, key: Column) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), key.alias("key"))


def summary_projects(projects: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    """Types, languages, confidence and frameworks of projects with their ``frameworks``, in one pass."""
    single = F.array(_entry("project_type", F.col("project_type")), _entry("language", F.col("primary_language")),
                     _entry("confidence", F.col("confidence_text")))
    entries = F.concat(single, F.transform("frameworks", lambda name: _entry("framework", name)))
    return (projects.select(*by, F.explode(entries).alias("e")).groupBy(*by, "e.dimension", "e.key")
            .agg(F.count("*").alias("n")))


def summary_files(features: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    """Key files and extensions in one pass: a file counts once for each of its projects."""
    entries = F.array_compact(F.array(F.when(F.col("is_key_file"), _entry("key_file", F.col("name"))),
                                      F.when(F.col("ext") != "", _entry("extension", F.col("ext")))))
    return (features.where(F.size("projects") > 0).select(*by, F.size("projects").alias("levels"), F.explode(entries).alias("e"))
            .groupBy(*by, "e.dimension", "e.key").agg(F.sum("levels").alias("n")))


def summary_totals(projects: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    """Projects, files (once per project that owns them) and microservices."""
    return projects.groupBy(*by).agg(
        F.count("*").alias("total_projects"), F.sum("file_count").alias("total_files"),
        F.count_if("is_microservice").alias("microservices_count")
    ).withColumn("has_microservices", F.col("microservices_count") > 0)


def with_share(dist: DataFrame, projects: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    """Percentage of all projects (frameworks may add up to more than 100)."""
    totals = projects.groupBy(*by).agg(F.count("*").alias("total"))
    shared = dist.join(totals, by) if by else dist.withColumn(
        "total", projects.agg(F.count("*").alias("total")).scalar())
    return shared.withColumn("pct", F.col("n") / F.col("total") * 100).drop("total")


def with_share_of_types(dist: DataFrame, types: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    """``with_share`` where the number of projects comes from a distribution: each has one type."""
    totals = types.groupBy(*by).agg(F.sum(F.when(F.col("dimension") == "project_type", F.col("n"))).alias("total"))
    return dist.join(totals, by).withColumn("pct", F.col("n") / F.col("total") * 100).drop("total")


def _whole(dist: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Attach an aggregate of the distribution to each of its rows: an aggregate and a join,
    no window, since one distribution may have very many keys."""
    totals = dist.groupBy(*by, "dimension").agg(value.alias("whole"))
    return dist.join(totals, [*by, "dimension"])


def with_percent_of_sum(dist: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    return _whole(dist, F.sum("n"), by).withColumn(
        "pct_of_sum", F.col("n") / F.col("whole") * 100).drop("whole")


def scaled_to_max(dist: DataFrame, by: list[str] = ["root"]) -> DataFrame:
    return _whole(dist, F.max("n"), by).withColumn(
        "pct_of_max", F.col("n") / F.col("whole") * 100).drop("whole")


# rows shown per dimension of a summary (fixed values)
TOP = {"framework": 20, "key_file": 15, "extension": 20}


def topk(dist: DataFrame, k: int) -> DataFrame:
    """The k most frequent keys; the key breaks ties."""
    return dist.orderBy(F.desc("n"), "key").limit(k)


def topk_per(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First k rows per group, with ``rank``.  Spark limits each group before the shuffle, so
    a large group sends k rows per task."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col("rank") <= k)


def topk_extensions(histogram: DataFrame, k: int = 15) -> DataFrame:
    return topk_per(histogram, PROJECT, [F.desc("n"), F.asc("ext")], k)


def topk_scores(scores: DataFrame, k: int = 5) -> DataFrame:
    """Best k dictionary entries per project; dictionary order breaks ties."""
    return topk_per(scores.where(F.col("score10") > 0), PROJECT, [F.desc("score10"), F.asc("ord")], k)


PARTS = 64        # parts by hash of a project's or a group's rows, each of which keeps a few


def first_with_overflow(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """First k rows per project with the number of rows left out (``overflow``).

    The rows are read once.  A project, which may own every file, falls into PARTS parts by a hash of
    the row; each part counts itself and keeps its first k, and at most PARTS * k rows of a project
    meet.
    """
    parted = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    one = Window.partitionBy(*PROJECT, "part")
    kept = (parted.withColumns({"place": F.row_number().over(one.orderBy(*order)), "size": F.count("*").over(one)})
            .where(F.col("place") <= k).withColumn("size", F.when(F.col("place") == 1, F.col("size"))))
    whole = Window.partitionBy(*PROJECT)
    return (kept.withColumns({"rank": F.row_number().over(whole.orderBy(*order)), "total": F.sum("size").over(whole)})
            .where(F.col("rank") <= k).withColumn("overflow", F.greatest(F.col("total") - k, F.lit(0)))
            .drop("part", "place", "size", "total"))


def first_imports(imports: DataFrame, k: int = 30) -> DataFrame:
    return first_with_overflow(imports, ["import"], k)


def first_errors(errors: DataFrame, k: int = 20) -> DataFrame:
    return first_with_overflow(errors, ["file", "error"], k)


RANGES, DRAWN = 128, 32      # of a group in numbered() without writing: ranges, rows drawn for each


def _bounds(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """(by, bounds): at most RANGES values of the order columns that cut a group into ranges of like
    size.  They come from at most RANGES * DRAWN of its rows, those with the smallest hashes in each of
    PARTS parts, so a task sends no more than that; whole values are compared, so a common prefix of
    any length is no matter."""
    hashed = F.xxhash64(*order)
    parted = rows.select(*by, *order, F.pmod(hashed, F.lit(PARTS)).alias("part"))
    drawn = topk_per(parted, [*by, "part"], [hashed], RANGES * DRAWN // PARTS)
    values = drawn.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("values"))
    step = F.greatest(F.floor(F.size("values") / RANGES), F.lit(1)).cast("int")
    return values.select(*by, F.filter("values", lambda v, i: (i > 0) & (i % step == 0)).alias("bounds"))


def numbered(rows: DataFrame, order: list[str], keep: bool = True, by: list[str] = ["root"]) -> DataFrame:
    """Add ``no``: the place of a row in its group ``by`` in ascending order of the columns ``order``, from 1.

    The rows fall into ranges in that order; a row's number is its number inside its range plus
    the sizes of the ranges before it.  With ``keep`` the ranges are Spark's, of like size, and
    stored, so no task sees a whole group.  Without it nothing is written and the ranges of a group
    are cut at the quantiles of rows drawn from it.  Columns of ``by`` and ``order`` are not null.

    Without writing the rows are read for the cuts, for the sizes and for the numbers.  Each reader
    orders equal rows by a hash of all columns, so all need the same columns of one exchange, which
    Spark makes once and reuses: what is behind the rows runs once.
    """
    if keep:
        ranged = stored(rows.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), "numbered")
    else:
        columns = [f.name for f in rows.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        rows = rows.repartition(*columns).withColumn("_row", F.xxhash64(*columns))
        order = [*order, "_row"]
        ranged = rows.join(_bounds(rows, order, by), by).withColumn(
            "part", F.size(F.filter("bounds", lambda b: b <= F.struct(*order)))).drop("bounds")
    sizes = ranged.groupBy(*by, "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(      # rows: at most groups x ranges
        Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = ranged.withColumn("inside", F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order)))
    return (inside.join(before, [*by, "part"])
            .withColumn("no", F.col("inside") + F.coalesce("before", F.lit(0)))
            .drop("part", "inside", "size", "before", "_row"))


def project_index(projects: DataFrame, keep: bool = True) -> DataFrame:
    """Numbered listing by name within each root."""
    return numbered(projects.select("root", "name", "project", "project_type", "confidence", "confidence_text"), ["name", "project"], keep)


def multi_root_stats(projects: DataFrame, framework_scores: DataFrame) -> DataFrame:
    """Counts over all roots together, all project dimensions in one pass by grouping sets."""
    dims = ["project_type", "primary_language", "confidence_text"]
    labels = ["project_type", "language", "confidence"]
    chain = F
    for n, label in enumerate(labels):
        chain = chain.when(F.grouping(dims[n]) == 0, F.lit(label))
    grouped = (projects.select(*dims).groupingSets([[F.col(d)] for d in dims], *map(F.col, dims))
               .agg(chain.alias("dimension"), F.coalesce(*dims).alias("key"), F.count("*").alias("n"))
               .select("dimension", "key", "n"))
    return grouped.unionByName(summary_frameworks(framework_scores, by=[]))


# ---- listing orders: of the report tables, by column ------------------------------------------

ORDERS = {
    "services": ["name", "project"],
    "relationships": ["source", "target", "type"],
    "endpoints": ["project", "endpoint", "method", "file", "framework"],
    "call_targets": ["project", "url", "file"],
}


def listed(tables: dict[str, DataFrame], keep: bool = True) -> dict[str, DataFrame]:
    """Tables that have a listing order, with the place of each row as ``no``."""
    return {name: numbered(table, ORDERS[name], keep) if name in ORDERS else table for name, table in tables.items()}


def ranked(dist: DataFrame, keep: bool = True) -> DataFrame:
    """Distributions with ``no``, the place of a key in its dimension: confidence labels from high to
    low, other keys by frequency, then by name."""
    first = F.when(F.col("dimension") == "confidence", scoring.confidence_rank(F.col("key")).cast("long")).otherwise(-F.col("n"))
    return numbered(dist.withColumn("_first", first), ["_first", "key"], keep, ["root", "dimension"]).drop("_first")


def scores_with_confidence(scores: DataFrame) -> DataFrame:
    """Scores above zero with the label of the capped score and ``no``, the place in their project: the
    best first, then in dictionary order.  A project has no more rows than the dictionary has entries."""
    place = Window.partitionBy(*PROJECT).orderBy(F.desc("score10"), "ord")
    return scores.where(F.col("score10") > 0).withColumns({
        "confidence_text": scoring.confidence_level(scoring.capped_score(F.col("score10"), 3)), "no": F.row_number().over(place)})
