"""Roll-up of file features to projects, and their classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import dictionaries as D
from ..functions import scoring
from ..functions.literals import each, string_array
from ..sources.patterns import Patterns, default_patterns
from .features import file_hits

PROJECT = ["root", "project"]
LANGUAGES = list(D.LANGUAGES)


def project_name(project: Column) -> Column:
    return F.substring_index(project, "/", -1)


def ancestor(directory: Column, up: Column) -> Column:
    """The directory ``up`` levels above, itself for 0."""
    parts = F.split(directory, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - up), "/")


def project_tally(features: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    """Counts and scores of every project in long form, in one pass over the features.

    One row per (project, family, name) with ``score10``, and one row with null family per
    project with the file counts and flags.  Files of one directory belong to the same projects:
    they are added up first, and only the sums go to every ancestor.  Both aggregates combine
    before the shuffle, so the root, which owns every file, costs one row per task and key.
    """
    patterns = patterns or default_patterns()
    flags = {"has_main": F.col("has_main"),
             "has_setup": F.col("name").isin("setup.py", "pyproject.toml"),
             "has_package_json": F.col("name") == "package.json",
             "has_docker": F.col("name").isin("Dockerfile", "docker-compose.yml")}
    facts = F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("entry"),
                     F.col("language").alias("lang"), *[c.alias(f) for f, c in flags.items()])
    no_flags = [F.lit(None).cast("boolean").alias(f) for f in flags]
    scored = F.transform(file_hits(patterns), lambda h: F.struct(
        h["family"].alias("family"), h["name"].alias("entry"), F.lit(None).cast("string").alias("lang"),
        *no_flags))
    # The projects of a file are neighbouring ancestors: the deepest and their number say which, in a short key.
    deepest = [F.element_at("projects", -1).alias("deepest"), F.size("projects").alias("levels")]
    rows = (features.where(F.size("projects") > 0).select("root", *deepest, F.explode(F.concat(F.array(facts), scored)).alias("r"))
            .select("root", "deepest", "levels", "r.*"))
    directories = rows.groupBy("root", "deepest", "levels", "family", "entry").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("lang") == lang).alias(lang) for lang in LANGUAGES],
        *[F.bool_or(f).alias(f) for f in flags])
    above = F.explode(F.sequence(F.lit(0), F.col("levels") - 1))
    grouped = (directories.withColumn("up", above).withColumn("project", ancestor(F.col("deepest"), F.col("up"))).groupBy(*PROJECT, "family", "entry").agg(
        *[F.sum(c).alias(c) for c in ["n", *LANGUAGES]], *[F.bool_or(f).alias(f) for f in flags]))
    names = F.broadcast(patterns.entries(features.sparkSession).withColumnRenamed("name", "entry"))
    return (grouped.join(names, ["family", "entry"], "left")
            .withColumn("score10", F.col("n") * F.col("weight10")))


def scores(tally: DataFrame, family: str) -> DataFrame:
    """Scores of one dictionary family: root, project, name, ord, score10, score."""
    return (tally.where(F.col("family") == family)
            .select(*PROJECT, F.col("entry").alias("name"), "ord", "score10",
                    scoring.from_tenths(F.col("score10")).alias("score")))


_RANKS = 1 << 16         # more than a dictionary may have entries


def _best(family: str) -> Column:
    """Highest score and, among its holders, the first in the dictionary, as one number: a
    number keeps the aggregate in a hash table, a struct would make it sort."""
    return F.max(F.when(F.col("family") == family, F.col("score10") * _RANKS + (_RANKS - 1 - F.col("ord"))))


def _unpack(best: str, names: list[str]) -> Column:
    ord_ = F.lit(_RANKS - 1) - F.col(best) % _RANKS
    return F.when(F.col(best).isNotNull(), F.struct(
        F.shiftright(F.col(best), 16).alias("score10"),
        F.element_at(string_array(names), (ord_ + 1).cast("int")).alias("name")))


def project_wide(tally: DataFrame, patterns: Patterns | None = None, *more: Column) -> DataFrame:
    """One row per project: counts, flags, best framework, microservice score, communication, and
    what else ``more`` aggregates of its tally."""
    patterns = patterns or default_patterns()
    base = F.col("family").isNull()
    flags = ["has_main", "has_setup", "has_package_json", "has_docker"]
    wide = tally.groupBy(*PROJECT).agg(
        F.max(F.when(base, F.col("n"))).alias("file_count"),
        *[F.max(F.when(base, F.col(lang))).alias(f"{lang}_files") for lang in LANGUAGES],
        *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags],
        _best("framework").alias("_framework"),
        F.coalesce(F.sum(F.when(F.col("family") == "microservice", F.col("score10"))), F.lit(0)).alias("total10"),
        _best("communication").alias("_communication"), *more)
    return (wide.withColumns({"framework": _unpack("_framework", patterns.names("framework")),
                              "communication": _unpack("_communication", patterns.names("communication")),
                              "name": project_name(F.col("project"))})
            .drop("_framework", "_communication"))


def primary_language() -> Column:
    """Language with the most files; list order breaks ties, unknown without any."""
    counts = [F.col(f"{lang}_files") for lang in LANGUAGES]
    most, chain = F.greatest(*counts), F.when(F.greatest(*counts) == 0, F.lit("unknown"))
    for lang, count in zip(LANGUAGES, counts):
        chain = chain.when(count == most, F.lit(lang))
    return chain


def classify(wide: DataFrame) -> DataFrame:
    """Add primary_language, project_type, confidence, confidence_text and the evidence."""
    tops = F.col("framework.score10") > 10
    with_main = F.col("has_main") & (F.col("primary_language") == "python")
    html_and_js = (F.col("html_files") > 0) & ((F.col("javascript_files") > 0) | (F.col("typescript_files") > 0))
    # evidence in tie order: type and confidence (fixed values)
    evidence = [
        (F.col("has_setup"), F.lit("python_package"), F.lit(0.9)),
        (F.col("has_package_json"), F.lit("node_package"), F.lit(0.85)),
        (F.col("has_docker"), F.lit("microservice"), F.lit(0.7)),
        (html_and_js, F.lit("web_application"), F.lit(0.75)),
        (tops, F.col("framework.name"), scoring.capped_score(F.col("framework.score10"), 3)),
        (with_main, F.lit("python_script"), F.lit(0.8)),
    ]
    best = F.array_max(F.array_compact(F.array(*[
        F.when(met, F.struct(x.alias("confidence"), F.lit(-n).alias("o"), kind.alias("type")))
        for n, (met, kind, x) in enumerate(evidence)])))
    language = F.col("primary_language")
    fallback = (F.when(language == "python", F.struct(F.lit("python_module").alias("type"), F.lit(0.4).alias("x")))
                .when(language.isin("javascript", "typescript"),
                      F.struct(F.lit("js_module").alias("type"), F.lit(0.4).alias("x")))
                .when(language == "java", F.struct(F.lit("java_module").alias("type"), F.lit(0.4).alias("x")))
                .otherwise(F.struct(F.lit("unknown").alias("type"), F.lit(0.2).alias("x"))))
    return (wide
            .withColumn("primary_language", primary_language())
            .withColumn("_best", best).withColumn("_fallback", fallback)
            .withColumn("project_type", F.coalesce("_best.type", "_fallback.type"))
            .withColumn("confidence", F.coalesce("_best.confidence", "_fallback.x"))
            .withColumn("confidence_text", scoring.confidence_level(F.col("confidence")))
            .withColumn("confidence_factors", F.struct(
                F.col("has_setup").alias("has_setup_py"), F.col("has_package_json"), F.col("has_docker"),
                html_and_js.alias("has_html_and_js"),
                F.when(tops, F.col("framework.name")).alias("framework_detected"),
                F.when(tops, F.col("framework.score10")).alias("framework_score10"),
                with_main.alias("has_main_function")))
            .drop("_best", "_fallback"))


def classify_services(wide: DataFrame) -> DataFrame:
    """Add is_microservice, microservice_probability and primary_communication."""
    bar = F.when(F.col("file_count") < 5, F.lit(30)).otherwise(F.lit(20))
    return (wide
            .withColumn("is_microservice", F.col("total10") > bar)
            .withColumn("microservice_probability", scoring.capped_score(F.col("total10"), 5))
            .withColumn("primary_communication", F.coalesce("communication.name", F.lit("unknown"))))


# ---- child tables: long form, one row per item, so that no project is collected -------------

def by_project(features: DataFrame, *columns) -> DataFrame:
    return features.select("root", each("projects").alias("project"), *columns)


def project_counts(features: DataFrame) -> DataFrame:
    return by_project(features, "language").groupBy(*PROJECT).agg(
        F.count("*").alias("file_count"),
        *[F.count_if(F.col("language") == lang).alias(f"{lang}_files") for lang in LANGUAGES])


def extension_histogram(features: DataFrame) -> DataFrame:
    return (by_project(features.where("ext <> ''"), "ext")
            .groupBy(*PROJECT, "ext").agg(F.count("*").alias("n")))


def project_has_main(features: DataFrame) -> DataFrame:
    return by_project(features, "has_main").groupBy(*PROJECT).agg(F.bool_or("has_main").alias("has_main"))


def project_imports(features: DataFrame) -> DataFrame:
    """Distinct imports of every project."""
    imported = features.select("root", "projects", each("imports").alias("import"))
    return by_project(imported, "import").distinct()


def inside_project(path: Column, project: Column) -> Column:
    return F.substring(path, F.length(project) + 2, F.length(path))


def project_key_files(features: DataFrame) -> DataFrame:
    """Key files with their path inside the project."""
    return by_project(features.where("is_key_file"), "path", "name").select(
        *PROJECT, inside_project(F.col("path"), F.col("project")).alias("key_file"), "name")


def project_errors(features: DataFrame) -> DataFrame:
    return by_project(features.where("error IS NOT NULL"), "path", "error").select(
        *PROJECT, inside_project(F.col("path"), F.col("project")).alias("file"), "error")


def project_dependencies(features: DataFrame) -> DataFrame:
    return features.select("root", "path", each("dependencies").alias("d")).select(
        "root", "path", "d.package", "d.version")
