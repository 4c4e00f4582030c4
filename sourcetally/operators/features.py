"""One narrow pass over the texts: everything later steps need, with the text itself dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import dictionaries as D
from ..functions import paths as P, text
from ..functions.literals import EMPTY, each, sql_array, sql_string, string_array
from ..sources.patterns import Patterns, default_patterns
from .corpus import MAX_DEPTH, file_facts, kept_files
from .matching import content_matches


DEPENDENCIES = "array<struct<package:string,grp:int,pos:int,version:string>>"


def _when(condition: Column, value: Column, kind: str = "array<string>") -> Column:
    return F.when(condition, value).otherwise(F.array().cast(kind))


def file_features(files: DataFrame, patterns: Patterns | None = None,
                  rules: P.IgnoreRules | None = None, max_depth: int = MAX_DEPTH,
                  engine: str = "indexed", max_bytes: int | None = None,
                  max_content: int | None = None) -> DataFrame:
    """Features of every kept file.  ``max_bytes`` and ``max_content`` limit the size of files and
    of texts that take part in detection; nothing is limited by default.

    Columns: root, path, name, ext, language, length, is_key_file, important, analyzed,
    projects, has_main, imports, dependencies, file_matches, content_matches, import_matches,
    path_matches, dependency_matches, endpoints, calls, error.  Unused ones are pruned with their cost.
    """
    patterns = patterns or default_patterns()
    facts = file_facts(kept_files(files, rules, max_depth, max_bytes), max_content)
    content, name, path = F.col("content"), F.col("name"), F.col("path")
    analyzed = F.col("analyzed")
    python = analyzed & name.endswith(".py")
    manifest_file = analyzed & (name == "package.json")
    listed = patterns.literals("import", "framework")
    packages = patterns.literals("dependency", "framework")
    staged = (facts
              .withColumns({
                  "content_matches": content_matches(content, patterns.literals("content"), engine),
                  "imports": _when(python, text.imports(content)),
                  "_manifest": F.when(manifest_file, text.package_manifest(content))})
              .withColumn("dependencies", _when(manifest_file, text.dependencies("_manifest"), DEPENDENCIES)))
    return staged.select(
        "root", "path", "name", "ext", "language", "length", "is_key_file", "important", "analyzed",
        "projects", "content_matches", "imports", "dependencies",
        (python & F.coalesce(text.has_main(content), F.lit(False))).alias("has_main"),
        F.coalesce("error", F.when(manifest_file, text.manifest_error(content, F.col("_manifest")))).alias("error"),
        text.pattern_matches(path, patterns.literals("file", "framework")).alias("file_matches"),
        text.literal_matches(path, patterns.literals("file", "microservice")).alias("path_matches"),
        text.matched_modules(F.col("imports"), listed).alias("import_matches"),
        F.array_intersect(F.expr("transform(dependencies, d -> d.package)"),
                          string_array(packages)).alias("dependency_matches"),
        F.when(P.ends_with_any(path, D.ENDPOINT_SUFFIXES), text.endpoints("content")).alias("endpoints"),
        F.when(P.ends_with_any(path, D.CALL_SUFFIXES), text.service_calls("content")).alias("calls"))


def _names(matches: str, patterns: Patterns, family: str, kind: str, once: bool = False) -> str:
    """SQL: dictionary names behind matched patterns: one per pattern, or ``once`` per name."""
    owners: dict[str, list[str]] = {}
    for r in patterns.rows:
        if r[0] == family and r[2] == kind:
            owners.setdefault(r[3], []).append(r[1])
    if not owners:
        return EMPTY
    table = "map(" + ", ".join(f"{sql_string(p)}, {sql_array(names)}" for p, names in owners.items()) + ")"
    names = f"flatten(array_compact(transform({matches}, p -> try_element_at({table}, p))))"
    return f"array_distinct({names})" if once else names


def file_hits(patterns: Patterns) -> Column:
    """Array of struct(family, name, kind) over a feature row: every hit that scores.

    A file name scores once per framework; a text scores once per pattern; every path pattern
    of a microservice indicator scores.
    """
    def tagged(family, kind, matches, once=False, only="true"):
        return (f"transform(if({only}, {_names(matches, patterns, family, kind, once)}, {EMPTY}), n -> "
                f"struct({sql_string(family)} AS family, n AS name, {sql_string(kind)} AS kind))")

    return F.expr("concat(" + ", ".join([
        tagged("framework", "file", "file_matches", once=True),
        tagged("framework", "content", "content_matches", only="analyzed"),
        tagged("framework", "import", "import_matches"),
        tagged("framework", "dependency", "dependency_matches"),
        tagged("microservice", "file", "path_matches"),
        tagged("microservice", "content", "content_matches"),
        tagged("communication", "content", "content_matches")]) + ")")


def hits(features: DataFrame, patterns: Patterns | None = None) -> DataFrame:
    """One row per scoring hit: root, path, projects, family, name, kind, weight10."""
    patterns = patterns or default_patterns()
    weights = F.broadcast(patterns.entries(features.sparkSession).drop("ord"))   # a few hundred rows at most
    return (features.select("root", "path", "projects", F.explode(file_hits(patterns)).alias("h"))
            .select("root", "path", "projects", "h.*")
            .join(weights, ["family", "name"]))


def pattern_hits(features: DataFrame, matches: str, kind: str, family: str,
                 patterns: Patterns | None = None) -> DataFrame:
    """Explain a match column: root, path, name of the dictionary entry, pattern, weight10."""
    patterns = patterns or default_patterns()
    table = F.broadcast(patterns.table(features.sparkSession)
                        .where((F.col("kind") == kind) & (F.col("family") == family))
                        .select(F.col("name").alias("entry"), "pattern", "weight10"))
    return (features.select("root", "path", each(matches).alias("pattern"))
            .join(table, "pattern").select("root", "path", "entry", "pattern", "weight10"))
