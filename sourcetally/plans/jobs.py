"""Composite jobs: scan, detection, summary and report tables, and the whole run.

A job returns tables.  Results that several tables read (features, tally, service map) are
written to the shared scratch folder while the job is called, so the texts are read exactly
once per run and a lost executor costs the step, not the run; ``analyse`` removes them when its
results are written.  With ``keep=False`` nothing is written and every table is a lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import IgnoreRules
from ..operators import corpus, features as ft, projects as pj, services as sv, summary as sm
from ..session import run_scope, stored
from ..sources.patterns import Patterns, default_patterns
from ..sources.sinks import write_results


class Scan:
    """What detection and the reports build on.  The classified projects are planned when first asked for."""

    def __init__(self, features: DataFrame, tally: DataFrame, patterns: Patterns, projects: DataFrame | None = None):
        self.features, self.tally, self.patterns, self._projects = features, tally, patterns, projects

    @cached_property
    def projects(self) -> DataFrame:
        if self._projects is not None:
            return self._projects
        return pj.classify_services(pj.classify(pj.project_wide(self.tally, self.patterns)))

    @property
    def framework_scores(self) -> DataFrame:
        return pj.scores(self.tally, "framework")


def scan_projects(files: DataFrame, patterns: Patterns | None = None, rules: IgnoreRules | None = None,
                  max_depth: int = corpus.MAX_DEPTH, engine: str = "indexed", keep: bool = True,
                  max_bytes: int | None = None, max_content: int | None = None) -> Scan:
    """Features, scores and classified projects of a files table.  ``keep`` stores the features
    and the tally; without it everything stays one lazy plan.  Sizes have no limit unless
    ``max_bytes`` (files) or ``max_content`` (texts in detection) set one."""
    patterns = patterns or default_patterns()
    features = ft.file_features(files, patterns, rules, max_depth, engine, max_bytes, max_content)
    features = stored(features, "features") if keep else features
    tally = pj.project_tally(features, patterns)
    tally = stored(tally, "tally") if keep else tally
    return Scan(features, tally, patterns)


def summary_tables(scan: Scan, keep: bool = True) -> dict[str, DataFrame]:
    """One tall table of all distributions with shares and the place of each key (``no``), what of it is
    shown, totals and the listing.  With ``keep`` the distributions and the ranges are stored; without
    it nothing is written, and as every dimension on its own would search the texts again, those of
    the projects come from one pass over the tally and those of the files from one over the paths."""
    projects = scan.projects
    if keep:
        parts = [
            sm.summary_types(projects), sm.summary_languages(projects), sm.summary_confidence(projects),
            sm.summary_frameworks(scan.framework_scores),
            sm.summary_key_files(pj.project_key_files(scan.features)),
            sm.summary_extensions(pj.extension_histogram(scan.features)),
        ]
    else:
        counted = pj.classify(pj.project_wide(scan.tally, scan.patterns, sm.counting_frameworks()))
        parts = [sm.summary_projects(counted), sm.summary_files(scan.features)]
    tall = parts[0]
    for part in parts[1:]:
        tall = tall.unionByName(part)
    dist = stored(tall, "summary") if keep else tall
    dist = sm.ranked(dist, keep)
    share = (lambda d: sm.with_share(d, projects)) if keep else (lambda d: sm.with_share_of_types(d, parts[0]))
    shown = F.coalesce(*[F.when(F.col("dimension") == d, F.col("no") <= k) for d, k in sm.TOP.items()], F.lit(True))
    return {
        "summary": share(dist),
        "summary_shown": share(dist.where(shown)),
        "totals": sm.summary_totals(projects),
        "project_index": sm.project_index(projects, keep),
    }


class Detection:
    """Services, their endpoints and calls, and the service graph.  Each table is made, and with
    ``keep`` stored, when it is first asked for."""

    def __init__(self, scan: Scan, drop_empty_pattern: bool = False, keep: bool = True):
        self.scan, self.drop_empty_pattern = scan, drop_empty_pattern
        self._keep = stored if keep else lambda df, _: df

    @cached_property
    def services(self) -> DataFrame:
        return self._keep(self.scan.projects, "projects")

    @cached_property
    def endpoints(self) -> DataFrame:
        return self._keep(sv.dedup_endpoints(self.scan.features), "endpoints")

    @cached_property
    def calls(self) -> DataFrame:
        return self._keep(sv.dedup_calls(self.scan.features), "calls")

    @cached_property
    def service_map(self) -> DataFrame:
        return self._keep(sv.build_service_map(self.services, self.endpoints, self.drop_empty_pattern),
                          "service_map")

    @cached_property
    def resolved(self) -> DataFrame:
        return sv.resolve_calls(sv.of_services(self.calls, self.services), self.service_map, self._keep)

    @cached_property
    def relationships(self) -> DataFrame:
        return self._keep(sv.service_relationships(self.calls, self.services, self.resolved), "relationships")


def detect_microservices(scan: Scan, drop_empty_pattern: bool = False, keep: bool = True) -> Detection:
    return Detection(scan, drop_empty_pattern, keep)


def project_report_tables(scan: Scan, max_tree_depth: int = 4, kept: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables behind the report of each project."""
    features = scan.features
    return {
        "overview": scan.projects.drop("framework", "communication"),
        "scores": sm.scores_with_confidence(scan.framework_scores),
        "top_frameworks": sm.topk_scores(scan.framework_scores, 5),
        "indicators": pj.scores(scan.tally, "microservice"),
        "top_indicators": sm.topk_scores(pj.scores(scan.tally, "microservice"), 5),
        "key_files": pj.project_key_files(features),
        "imports": sm.first_imports(pj.project_imports(features)),
        "extensions": sm.topk_extensions(pj.extension_histogram(features)),
        "errors": sm.first_errors(pj.project_errors(features)),
        "listing": corpus.directory_listing(features if kept is None else kept, max_tree_depth),
    }


def service_report_tables(scan: Scan, detection: Detection, keep: bool = True) -> dict[str, DataFrame]:
    """Tables behind the report of the service architecture; listings carry their order as ``no``."""
    d = detection
    chosen = d.services.where("is_microservice").select(*pj.PROJECT)
    return sm.listed({
        "services": sv.service_table(d.services, d.endpoints, d.calls),
        "relationships": d.relationships,
        "diagram_edges": sv.diagram_edges(d.relationships),
        "service_indicators": pj.scores(scan.tally, "microservice").join(chosen, pj.PROJECT, "left_semi"),
        "endpoints": sv.of_services(d.endpoints, d.services).drop("first"),
        "call_targets": sv.call_targets(d.calls, d.services, d.relationships),
    }, keep)


def run_analysis(files: DataFrame, patterns: Patterns | None = None, rules: IgnoreRules | None = None,
                 max_depth: int = corpus.MAX_DEPTH, engine: str = "indexed",
                 detect: bool = True, max_bytes: int | None = None,
                 max_content: int | None = None, keep: bool = True) -> dict[str, DataFrame]:
    """Everything: scan, detection (before the summary, so that the summary counts services),
    summary and report tables."""
    scan = scan_projects(files, patterns, rules, max_depth, engine, keep, max_bytes, max_content)
    tables: dict[str, DataFrame] = {}
    if detect:
        detection = detect_microservices(scan, keep=keep)
        scan = Scan(scan.features, scan.tally, scan.patterns, detection.services)
        tables.update({f"service_{k}" if not k.startswith("service") else k: v
                       for k, v in service_report_tables(scan, detection, keep).items()})
    tables.update({f"project_{k}": v for k, v in project_report_tables(scan).items()})
    tables.update(summary_tables(scan, keep))
    tables["stats"] = sm.multi_root_stats(scan.projects, scan.framework_scores)
    return tables


def analyse(files: DataFrame, out: str, fmt: str = "parquet", **options) -> dict[str, str]:
    """``run_analysis`` as a run of its own: its tables are written below ``out`` and the intermediate ones
    removed, also after an error; those of other runs stay."""
    with run_scope(files.sparkSession):
        return write_results(run_analysis(files, **options), out, fmt)


def write_query(query: Callable[[SparkSession, str], DataFrame], spark: SparkSession, source: str, out: str, fmt: str = "parquet") -> str:
    """A single query (``spark``, folder of its tables) as a run of its own, written to ``out``."""
    with run_scope(spark):
        query(spark, source).write.format(fmt).save(out)
    return out
