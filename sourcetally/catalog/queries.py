"""Every registered query with its SQL counterpart.

Queries run over the whole of the given tables: most over the source tree laid over
``documents`` (see ``corpus_sql``), some over the texts and URLs of the tables themselves.
Results are flat rows, scores in whole tenths, ties broken by explicit order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import dictionaries as D
from ..functions import paths as P, scoring, text, urls
from ..functions.literals import each
from ..operators import corpus, features as ft, matching, projects as pj, services as sv, summary as sm
from ..plans import jobs
from ..session import spread, stored_folder
from ..sources import files as src
from ..sources.patterns import Patterns, default_patterns, family as pattern_family
from ..sources.sinks import replace_roots, write_results
from . import oracle
from .corpus_sql import CODE_FILES
from .oracle import lit, q, q_roots

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def register(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn
    return register


# ---- inputs -------------------------------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files table over ``documents``."""
    documents = spread(table(spark, sf, "documents"), "doc_id")
    return spark.sql(CODE_FILES, documents=documents).select(
        "root", "path", F.octet_length("content").cast("bigint").alias("length"), "content")


def kept(spark, sf):
    return corpus.kept_files(code_files(spark, sf))


def facts(spark, sf):
    return corpus.file_facts(kept(spark, sf))


def features(spark, sf):
    return ft.file_features(code_files(spark, sf))


def scan(spark, sf, keep=False) -> jobs.Scan:
    """``keep`` where a query reads the scan more than once: the texts are still read once."""
    return jobs.scan_projects(code_files(spark, sf), keep=keep)


def detection(spark, sf) -> jobs.Detection:
    return jobs.detect_microservices(scan(spark, sf, keep=True))


# ---- corpus: sources, filters, facts ------------------------------------------------------------

@query(q("SELECT root, path, length FROM files"))
def code_file_table(spark, sf):
    return code_files(spark, sf).select("root", "path", "length")


@query(q("SELECT DISTINCT parts[2] AS root FROM files WHERE len(parts) > 2"))
def expand_roots(spark, sf):
    return src.root_names(code_files(spark, sf))


@query(q(f"SELECT path FROM files WHERE NOT {oracle.ignored()}"))
def ignore_filter(spark, sf):
    return corpus.ignore_filter(code_files(spark, sf)).select("path")


@query(q(f"SELECT path FROM files WHERE NOT {oracle.ignored(D.HOME_IGNORE)}"))
def ignore_filter_home(spark, sf):
    return corpus.ignore_filter(code_files(spark, sf), P.IgnoreRules(D.HOME_IGNORE)).select("path")


@query(q(f"SELECT path FROM files WHERE NOT {oracle.ignored(D.DESKTOP_IGNORE)}"))
def ignore_filter_desktop(spark, sf):
    return corpus.ignore_filter(code_files(spark, sf), P.IgnoreRules(D.DESKTOP_IGNORE)).select("path")


@query(q(f"""SELECT path FROM files WHERE NOT (list_contains({oracle.strings(D.DEFAULT_IGNORE)}, name)
             OR {oracle.globs('name', D.DEFAULT_IGNORE)} OR name LIKE '.%')"""))
def ignore_filter_segment(spark, sf):
    return corpus.ignore_filter(code_files(spark, sf), P.IgnoreRules(match="segment")).select("path")


@query(q("SELECT path FROM files WHERE name NOT LIKE '.%'"))
def hidden_filter(spark, sf):
    return corpus.hidden_filter(code_files(spark, sf)).select("path")


@query("SELECT doc_id, strlen(text)::BIGINT AS length FROM documents WHERE strlen(text) <= 4000")
def max_size_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("length"))
    return corpus.max_size_filter(docs, 4000)


@query(q(f"SELECT path FROM files WHERE NOT {oracle.ends('name', D.MEDIA_SUFFIXES)}"))
def media_skip(spark, sf):
    return corpus.media_skip(code_files(spark, sf)).select("path")


@query(q("""SELECT path, CASE WHEN length <= 4000 THEN length(content) END::BIGINT AS n_chars,
            CASE WHEN length > 4000 THEN 'File too large for analysis' END AS error FROM files"""))
def content_cap(spark, sf):
    return corpus.content_cap(code_files(spark, sf), 4000).select(
        "path", F.length("content").cast("bigint").alias("n_chars"), "error")


@query(q("SELECT path FROM facts WHERE important"))
def important_files(spark, sf):
    return corpus.important_files(facts(spark, sf)).select("path")


@query(q(f"SELECT path FROM kept WHERE {oracle.ends('path', D.ENDPOINT_SUFFIXES)}"))
def code_files_for_endpoints(spark, sf):
    return corpus.code_files_for_endpoints(kept(spark, sf)).select("path")


@query(q(f"SELECT path FROM kept WHERE {oracle.ends('path', D.CALL_SUFFIXES)}"))
def code_files_for_calls(spark, sf):
    return corpus.code_files_for_calls(kept(spark, sf)).select("path")


@query(q("SELECT root, path, name, ext, language, length, key_file AS is_key_file, important, analyzed FROM facts"))
def file_facts(spark, sf):
    return facts(spark, sf).select("root", "path", "name", "ext", "language", "length", "is_key_file",
                                   "important", "analyzed")


@query(q("SELECT path, name FROM facts WHERE key_file"))
def key_files(spark, sf):
    return facts(spark, sf).where("is_key_file").select("path", "name")


@query(q("SELECT root, path, error FROM errors"))
def file_errors(spark, sf):
    return features(spark, sf).where("error IS NOT NULL").select("root", "path", "error")


@query(q("SELECT path, project FROM owner"))
def ancestor_projects(spark, sf):
    return corpus.assign_projects(kept(spark, sf)).select("path", "project")


@query(q("SELECT DISTINCT root, project FROM member"))
def project_dirs(spark, sf):
    return corpus.project_dirs(kept(spark, sf))


_TREE = """
, entry AS (
  SELECT DISTINCT project, array_to_string(parts[1:d - 1], '/') AS parent, parts[d] AS name, d = len(parts) AS is_file,
         d - len(string_split(project, '/')) - 1 AS level
  FROM member, range(1, 40) t(d) WHERE d <= len(parts) AND d > len(string_split(project, '/'))
    AND d <= len(string_split(project, '/')) + 5)
SELECT project, parent, name, is_file, level::INT AS level, NOT is_file AND level = 4 AS cut,
       row_number() OVER (PARTITION BY project, parent ORDER BY is_file, lower(name), name)
         = count(*) OVER (PARTITION BY project, parent) AS is_last
FROM entry"""


@query(q(_TREE))
def directory_listing(spark, sf):
    return corpus.directory_listing(kept(spark, sf)).select(
        "project", "parent", "name", "is_file", "level", "cut", "is_last")


# ---- features -----------------------------------------------------------------------------------

@query(q("SELECT path FROM has_main"))
def main_files(spark, sf):
    return features(spark, sf).where("has_main").select("path")


@query(q("SELECT root, path, import FROM imports"))
def imports(spark, sf):
    return features(spark, sf).select("root", "path", each("imports").alias("import"))


@query(q("SELECT path, package, version FROM dependencies"))
def dependencies(spark, sf):
    return pj.project_dependencies(features(spark, sf)).select("path", "package", "version")


PACKAGES = {"react": ["react", "react-dom"], "jest": ["jest"], "vue": ["vue"]}


@query(q("""SELECT d.path, e.entry AS name, d.package AS pattern, e.weight10 FROM dependencies d
  JOIN (VALUES ('react', 'react'), ('react', 'react-dom'), ('jest', 'jest'), ('vue', 'vue')) v(entry, package)
    ON v.package = d.package JOIN entries e ON e.family = 'framework' AND e.entry = v.entry"""))
def dependency_hits(spark, sf):
    patterns = default_patterns(PACKAGES)
    return ft.pattern_hits(ft.file_features(code_files(spark, sf), patterns), "dependency_matches",
                           "dependency", "framework", patterns).select(
        "path", F.col("entry").alias("name"), "pattern", "weight10")


@query(q("SELECT path, entry AS name, weight10 FROM hits WHERE family = 'framework' AND kind = 'file'"))
def file_pattern_hits(spark, sf):
    return ft.hits(features(spark, sf)).where("family = 'framework' AND kind = 'file'").select(
        "path", "name", "weight10")


@query(q("SELECT path, entry AS name, pattern, weight10 FROM hits WHERE family = 'framework' AND kind = 'content'"))
def content_pattern_hits(spark, sf):
    return ft.pattern_hits(features(spark, sf).where("analyzed"), "content_matches", "content", "framework").select(
        "path", F.col("entry").alias("name"), "pattern", "weight10")


@query(q("SELECT path, entry AS name, pattern, weight10 FROM hits WHERE family = 'framework' AND kind = 'import'"))
def import_hits(spark, sf):
    return ft.pattern_hits(features(spark, sf), "import_matches", "import", "framework").select(
        "path", F.col("entry").alias("name"), "pattern", "weight10")


@query(q("SELECT path, entry AS name, pattern, weight10 FROM hits WHERE family = 'microservice' AND kind = 'file'"))
def microservice_file_hits(spark, sf):
    return ft.pattern_hits(features(spark, sf), "path_matches", "file", "microservice").select(
        "path", F.col("entry").alias("name"), "pattern", "weight10")


@query(q("SELECT path, entry AS name, pattern, weight10 FROM hits WHERE family = 'microservice' AND kind = 'content'"))
def microservice_content_hits(spark, sf):
    return ft.pattern_hits(features(spark, sf), "content_matches", "content", "microservice").select(
        "path", F.col("entry").alias("name"), "pattern", "weight10")


@query(q("SELECT path, entry AS name, pattern, weight10 FROM hits WHERE family = 'communication'"))
def communication_hits(spark, sf):
    return ft.pattern_hits(features(spark, sf), "content_matches", "content", "communication").select(
        "path", F.col("entry").alias("name"), "pattern", "weight10")


def _text_hits(spark, sf, name, column, keys, family, patterns=None):
    """Pattern hits in the texts of a table, counted by key and dictionary entry."""
    patterns = patterns or default_patterns()
    owners = F.broadcast(patterns.table(spark).where(
        (F.col("family") == family) & (F.col("kind") == "content")).select("name", "pattern"))
    texts = spread(table(spark, sf, name).select(*keys, column))
    found = texts.select(*keys, F.explode(matching.content_matches(
        F.col(column), patterns.literals("content", family))).alias("pattern"))
    return (found.groupBy(*keys, "pattern").count().join(owners, "pattern")
            .groupBy(*keys, "name").agg(F.sum("count").alias("n")))


def _text_hits_sql(name, column, keys, family, patterns=None):
    values = ", ".join(f"({lit(r[1])}, {lit(r[3])})" for r in (patterns or default_patterns()).rows
                       if r[0] == family and r[2] == "content")
    return (f"SELECT {', '.join(keys)}, name, count(*) AS n FROM {name} "
            f"JOIN (VALUES {values}) d(name, pattern) ON contains({column}, d.pattern) GROUP BY ALL")


@query(_text_hits_sql("documents", "text", ["source", "lang"], "framework"))
def document_pattern_hits(spark, sf):
    return _text_hits(spark, sf, "documents", "text", ["source", "lang"], "framework")


@query(_text_hits_sql("pages", "html", ["page_id"], "framework"))
def page_pattern_hits(spark, sf):
    return _text_hits(spark, sf, "pages", "html", ["page_id"], "framework")


@query(_text_hits_sql("conversations", "text", ["role"], "communication"))
def conversation_pattern_hits(spark, sf):
    return _text_hits(spark, sf, "conversations", "text", ["role"], "communication")


#: A dictionary of a user's own, with words that the conversations hold.
OWN_PATTERNS = Patterns(tuple(pattern_family("speech", {
    "article": {"content": ["the ", "The "], "weight": 0.3}, "question": {"content": ["?", "what", "how"], "weight": 1},
    "ending": {"content": ["tion", "ing"], "weight": 0.7}})))


@query(_text_hits_sql("conversations", "text", ["role"], "speech", OWN_PATTERNS))
def conversation_own_patterns(spark, sf):
    return _text_hits(spark, sf, "conversations", "text", ["role"], "speech", OWN_PATTERNS)


def _members_sql(depth):
    bad = oracle.bad_dir
    return q(f"""SELECT path, array_to_string(parts[1:k], '/') AS project FROM files, range(1, {depth + 2}) t(k)
      WHERE NOT {oracle.ignored()} AND k < len(parts) AND (k = 1 OR NOT {bad('parts[k]')})
        AND len(list_filter(parts[k + 1:len(parts) - 1], lambda d: {bad('d')})) = 0""")


def _members(spark, sf, depth):
    return corpus.assign_projects(corpus.kept_files(code_files(spark, sf), max_depth=depth)).select("path", "project")


@query(_members_sql(1))
def ancestor_projects_depth1(spark, sf):
    return _members(spark, sf, 1)


@query(_members_sql(5))
def ancestor_projects_depth5(spark, sf):
    return _members(spark, sf, 5)


@query(q("SELECT root, pattern, service FROM service_map WHERE pattern <> ''"))
def service_map_without_empty(spark, sf):
    found = jobs.detect_microservices(scan(spark, sf, keep=True), drop_empty_pattern=True)
    return found.service_map.select("root", "pattern", "service")


# ---- projects -----------------------------------------------------------------------------------

_LANG_COLUMNS = [f"{lang}_files" for lang in D.LANGUAGES]


@query(q(f"SELECT root, project, file_count, {', '.join(_LANG_COLUMNS)} FROM counts"))
def project_counts(spark, sf):
    return pj.project_counts(facts(spark, sf))


@query(q("SELECT root, project, primary_language FROM wide"))
def primary_language(spark, sf):
    return pj.project_counts(facts(spark, sf)).select("root", "project", pj.primary_language().alias("primary_language"))


@query(q("SELECT root, project, ext, n FROM histogram"))
def extension_histogram(spark, sf):
    return pj.extension_histogram(facts(spark, sf))


@query(q("SELECT root, project, has_main FROM counts"))
def project_has_main(spark, sf):
    return pj.project_has_main(features(spark, sf))


@query(q("SELECT root, project, import FROM project_imports"))
def project_imports(spark, sf):
    return pj.project_imports(features(spark, sf))


@query(q("SELECT root, project, substr(path, length(project) + 2) AS key_file, name FROM member WHERE key_file"))
def project_key_files(spark, sf):
    return pj.project_key_files(facts(spark, sf))


@query(q("""SELECT e.root, o.project, substr(e.path, length(o.project) + 2) AS file, error
            FROM errors e JOIN owner o USING (path)"""))
def project_errors(spark, sf):
    return pj.project_errors(features(spark, sf))


def _scores_sql(family):
    return q(f"""SELECT root, project, entry AS name, score10, score10 / 10.0::DOUBLE AS score
                 FROM scores WHERE family = {lit(family)}""")


def _scores(spark, sf, family):
    return pj.scores(scan(spark, sf).tally, family).select("root", "project", "name", "score10", "score")


@query(_scores_sql("framework"))
def framework_scores(spark, sf):
    return _scores(spark, sf, "framework")


@query(_scores_sql("microservice"))
def microservice_scores(spark, sf):
    return _scores(spark, sf, "microservice")


@query(_scores_sql("communication"))
def communication(spark, sf):
    return _scores(spark, sf, "communication")


@query(q("SELECT project, entry AS framework, score10 FROM best WHERE family = 'framework' AND score10 > 10"))
def top_framework(spark, sf):
    return scan(spark, sf).projects.where("framework.score10 > 10").select(
        "project", F.col("framework.name").alias("framework"), F.col("framework.score10").alias("score10"))


@query(q(f"""SELECT project, entry AS name, least(score10 / 30.0::DOUBLE, 0.95::DOUBLE) AS capped,
  {oracle._CONFIDENCE('least(score10 / 30.0::DOUBLE, 0.95::DOUBLE)')} AS confidence_text
  FROM scores WHERE family = 'framework' AND score10 > 0"""))
def confidence_level(spark, sf):
    return sm.scores_with_confidence(pj.scores(scan(spark, sf).tally, "framework")).select(
        "project", "name", scoring.capped_score(F.col("score10"), 3).alias("capped"), "confidence_text")


@query(q("SELECT root, project, project_type, confidence, confidence_text, primary_language FROM projects"))
def project_type(spark, sf):
    return scan(spark, sf).projects.select("root", "project", "project_type", "confidence", "confidence_text",
                                           "primary_language")


@query(q("""SELECT project, has_setup AS has_setup_py, has_package_json, has_docker,
  html_files > 0 AND (javascript_files > 0 OR typescript_files > 0) AS has_html_and_js,
  CASE WHEN framework_score10 > 10 THEN framework END AS framework_detected,
  CASE WHEN framework_score10 > 10 THEN framework_score10 END AS framework_score10,
  has_main AND primary_language = 'python' AS has_main_function FROM projects"""))
def confidence_factors(spark, sf):
    return scan(spark, sf).projects.select("project", "confidence_factors.*")


@query(q(f"""SELECT root, project, pname AS name, file_count, {', '.join(_LANG_COLUMNS)}, has_main, primary_language,
  project_type, confidence, confidence_text, is_microservice, microservice_probability, primary_communication
  FROM projects"""))
def projects(spark, sf):
    return scan(spark, sf).projects.select(
        "root", "project", "name", "file_count", *_LANG_COLUMNS, "has_main", "primary_language", "project_type",
        "confidence", "confidence_text", "is_microservice", "microservice_probability", "primary_communication")


# ---- endpoints, calls, services -----------------------------------------------------------------

@query(q("SELECT root, project, endpoint, method, file, framework, type FROM endpoints"))
def endpoints(spark, sf):
    return sv.dedup_endpoints(features(spark, sf)).drop("first")


@query(q("SELECT type, framework, count(*) AS n FROM endpoints GROUP BY ALL"))
def endpoint_types(spark, sf):
    return sv.dedup_endpoints(features(spark, sf)).groupBy("type", "framework").agg(F.count("*").alias("n"))


@query(q("SELECT root, project, url, file, language FROM calls"))
def service_calls(spark, sf):
    return sv.dedup_calls(features(spark, sf)).drop("first")


@query(f"SELECT page_id, {oracle.service_url('url')} AS is_service FROM pages")
def service_url_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.is_service_url(F.col("url")).alias("is_service"))


_HREFS = """WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS url FROM pages)"""


def _hrefs(spark, sf):
    pages = spread(table(spark, sf, "pages").select("html"))
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("url")).distinct()


@query(f"{_HREFS} SELECT url, {oracle.service_url('url')} AS is_service FROM h")
def service_url_filter_links(spark, sf):
    return _hrefs(spark, sf).select("url", urls.is_service_url(F.col("url")).alias("is_service"))


@query(f"{_HREFS}, k AS (SELECT url, {oracle.url_keys('url')} AS keys FROM h) "
       "SELECT url, unnest(keys) AS key, unnest(range(len(keys)))::INT AS rank FROM k")
def url_keys(spark, sf):
    return _hrefs(spark, sf).select("url", F.posexplode(urls.url_keys(F.col("url"))).alias("rank", "key"))


@query(f"{_HREFS} SELECT url, CASE WHEN url LIKE '/%' OR url LIKE 'http%' THEN url ELSE '/' || url END AS normal, "
       "regexp_replace(url, '[<{][^>}]+[>}]', '*', 'g') AS wild FROM h")
def normalise_endpoint(spark, sf):
    return _hrefs(spark, sf).select("url", urls.normalise_endpoint(F.col("url")).alias("normal"),
                                    urls.wildcard_params(F.col("url")).alias("wild"))


@query(q("""SELECT root, project, total10, is_microservice, microservice_probability, primary_communication
            FROM projects"""))
def services(spark, sf):
    return scan(spark, sf).projects.select("root", "project", "total10", "is_microservice",
                                           "microservice_probability", "primary_communication")


@query(q("SELECT root, pattern, service FROM service_map"))
def service_map(spark, sf):
    return detection(spark, sf).service_map.select("root", "pattern", "service")


@query(q("SELECT root, url, target FROM resolved"))
def resolve_calls(spark, sf):
    return detection(spark, sf).resolved


@query(q("SELECT root, source, target, type, url, file FROM relationships"))
def relationships(spark, sf):
    return detection(spark, sf).relationships


@query(q("""SELECT DISTINCT c.primary_communication, c.url,
  """ + oracle.relationship_type("c.primary_communication", "c.url") + " AS type FROM service_calls c"))
def relationship_types(spark, sf):
    d = detection(spark, sf)
    made = sv.of_services(d.calls, d.services, "primary_communication").select("primary_communication", "url").distinct()
    return made.withColumn("type", urls.relationship_type(F.col("primary_communication"), F.col("url")))


@query(q("""SELECT root, regexp_replace(source, '[^a-zA-Z0-9]', '_', 'g') AS source,
  CASE type WHEN 'Event-based' THEN '-.->|event|' WHEN 'gRPC' THEN '===>|gRPC|' WHEN 'GraphQL' THEN '--o|GraphQL|'
       ELSE '-->' END AS arrow, regexp_replace(target, '[^a-zA-Z0-9]', '_', 'g') AS target FROM relationships"""))
def diagram_edges(spark, sf):
    return sv.diagram_edges(detection(spark, sf).relationships)


@query(q("""SELECT c.root, c.project, c.service, c.url, coalesce(r.target, 'Unknown') AS target, c.file
  FROM service_calls c LEFT JOIN (SELECT root, source, url, min(target) AS target FROM relationships GROUP BY ALL) r
    ON r.root = c.root AND r.source = c.service AND r.url = c.url"""))
def call_targets(spark, sf):
    d = detection(spark, sf)
    return sv.call_targets(d.calls, d.services, d.relationships)


@query(q("""SELECT s.root, s.project, s.pname AS name, s.project_type, s.primary_language, s.microservice_probability,
  s.primary_communication, (SELECT count(*) FROM endpoints e WHERE e.project = s.project) AS endpoint_count,
  (SELECT count(*) FROM calls c WHERE c.project = s.project) AS call_count FROM services s"""))
def service_table(spark, sf):
    base = scan(spark, sf, keep=True)
    return sv.service_table(base.projects, sv.dedup_endpoints(base.features), sv.dedup_calls(base.features))


# ---- summaries ----------------------------------------------------------------------------------

def _dimension(name):
    return q(f"SELECT root, dimension, key, n FROM dist WHERE dimension = {lit(name)}")


@query(_dimension("project_type"))
def summary_types(spark, sf):
    return sm.summary_types(scan(spark, sf).projects)


@query(_dimension("language"))
def summary_languages(spark, sf):
    return sm.summary_languages(scan(spark, sf).projects)


@query(_dimension("confidence"))
def summary_confidence(spark, sf):
    return sm.summary_confidence(scan(spark, sf).projects)


@query(_dimension("framework"))
def summary_frameworks(spark, sf):
    return sm.summary_frameworks(scan(spark, sf).framework_scores)


@query(_dimension("key_file"))
def summary_key_files(spark, sf):
    return sm.summary_key_files(pj.project_key_files(facts(spark, sf)))


@query(_dimension("extension"))
def summary_extensions(spark, sf):
    return sm.summary_extensions(pj.extension_histogram(facts(spark, sf)))


@query(q("""SELECT root, count(*) AS total_projects, sum(file_count)::BIGINT AS total_files,
  count(*) FILTER (is_microservice) AS microservices_count, bool_or(is_microservice) AS has_microservices
  FROM projects GROUP BY root"""))
def summary_totals(spark, sf):
    return sm.summary_totals(scan(spark, sf).projects)


@query(q("""SELECT d.root, dimension, key, n, n / t.total * 100 AS pct FROM dist d
  JOIN (SELECT root, count(*) AS total FROM projects GROUP BY root) t ON t.root = d.root
  WHERE dimension = 'framework'"""))
def distribution_share(spark, sf):
    base = scan(spark, sf, keep=True)
    return sm.with_share(sm.summary_frameworks(base.framework_scores), base.projects)


@query(q("""SELECT root, dimension, key, n, n / sum(n) OVER () * 100 AS pct_of_sum FROM dist
            WHERE dimension = 'extension'"""))
def percent_of_sum(spark, sf):
    return sm.with_percent_of_sum(sm.summary_extensions(pj.extension_histogram(facts(spark, sf))))


@query(q("""SELECT root, dimension, key, n, n / max(n) OVER () * 100 AS pct_of_max FROM dist
            WHERE dimension = 'extension'"""))
def scaled_to_max(spark, sf):
    return sm.scaled_to_max(sm.summary_extensions(pj.extension_histogram(facts(spark, sf))))


@query(q("SELECT key, n FROM dist WHERE dimension = 'framework' ORDER BY n DESC, key LIMIT 20"))
def topk_frameworks(spark, sf):
    return sm.topk(sm.summary_frameworks(scan(spark, sf).framework_scores), 20).select("key", "n")


@query(q("SELECT key, n FROM dist WHERE dimension = 'key_file' ORDER BY n DESC, key LIMIT 15"))
def topk_key_files(spark, sf):
    return sm.topk(sm.summary_key_files(pj.project_key_files(facts(spark, sf))), 15).select("key", "n")


@query(q("SELECT key, n FROM dist WHERE dimension = 'extension' ORDER BY n DESC, key LIMIT 20"))
def topk_extensions(spark, sf):
    return sm.topk(sm.summary_extensions(pj.extension_histogram(facts(spark, sf))), 20).select("key", "n")


@query(q("""SELECT project, ext, n, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, ext) AS rank FROM histogram) WHERE rank <= 15"""))
def topk_extensions_per_project(spark, sf):
    return sm.topk_extensions(pj.extension_histogram(facts(spark, sf))).select("project", "ext", "n", "rank")


def _top_scores_sql(family):
    return q(f"""SELECT project, entry AS name, score10, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY score10 DESC, ord) AS rank
      FROM scores WHERE family = {lit(family)}) WHERE rank <= 5""")


@query(_top_scores_sql("framework"))
def topk_frameworks_per_project(spark, sf):
    return sm.topk_scores(pj.scores(scan(spark, sf).tally, "framework")).select("project", "name", "score10", "rank")


@query(_top_scores_sql("microservice"))
def topk_indicators_per_project(spark, sf):
    return sm.topk_scores(pj.scores(scan(spark, sf).tally, "microservice")).select("project", "name", "score10", "rank")


@query(q("""SELECT project, import, rank::INT AS rank, greatest(total - 3, 0) AS overflow FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY import) AS rank,
         count(*) OVER (PARTITION BY project) AS total FROM project_imports) WHERE rank <= 3"""))
def first_imports_overflow(spark, sf):
    return sm.first_imports(pj.project_imports(features(spark, sf)), 3).select("project", "import", "rank", "overflow")


@query(q("""SELECT project, file, error, rank::INT AS rank, greatest(total - 20, 0) AS overflow FROM (
  SELECT o.project, substr(e.path, length(o.project) + 2) AS file, error,
         row_number() OVER (PARTITION BY o.project ORDER BY substr(e.path, length(o.project) + 2), error) AS rank,
         count(*) OVER (PARTITION BY o.project) AS total
  FROM errors e JOIN owner o USING (path)) WHERE rank <= 20"""))
def first_errors_overflow(spark, sf):
    return sm.first_errors(pj.project_errors(features(spark, sf))).select("project", "file", "error", "rank", "overflow")


@query(q("""SELECT root, name, project, project_type, row_number() OVER (PARTITION BY root ORDER BY name, project) AS no
            FROM (SELECT *, pname AS name FROM projects)"""))
def project_index(spark, sf):
    return sm.project_index(scan(spark, sf).projects).select("root", "name", "project", "project_type", "no")


@query(q("SELECT dimension, key, sum(n)::BIGINT AS n FROM dist "
         "WHERE dimension IN ('project_type', 'language', 'confidence', 'framework') GROUP BY ALL"))
def multi_root_stats(spark, sf):
    base = scan(spark, sf, keep=True)
    return sm.multi_root_stats(base.projects, base.framework_scores)


# ---- many roots: every top directory of the tree is a root of its own ----------------------------

def roots_scan(spark, sf, keep=False) -> jobs.Scan:
    return jobs.scan_projects(src.expand_roots(code_files(spark, sf)), keep=keep)


@query(q_roots("SELECT root, project, project_type, confidence, primary_language, is_microservice FROM projects"))
def roots_projects(spark, sf):
    return roots_scan(spark, sf).projects.select("root", "project", "project_type", "confidence", "primary_language",
                                                 "is_microservice")


@query(q_roots("""SELECT root, count(*) AS total_projects, sum(file_count)::BIGINT AS total_files,
  count(*) FILTER (is_microservice) AS microservices_count, bool_or(is_microservice) AS has_microservices
  FROM projects GROUP BY root"""))
def roots_totals(spark, sf):
    return sm.summary_totals(roots_scan(spark, sf).projects)


@query(q_roots("SELECT dimension, key, sum(n)::BIGINT AS n FROM dist "
               "WHERE dimension IN ('project_type', 'language', 'confidence', 'framework') GROUP BY ALL"))
def roots_stats(spark, sf):
    base = roots_scan(spark, sf, keep=True)
    return sm.multi_root_stats(base.projects, base.framework_scores)


@query(q_roots("""SELECT d.root, dimension, key, n, n / t.total * 100 AS pct FROM dist d
  JOIN (SELECT root, count(*) AS total FROM projects GROUP BY root) t ON t.root = d.root
  WHERE dimension = 'language'"""))
def roots_share(spark, sf):
    base = roots_scan(spark, sf, keep=True)
    return sm.with_share(sm.summary_languages(base.projects), base.projects)


@query(q_roots("""SELECT root, name, project, row_number() OVER (PARTITION BY root ORDER BY name, project) AS no
                  FROM (SELECT *, pname AS name FROM projects)"""))
def roots_index(spark, sf):
    return sm.project_index(roots_scan(spark, sf).projects).select("root", "name", "project", "no")


@query(q_roots("SELECT root, source, target, type, url, file FROM relationships"))
def roots_relationships(spark, sf):
    return jobs.detect_microservices(roots_scan(spark, sf, keep=True)).relationships


# ---- containment on real URLs: which link targets occur inside which page addresses ---------------

@query("""WITH h AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '^/', '') AS pattern FROM pages),
  u AS (SELECT DISTINCT url FROM pages)
  SELECT url, pattern FROM u JOIN h ON contains(lower(url), pattern)""")
def link_spellings(spark, sf):
    addresses = sv.distinct_urls(table(spark, sf, "pages").select(F.lit("web").alias("root"), "url"))
    links = _hrefs(spark, sf).select(F.lit("web").alias("root"), F.regexp_replace("url", "^/", "").alias("pattern")).distinct()
    return (sv.contained_spellings(addresses, links).join(addresses, ["root", "uid"]).select("url", "pattern").distinct())


# ---- jobs as a whole, sources and sink --------------------------------------------------------------

@query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN chr(65533) || text || chr(65534) || '01' ELSE text END AS text,
  (strlen(text) + CASE WHEN doc_id % 3 < 2 THEN 8 ELSE 0 END)::BIGINT AS length FROM documents""")
def decode_text(spark, sf):
    """Raw bytes: of every third document with a stray byte, of two in three with the characters that stand for such bytes."""
    raw = F.concat(F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("\ufffd"), "text", F.lit("\ufffe01"))).otherwise(F.col("text")).cast("binary"),
                   F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return table(spark, sf, "documents").select("doc_id", text.decode_text(raw).alias("text")).withColumn(
        "length", F.octet_length("text").cast("bigint"))


def _laid_out(files: DataFrame, parent: str) -> str:
    """The files of one root as raw files below ``parent``, written by tasks; returns the root's directory."""
    def write(batches):
        from pyarrow import fs
        place, base = fs.FileSystem.from_uri(parent)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                place.create_dir(f"{base}/{path}".rpartition("/")[0])
                with place.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write(content.encode())
            yield batch.select(["path"])

    files.select("path", "content").mapInArrow(write, "path string").count()
    return f"{parent}/corpus"


@query(q("SELECT root, path, length, md5(content) AS digest FROM files"))
def read_tree(spark, sf):
    """The source tree as raw files, with `__init__.py`, `.env` and the like, read back."""
    directory = _laid_out(code_files(spark, sf), f"{stored_folder(spark)}/raw-{uuid.uuid4().hex}")
    return src.read_tree(spark, directory).select("root", "path", "length", F.md5("content").alias("digest"))


@query(q("SELECT CASE WHEN contains(path, '/api/') THEN 'one' ELSE 'two' END AS root, path, length FROM files"))
def union_roots(spark, sf):
    files = code_files(spark, sf)
    inside = F.contains(F.col("path"), F.lit("/api/"))
    return src.union_roots(files.where(inside).withColumn("root", F.lit("one")),
                           files.where(~inside).withColumn("root", F.lit("two"))).select("root", "path", "length")


@query(q("SELECT root, project, project_type, confidence, file_count, is_microservice FROM projects"))
def written_results(spark, sf):
    """Projects written by the sink, partitioned by root, and read back."""
    out = f"{stored_folder(spark)}/results-{uuid.uuid4().hex}"
    paths = write_results({"projects": scan(spark, sf).projects.drop("framework", "communication", "confidence_factors")}, out)
    return spark.read.parquet(paths["projects"]).select("root", "project", "project_type", "confidence", "file_count", "is_microservice")


def _three_roots(files: DataFrame) -> DataFrame:
    """Three roots by directory."""
    has = lambda part: F.contains(F.col("path"), F.lit(part))
    return files.withColumn("root", F.when(has("/api/"), F.lit("one")).when(has("/web/"), F.lit("two")).otherwise(F.lit("three")))


@query(f"""SELECT CASE WHEN contains(path, '/api/') THEN 'one' WHEN contains(path, '/web/') THEN 'two' ELSE 'three' END AS root, project, count(*) AS n
  FROM (SELECT * FROM ({_members_sql(3)}) WHERE NOT contains(path, '/web/') OR contains(path, '/api/')
        UNION ALL SELECT * FROM ({_members_sql(1)}) WHERE contains(path, '/web/') AND NOT contains(path, '/api/')) GROUP BY ALL""")
def replaced_root(spark, sf):
    """Results of three roots, then a second run of one of them with another depth put in the place of its first."""
    out = f"{stored_folder(spark)}/results-{uuid.uuid4().hex}"
    files = _three_roots(code_files(spark, sf))
    sized = lambda files, depth: corpus.assign_projects(corpus.kept_files(files, max_depth=depth)).groupBy("root", "project").agg(F.count("*").alias("n"))
    write_results({"sizes": sized(files, 3)}, out)
    paths = replace_roots({"sizes": sized(files.where("root = 'two'"), 1)}, out, ["two"])
    return spark.read.parquet(paths["sizes"]).select("root", "project", "n")


@query(q("""SELECT 'score' AS section, project, entry AS item, score10 FROM scores WHERE family = 'framework' AND score10 > 0
  UNION ALL SELECT 'indicator', project, entry, score10 FROM scores WHERE family = 'microservice'
  UNION ALL SELECT 'import', project, import, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY project ORDER BY import) AS rank FROM project_imports) WHERE rank <= 30
  UNION ALL SELECT 'extension', project, ext, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, ext) AS rank FROM histogram) WHERE rank <= 15"""))
def project_report(spark, sf):
    """Four tables of the project report in one; ``project_report_lists`` has the others."""
    made = jobs.project_report_tables(scan(spark, sf, keep=True))
    part = lambda section, df, item, n: df.select(F.lit(section).alias("section"), "project", F.col(item).alias("item"), F.col(n).cast("bigint").alias("score10"))
    return (part("score", made["scores"], "name", "score10").unionByName(part("indicator", made["indicators"], "name", "score10"))
            .unionByName(part("import", made["imports"], "import", "rank")).unionByName(part("extension", made["extensions"], "ext", "rank")))


@query(q("SELECT d.root, dimension, key, n, n / t.total * 100 AS pct FROM (SELECT *, row_number() OVER ("
         "PARTITION BY root, dimension ORDER BY n DESC, key) AS place FROM dist) d "
         "JOIN (SELECT root, count(*) AS total FROM projects GROUP BY root) t ON t.root = d.root WHERE place <= CASE dimension "
         + " ".join(f"WHEN {lit(d)} THEN {k}" for d, k in sm.TOP.items()) + " ELSE 1000000 END"))
def summary_job(spark, sf):
    return jobs.summary_tables(scan(spark, sf, keep=True))["summary_shown"].select("root", "dimension", "key", "n", "pct")


@query(q("""SELECT 'relationship' AS section, source AS a, target AS b, type AS c,
    row_number() OVER (PARTITION BY root ORDER BY source, target, type) AS no FROM relationships
  UNION ALL SELECT 'service', pname, project, primary_communication, row_number() OVER (PARTITION BY root ORDER BY pname, project) FROM services"""))
def service_report(spark, sf):
    """Two listings of the service report, with their order; ``service_report_lists`` has the others."""
    base = scan(spark, sf, keep=True)
    made = jobs.service_report_tables(base, jobs.detect_microservices(base))
    part = lambda section, df, *columns: df.select(F.lit(section).alias("section"), *[F.col(c).alias(n) for c, n in zip(columns, "abc")], "no")
    return part("relationship", made["relationships"], "source", "target", "type").unionByName(
        part("service", made["services"], "name", "project", "primary_communication"))


@query(q("""SELECT root, count(*) AS total_projects, sum(file_count)::BIGINT AS total_files,
  count(*) FILTER (is_microservice) AS microservices_count, bool_or(is_microservice) AS has_microservices
  FROM projects GROUP BY root"""))
def analysis_totals(spark, sf):
    return jobs.run_analysis(code_files(spark, sf))["totals"]


@query(q("SELECT root, name, project, project_type, row_number() OVER (PARTITION BY root ORDER BY name, project) AS no "
         "FROM (SELECT *, pname AS name FROM projects)"))
def project_index_unwritten(spark, sf):
    return sm.project_index(scan(spark, sf).projects, keep=False).select("root", "name", "project", "project_type", "no")


# ---- every table of the jobs, with its order ---------------------------------------------------------

_LABELS = oracle.strings([label for _, label in D.CONFIDENCE_LEVELS] + [D.LOWEST_CONFIDENCE])
_PLACE = (f"row_number() OVER (PARTITION BY d.root, dimension ORDER BY CASE WHEN dimension = 'confidence' "
          f"THEN list_position({_LABELS}, key) ELSE -n END, key)")


@query(q(f"""SELECT d.root, dimension, key, n, n / t.total * 100 AS pct, {_PLACE} AS no FROM dist d
  JOIN (SELECT root, count(*) AS total FROM projects GROUP BY root) t ON t.root = d.root"""))
def summary_ranked(spark, sf):
    """The whole summary table: every key of every dimension with its share and its place."""
    return jobs.summary_tables(scan(spark, sf, keep=True))["summary"].select("root", "dimension", "key", "n", "pct", "no")


@query(q(f"SELECT d.root, dimension, key, n, {_PLACE} AS no FROM dist d"))
def summary_ranked_unwritten(spark, sf):
    """The same places from a run that writes nothing."""
    return jobs.summary_tables(scan(spark, sf), keep=False)["summary"].select("root", "dimension", "key", "n", "no")


def _sections(tables: dict[str, tuple[DataFrame, list]]) -> DataFrame:
    """Several tables as one: the columns of each as strings in a, b, c and a number."""
    made = None
    for section, (df, columns) in tables.items():
        *texts, number = [c if isinstance(c, Column) else F.col(c) for c in columns]
        part = df.select(F.lit(section).alias("section"), *[c.cast("string").alias(n) for c, n in zip(texts, "abc")], number.cast("bigint").alias("no"))
        made = part if made is None else made.unionByName(part)
    return made


_ENTRIES = _TREE[:_TREE.index("SELECT project, parent, name, is_file, level")]


@query(q(_ENTRIES + """
  SELECT 'score' AS section, project AS a, entry AS b, confidence AS c, row_number() OVER (PARTITION BY project ORDER BY score10 DESC, ord) AS no
    FROM (SELECT *, {0} AS confidence FROM scores) WHERE family = 'framework' AND score10 > 0
  UNION ALL SELECT CASE family WHEN 'framework' THEN 'top framework' ELSE 'top indicator' END, project, entry, score10::VARCHAR, place
    FROM (SELECT *, row_number() OVER (PARTITION BY project, family ORDER BY score10 DESC, ord) AS place FROM scores)
    WHERE family IN ('framework', 'microservice') AND place <= 5
  UNION ALL SELECT 'key file', project, substr(path, length(project) + 2), name, NULL FROM member WHERE key_file
  UNION ALL SELECT 'error', project, file, error, place FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file, error) AS place
    FROM (SELECT o.project, substr(e.path, length(o.project) + 2) AS file, error FROM errors e JOIN owner o USING (path))) WHERE place <= 20
  UNION ALL SELECT 'entry', project, parent, name, level FROM entry
  UNION ALL SELECT 'project', project, project_type, primary_language, file_count FROM projects""".format(
      oracle._CONFIDENCE("least(score10 / 30.0::DOUBLE, 0.95::DOUBLE)"))))
def project_report_lists(spark, sf):
    """The other tables of the project report: scores with labels, both tops, key files, errors, tree and overview."""
    base = scan(spark, sf, keep=True)
    made = jobs.project_report_tables(base)
    return _sections({
        "score": (made["scores"], ["project", "name", "confidence_text", "no"]),
        "top framework": (made["top_frameworks"], ["project", "name", "score10", "rank"]),
        "top indicator": (made["top_indicators"], ["project", "name", "score10", "rank"]),
        "key file": (made["key_files"], ["project", "key_file", "name", F.lit(None)]),
        "error": (made["errors"], ["project", "file", "error", "rank"]),
        "entry": (made["listing"], ["project", "parent", "name", "level"]),
        "project": (made["overview"], ["project", "project_type", "primary_language", "file_count"])})


@query(q("""SELECT 'endpoint' AS section, e.project AS a, e.endpoint AS b, e.method || ' ' || e.file AS c,
    row_number() OVER (PARTITION BY e.root ORDER BY e.project, e.endpoint, e.method, e.file, e.framework) AS no
    FROM endpoints e JOIN services s USING (project)
  UNION ALL SELECT 'call', c.project, c.url, coalesce(r.target, 'Unknown') || ' ' || c.file, row_number() OVER (PARTITION BY c.root ORDER BY c.project, c.url, c.file)
    FROM service_calls c LEFT JOIN (SELECT root, source, url, min(target) AS target FROM relationships GROUP BY ALL) r
      ON r.root = c.root AND r.source = c.service AND r.url = c.url
  UNION ALL SELECT 'indicator', c.project, entry, '', score10 FROM scores c JOIN services s USING (project) WHERE family = 'microservice'
  UNION ALL SELECT 'edge', regexp_replace(source, '[^a-zA-Z0-9]', '_', 'g'), regexp_replace(target, '[^a-zA-Z0-9]', '_', 'g'), '', NULL FROM relationships"""))
def service_report_lists(spark, sf):
    """The other tables of the service report: endpoints and call targets in their order, indicators, edges."""
    base = scan(spark, sf, keep=True)
    made = jobs.service_report_tables(base, jobs.detect_microservices(base))
    return _sections({
        "endpoint": (made["endpoints"], ["project", "endpoint", F.concat_ws(" ", "method", "file"), "no"]),
        "call": (made["call_targets"], ["project", "url", F.concat_ws(" ", "target", "file"), "no"]),
        "indicator": (made["service_indicators"], ["project", "name", F.lit(""), "score10"]),
        "edge": (made["diagram_edges"], ["source", "target", F.lit(""), F.lit(None)])})


_FIRST = lambda rows, keys, k: f"(SELECT least(count(*), {k}) AS n FROM {rows} GROUP BY {keys})"
_SIZES = {
    "services": "services", "service_relationships": "relationships", "service_diagram_edges": "relationships",
    "service_indicators": "scores JOIN services USING (project) WHERE family = 'microservice'",
    "service_endpoints": "endpoints JOIN services USING (project)", "service_call_targets": "service_calls",
    "project_overview": "projects", "project_scores": "scores WHERE family = 'framework'",
    "project_indicators": "scores WHERE family = 'microservice'", "project_key_files": "member WHERE key_file", "project_listing": "entry",
    "project_top_frameworks": ("scores WHERE family = 'framework'", "project", 5), "project_top_indicators": ("scores WHERE family = 'microservice'", "project", 5),
    "project_imports": ("project_imports", "project", 30), "project_extensions": ("histogram", "project", 15),
    "project_errors": ("errors JOIN owner USING (path)", "project", 20),
    "summary": "dist", "project_index": "projects", "totals": "(SELECT DISTINCT root FROM projects)",
    "summary_shown": ("dist", "root, dimension", "CASE any_value(dimension) " + " ".join(f"WHEN {lit(d)} THEN {k}" for d, k in sm.TOP.items()) + " ELSE 2147483647 END"),
    "stats": "(SELECT DISTINCT dimension, key FROM dist WHERE dimension IN ('project_type', 'language', 'confidence', 'framework'))",
}


@query(q(_ENTRIES + " UNION ALL ".join(
    f"SELECT {lit(name)} AS \"table\", coalesce(sum(n), 0)::BIGINT AS n FROM {_FIRST(*rows)}" if isinstance(rows, tuple)
    else f"SELECT {lit(name)}, count(*) FROM {rows}" for name, rows in sorted(_SIZES.items(), key=lambda x: not isinstance(x[1], tuple))))
    .replace("kept AS (SELECT * FROM files WHERE", "kept AS (SELECT * FROM files WHERE length <= 4000 AND NOT contains(path, '/web/') AND"))
def analysis_with_options(spark, sf):
    """Rows of every table of a whole run with a size limit and an ignore pattern more."""
    made = jobs.run_analysis(code_files(spark, sf), rules=P.IgnoreRules(extra=["/web/"]), max_bytes=4000)
    counts = None
    for name, df in made.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = part if counts is None else counts.unionByName(part)
    return counts


_HIDDEN = """WITH t AS (SELECT '.r' AS root, '.r/' || CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN '.hid/' WHEN 2 THEN 'node_modules/'
    WHEN 3 THEN 'a/.hid/b/' WHEN 4 THEN 'a/b/' WHEN 5 THEN 'a/b/c/d/e/.hid/' ELSE 'a/b/c/d/e/' END || 'f' || CAST(doc_id AS {kind}) || '.py' AS path
  FROM {documents})"""


@query(_HIDDEN.format(kind="VARCHAR", documents="documents") + """,
  p AS (SELECT *, string_split(path, '/') AS parts FROM t),
  b AS (SELECT *, coalesce(list_max([i FOR i IN range(2, len(parts)) IF parts[i] = 'node_modules' OR parts[i] LIKE '.%']), 0) AS bad FROM p)
  SELECT root, path, array_to_string(parts[1:k], '/') AS project FROM b, range(1, 5) r(k) WHERE k < len(parts) AND k > bad""")
def hidden_root_members(spark, sf):
    """A root whose own name is hidden, with hidden and ignored directories below it."""
    files = spark.sql(_HIDDEN.format(kind="STRING", documents="{documents}") + " SELECT * FROM t", documents=table(spark, sf, "documents"))
    rows = files.withColumns({"length": F.lit(1).cast("bigint"), "content": F.lit("")})
    return corpus.assign_projects(corpus.kept_files(rows, P.IgnoreRules(match="segment"))).select("root", "path", "project")
