"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Every statement is one chain of common table expressions, written against the definitions and
not against the Spark plans: theta joins, windows and nested loops where the jobs use anchors,
aggregates and equality.  Fine on test data, not meant for more.
"""

from __future__ import annotations

from .. import dictionaries as D
from ..sources.patterns import default_patterns
from .corpus_sql import CODE_FILES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(map(lit, items)) + "]"


def ends(column: str, suffixes) -> str:
    return "(" + " OR ".join(f"suffix({column}, {lit(s)})" for s in suffixes) + ")"


def has(column: str, terms) -> str:
    """column contains one of the terms"""
    return f"(len(list_filter({strings(terms)}, lambda t: contains({column}, t))) > 0)"


def globs(column: str, patterns) -> str:
    return f"(len(list_filter({strings(patterns)}, lambda g: {column} GLOB g)) > 0)"


WILD = [p for p in D.DEFAULT_IGNORE if "*" in p]


def ignored(patterns=D.DEFAULT_IGNORE) -> str:
    return (f"({has('path', patterns)} OR {globs('name', patterns)} OR {globs('path', patterns)} "
            f"OR name LIKE '.%')")


def bad_dir(segment: str) -> str:
    return f"({segment} LIKE '.%' OR {globs(segment, WILD)})"


def owned(bad=bad_dir) -> str:
    """Some directory of the first four has no bad one at it or below; the root is never bad."""
    return (f"coalesce(list_max(list_filter(range(2, len(parts)), lambda i: {bad('parts[i]')})), 0) "
            "< least(len(parts) - 1, 4)")


_LANGUAGE = "CASE " + " ".join(
    f"WHEN {ends('name', suffixes)} THEN {lit(lang)}" for lang, suffixes in D.LANGUAGES.items()) + " END"
_KEY = (f"({has('path', D.KEY_FILES)} OR list_contains({strings(D.KEY_FILES)}, name) OR "
        f"{globs('name', [p for p in D.KEY_FILES if '*' in p])})")
_CONFIDENCE = lambda x: "CASE " + " ".join(
    f"WHEN {x} >= {bound} THEN {lit(label)}" for bound, label in D.CONFIDENCE_LEVELS
) + f" ELSE {lit(D.LOWEST_CONFIDENCE)} END"
_ENDPOINT_TYPE = "CASE " + " ".join(
    f"WHEN {has('lower(endpoint)', terms)} THEN {lit(label)}" for label, terms in D.ENDPOINT_TYPES.items()
) + rf" WHEN regexp_matches(endpoint, '/[\p{{L}}\p{{N}}_]') THEN 'resource' ELSE 'other' END"


def service_url(u: str) -> str:
    forms = " OR ".join(f"regexp_matches(lower({u}), {lit(f)})" for f in D.URL_SERVICE_FORMS)
    return (f"CASE WHEN {has(f'lower({u})', D.URL_SKIP_TERMS)} THEN false "
            f"WHEN {has(f'lower({u})', D.URL_SERVICE_TERMS)} THEN true WHEN {forms} THEN true ELSE false END")


def relationship_type(comm: str, u: str) -> str:
    known = " ".join(f"WHEN {comm} = {lit(c)} THEN {lit(t)}" for c, t in D.RELATIONSHIP_LABELS.items())
    return (f"CASE {known} WHEN contains(lower({u}), 'graphql') THEN 'GraphQL' "
            f"WHEN contains(lower({u}), 'grpc://') THEN 'gRPC' "
            f"WHEN contains(lower({u}), 'soap') OR contains(lower({u}), 'wsdl') THEN 'SOAP' "
            f"WHEN contains(lower({u}), 'ws://') OR contains(lower({u}), 'wss://') THEN 'WebSocket' "
            f"WHEN lower({u}) LIKE 'http://%' OR lower({u}) LIKE 'https://%' THEN 'REST' ELSE 'HTTP' END")


def _found(form: int, columns: str, suffixes, regex: str, first: int, second: int) -> str:
    """Rows (root, path, name, form, nth, a, b) of one extraction expression."""
    return f"""
    SELECT root, path, name, {form} AS form, u.nth, a[u.nth] AS a, b[u.nth] AS b, {columns}
    FROM (SELECT root, path, name, regexp_extract_all(content, {lit(regex)}, {first}) AS a,
                 regexp_extract_all(content, {lit(regex)}, {second}) AS b
          FROM facts WHERE {ends('path', suffixes)}) t,
         LATERAL (SELECT unnest(range(1, len(a) + 1)) AS nth) u"""


_ENDPOINTS = " UNION ALL ".join(
    _found(n, f"{lit(fw)} AS framework, {'upper(b[u.nth])' if mg else lit('UNKNOWN')} AS method",
           D.ENDPOINT_SUFFIXES, regex, pg, mg)
    for n, (fw, _, regex, mg, pg) in enumerate(D.ENDPOINT_FORMS))

_CALLS = " UNION ALL ".join(
    _found(n, f"{lit(lang)} AS language, {lit(prefix)} || a[u.nth]"
           + (" || b[u.nth]" if len(groups) == 2 else "") + " AS url",
           D.CALL_SUFFIXES, regex, groups[0], groups[-1])
    for n, (lang, _, regex, groups, prefix) in enumerate(D.CALL_FORMS))

_DICT = ", ".join(
    f"({lit(f)}, {lit(n)}, {lit(k)}, {lit(p)}, {w}, {o})" for f, n, k, p, w, o in default_patterns().rows)

_COUNTS = ", ".join(f"count(*) FILTER (language = {lit(lang)}) AS {lang}_files" for lang in D.LANGUAGES)
_MOST = "greatest(" + ", ".join(f"{lang}_files" for lang in D.LANGUAGES) + ")"
_PRIMARY = f"CASE WHEN {_MOST} = 0 THEN 'unknown' " + " ".join(
    f"WHEN {lang}_files = {_MOST} THEN {lit(lang)}" for lang in D.LANGUAGES) + " END"

_VARIANTS = ["seg", "replace(seg, '-', '')", "replace(seg, '_', '')", "replace(seg, '-', '_')",
             "replace(seg, '_', '-')"]


def url_keys(u: str) -> str:
    """list of keys of a URL in look-up order"""
    host = f"split_part(split_part(substr({u}, strpos({u}, '://') + 3), '/', 1), ':', 1)"
    return (f"list_concat(flatten(list_transform(string_split(lower({u}), '/'), lambda seg: [{', '.join(_VARIANTS)}])), "
            f"CASE WHEN contains({u}, '://') THEN list_concat([{host}], string_split({host}, '.')) "
            f"ELSE []::VARCHAR[] END)")


CTES = f"""
WITH code_files AS ({CODE_FILES.format(documents='documents')}),
files AS (SELECT root, path, strlen(content)::BIGINT AS length, content,
                 split_part(path, '/', -1) AS name, string_split(path, '/') AS parts FROM code_files),
dict(family, entry, kind, pattern, weight10, ord) AS (VALUES {_DICT}),
entries AS (SELECT DISTINCT family, entry, weight10, ord FROM dict),
kept AS (SELECT * FROM files WHERE NOT {ignored()} AND {owned()}),
facts AS (
  SELECT *, key_file OR {ends('name', D.IMPORTANT_SUFFIXES)} AS important,
         (key_file OR {ends('name', D.IMPORTANT_SUFFIXES)}) AND NOT {ends('name', D.MEDIA_SUFFIXES)}
           AS analyzed
  FROM (SELECT *, lower(regexp_extract(name, '[^./][^/]*(\\.[^./]*)$', 1)) AS ext, {_LANGUAGE} AS language,
               {_KEY} AS key_file FROM kept)),
member AS (
  SELECT f.*, array_to_string(parts[1:k], '/') AS project
  FROM facts f, range(1, 5) t(k)
  WHERE k <= len(parts) - 1 AND (k = 1 OR NOT {bad_dir('parts[k]')})
    AND len(list_filter(parts[k + 1:len(parts) - 1], lambda d: {bad_dir('d')})) = 0),
owner AS (SELECT DISTINCT path, project FROM member),
imports AS (
  SELECT DISTINCT root, path, unnest(list_concat(regexp_extract_all(content, {lit(D.IMPORT_FORMS[0])}, 1),
                                           regexp_extract_all(content, {lit(D.IMPORT_FORMS[1])}, 1))) AS import
  FROM facts WHERE analyzed AND suffix(name, '.py')),
has_main AS (SELECT path FROM facts WHERE analyzed AND suffix(name, '.py')
             AND regexp_matches(content, {lit(D.MAIN_GUARD)})),
manifests AS (SELECT root, path, content, json_valid(content) AS ok FROM facts
              WHERE analyzed AND name = 'package.json'),
errors AS (
  SELECT root, path, 'Invalid JSON in package.json' AS error FROM manifests WHERE NOT ok),
dependency_rows AS (
  SELECT root, path, g.grp, k.package, json_extract_string(content, '$.' || g.field || '."' || k.package || '"') AS version
  FROM (SELECT * FROM manifests WHERE ok) m,
       (VALUES (0, 'dependencies'), (1, 'devDependencies'), (2, 'peerDependencies')) g(grp, field),
       LATERAL (SELECT unnest(json_keys(content, '$.' || g.field)) AS package) k),
dependencies AS (
  SELECT root, path, package, version FROM dependency_rows
  QUALIFY row_number() OVER (PARTITION BY path, package ORDER BY grp DESC) = 1),
file_hits AS (
  SELECT DISTINCT f.root, f.path, d.family, d.entry, 'file' AS kind, CASE WHEN family = 'framework' THEN '' ELSE pattern END AS pattern
  FROM facts f JOIN dict d ON d.kind = 'file' AND CASE WHEN d.family = 'framework'
    THEN contains(f.path, d.pattern) OR f.name GLOB d.pattern OR f.path GLOB ('*' || d.pattern || '*')
    ELSE contains(f.path, d.pattern) END),
content_hits AS (
  SELECT f.root, f.path, d.family, d.entry, 'content' AS kind, d.pattern
  FROM facts f JOIN dict d ON d.kind = 'content' AND contains(f.content, d.pattern)
  WHERE f.analyzed OR d.family <> 'framework'),
import_hits AS (
  SELECT DISTINCT i.root, i.path, d.family, d.entry, 'import' AS kind, d.pattern
  FROM imports i JOIN dict d ON d.family = 'framework' AND d.kind = 'import'
    AND (i.import = d.pattern OR starts_with(i.import, d.pattern || '.'))),
hits AS (
  SELECT h.*, e.weight10, e.ord FROM (
    FROM file_hits UNION ALL FROM content_hits UNION ALL FROM import_hits) h
  JOIN entries e USING (family, entry)),
scores AS (
  SELECT h.root, o.project, h.family, h.entry, h.ord, sum(h.weight10)::BIGINT AS score10
  FROM hits h JOIN owner o USING (path) GROUP BY ALL),
counts AS (
  SELECT root, project, count(*) AS file_count, {_COUNTS},
         coalesce(bool_or(path IN (SELECT path FROM has_main)), false) AS has_main,
         bool_or(name IN ('setup.py', 'pyproject.toml')) AS has_setup,
         bool_or(name = 'package.json') AS has_package_json,
         bool_or(name IN ('Dockerfile', 'docker-compose.yml')) AS has_docker
  FROM member GROUP BY root, project),
best AS (SELECT project, family, entry, score10 FROM scores
         QUALIFY row_number() OVER (PARTITION BY project, family ORDER BY score10 DESC, ord) = 1),
wide AS (
  SELECT c.*, {_PRIMARY} AS primary_language, b.entry AS framework, b.score10 AS framework_score10,
         split_part(c.project, '/', -1) AS pname
  FROM counts c LEFT JOIN best b ON b.project = c.project AND b.family = 'framework'),
evidence AS (
  SELECT project, 0 AS o, 'python_package' AS kind, 0.9::DOUBLE AS x FROM wide WHERE has_setup
  UNION ALL SELECT project, 1, 'node_package', 0.85 FROM wide WHERE has_package_json
  UNION ALL SELECT project, 2, 'microservice', 0.7 FROM wide WHERE has_docker
  UNION ALL SELECT project, 3, 'web_application', 0.75 FROM wide
    WHERE html_files > 0 AND (javascript_files > 0 OR typescript_files > 0)
  UNION ALL SELECT project, 4, framework, least(framework_score10 / 30.0::DOUBLE, 0.95::DOUBLE) FROM wide WHERE framework_score10 > 10
  UNION ALL SELECT project, 5, 'python_script', 0.8 FROM wide WHERE has_main AND primary_language = 'python'
  UNION ALL SELECT project, 6, CASE WHEN primary_language = 'python' THEN 'python_module'
      WHEN primary_language IN ('javascript', 'typescript') THEN 'js_module'
      WHEN primary_language = 'java' THEN 'java_module' ELSE 'unknown' END,
    CASE WHEN primary_language IN ('python', 'javascript', 'typescript', 'java') THEN 0.4 ELSE 0.2 END FROM wide),
chosen AS (SELECT project, kind, x FROM evidence
           QUALIFY row_number() OVER (PARTITION BY project ORDER BY o = 6, x DESC, o) = 1),
micro AS (SELECT project, sum(score10)::BIGINT AS total10 FROM scores WHERE family = 'microservice' GROUP BY project),
projects AS (
  SELECT w.*, c.kind AS project_type, c.x AS confidence, {_CONFIDENCE('c.x')} AS confidence_text,
         coalesce(m.total10, 0) AS total10,
         coalesce(m.total10, 0) > CASE WHEN file_count < 5 THEN 30 ELSE 20 END AS is_microservice,
         least(coalesce(m.total10, 0) / 50.0::DOUBLE, 0.95::DOUBLE) AS microservice_probability,
         coalesce(b.entry, 'unknown') AS primary_communication
  FROM wide w JOIN chosen c USING (project) LEFT JOIN micro m USING (project)
  LEFT JOIN best b ON b.project = w.project AND b.family = 'communication'),
services AS (SELECT * FROM projects WHERE is_microservice),
endpoint_rows AS (
  SELECT root, path, name AS file, form, nth, framework, method,
         CASE WHEN a LIKE '/%' OR a LIKE 'http%' THEN a ELSE '/' || a END AS endpoint FROM ({_ENDPOINTS})),
endpoints AS (
  SELECT e.root, o.project, e.path AS at_path, e.form, e.nth, e.endpoint, e.method, e.file, e.framework,
         {_ENDPOINT_TYPE} AS type
  FROM endpoint_rows e JOIN owner o USING (path)
  QUALIFY row_number() OVER (PARTITION BY o.project, endpoint, method, file, framework ORDER BY e.path, form, nth) = 1),
call_rows AS (
  SELECT root, path, name AS file, form, nth, language, url FROM ({_CALLS}) WHERE url <> '' AND {service_url('url')}),
calls AS (
  SELECT c.root, o.project, c.path AS at_path, c.form, c.nth, c.url, c.file, c.language
  FROM call_rows c JOIN owner o USING (path)
  QUALIFY row_number() OVER (PARTITION BY o.project, url, file, language ORDER BY c.path, form, nth) = 1),
spellings AS (
  SELECT e.root, s.pname AS service, e.project, 0 AS tail, at_path, form, nth,
         regexp_replace(endpoint, '[<{{][^>}}]+[>}}]', '*', 'g') AS clean
  FROM endpoints e JOIN services s USING (project)),
registered AS (
  SELECT root, service, project, tail, at_path, form, nth, v.variant, p[v.variant] AS pattern
  FROM (SELECT *, [service || clean, lower(service) || clean, clean, regexp_replace(clean, '^/', ''),
                   'localhost/' || service || clean, 'localhost' || clean,
                   '127.0.0.1/' || service || clean, '127.0.0.1' || clean] AS p FROM spellings) t,
       LATERAL (SELECT unnest(range(1, 9)) AS variant) v
  UNION ALL SELECT root, pname, project, 1, '', 0, 0, 1, pname FROM services
  UNION ALL SELECT root, pname, project, 1, '', 0, 0, 2, lower(pname) FROM services),
numbered AS (SELECT *, row_number() OVER (ORDER BY service, project, tail, at_path, form, nth, variant) AS ord FROM registered),
service_map AS (SELECT root, pattern, min(ord) AS pos, arg_max(service, ord) AS service FROM numbered GROUP BY root, pattern),
service_calls AS (SELECT c.*, s.pname AS service, s.primary_communication FROM calls c JOIN services s USING (project)),
urls AS (SELECT DISTINCT root, url FROM service_calls),
direct AS (
  SELECT u.root, u.url, arg_min(m.service, m.pos) AS target
  FROM urls u JOIN service_map m ON m.root = u.root AND contains(lower(u.url), m.pattern) GROUP BY u.root, u.url),
by_key AS (
  SELECT k.root, k.url, arg_min(m.service, k.rank) AS target
  FROM (SELECT root, url, unnest(keys) AS key, unnest(range(len(keys))) AS rank
        FROM (SELECT root, url, {url_keys('url')} AS keys FROM urls ANTI JOIN direct USING (root, url))) k
  JOIN service_map m ON m.root = k.root AND m.pattern = k.key GROUP BY k.root, k.url),
resolved AS (SELECT u.root, u.url, coalesce(d.target, k.target) AS target
             FROM urls u LEFT JOIN direct d USING (root, url) LEFT JOIN by_key k USING (root, url)),
relationships AS (
  SELECT c.root, c.service AS source, r.target, {relationship_type('c.primary_communication', 'c.url')} AS type, c.url, c.file
  FROM service_calls c JOIN resolved r USING (root, url)
  WHERE r.target IS NOT NULL AND r.target <> c.service
  QUALIFY row_number() OVER (PARTITION BY c.root, c.service, r.target, {relationship_type('c.primary_communication', 'c.url')}
                             ORDER BY c.project, at_path, form, nth, c.url, c.file) = 1),
histogram AS (SELECT root, project, ext, count(*) AS n FROM member WHERE ext <> '' GROUP BY ALL),
project_imports AS (SELECT DISTINCT i.root, o.project, i.import FROM imports i JOIN owner o USING (path)),
dist AS (
  SELECT root, 'project_type' AS dimension, project_type AS key, count(*) AS n FROM projects GROUP BY ALL
  UNION ALL SELECT root, 'language', primary_language, count(*) FROM projects GROUP BY ALL
  UNION ALL SELECT root, 'confidence', confidence_text, count(*) FROM projects GROUP BY ALL
  UNION ALL SELECT root, 'framework', entry, count(*) FROM scores WHERE family = 'framework' AND score10 > 10 GROUP BY ALL
  UNION ALL SELECT root, 'key_file', name, count(*) FROM member WHERE key_file GROUP BY ALL
  UNION ALL SELECT root, 'extension', ext, sum(n)::BIGINT FROM histogram GROUP BY ALL)
"""


_ROOTS = CTES.replace("FROM code_files)", """FROM (
  SELECT split_part(path, '/', 2) AS root, substr(path, strpos(path, '/') + 1) AS path, content
  FROM code_files WHERE len(string_split(path, '/')) > 2))""")


def q(select: str) -> str:
    return CTES + select


def q_roots(select: str) -> str:
    """The same with every top directory as a root of its own."""
    return _ROOTS + select
