"""Extraction rules on single files."""

import json
import random

import pytest
from conftest import column
from pyspark.sql import functions as F

from sourcetally.functions import text, urls
from sourcetally.operators import features as ft, matching
from sourcetally.operators.features import file_features
from sourcetally.sources.patterns import default_patterns


def one(files_of, name, content, what):
    row = file_features(files_of({f"r/{name}": content})).select(what).first()
    return row[0]


@pytest.mark.parametrize("content, expected", [
    ("import a.b as c\nfrom d import E, f", ["a.b", "E", "d"]),       # an import form is not anchored
    ("import ñam\nfrom x import y", ["ñam", "y", "x"]),      # Unicode names and spaces
    ("import a\nimport a", ["a"]),
    ("nothing", []),
])
def test_imports(files_of, content, expected):
    assert one(files_of, "x.py", content, "imports") == expected
    assert one(files_of, "x.js", content, "imports") == []


def test_main_guard(files_of):
    assert one(files_of, "x.py", "if  __name__=='__main__':", "has_main")
    assert not one(files_of, "x.py", "if __name__ == __main__:", "has_main")
    assert not one(files_of, "x.js", "if __name__ == '__main__':", "has_main")


@pytest.mark.parametrize("content, error, packages", [
    ('{"dependencies":{"a":"1","b":"1"},"peerDependencies":{"a":"3"},"devDependencies":{"a":"2"}}', None,
     {"a": "3", "b": "1"}),
    ('{"dependencies":{"a":"1","a":"2"}}', None, {"a": "2"}),
    ('{"name":"x"}', None, {}),
    ("{bad", "Invalid JSON in package.json", {}),
    ("", "Invalid JSON in package.json", {}),
    ("{'dependencies':{}}", "Invalid JSON in package.json", {}),
    ('{"dependencies":{}} extra', "Invalid JSON in package.json", {}),
    ("[1]", None, {}),
    ("3", "Error analyzing file: package.json is not an object", {}),
    ('{"dependencies":null}', "Error analyzing file: a dependency group is not an object", {}),
])
def test_manifest(files_of, content, error, packages):
    row = file_features(files_of({"r/package.json": content})).select("error", "dependencies").first()
    assert row["error"] == error
    if error is None:
        assert {d["package"]: d["version"] for d in row["dependencies"]} == packages


ENDPOINT_ROWS = [
    ("@app.route('/a')", {("flask", "UNKNOWN", "/a")}),
    ("@blueprint.route(\"a\")", {("flask", "UNKNOWN", "/a")}),
    ("@api.route('http-x')", {("flask", "UNKNOWN", "http-x")}),
    ("@app.get('/x')", {("fastapi", "GET", "/x"), ("express", "GET", "/x")}),
    ("@router.post('/x')", {("fastapi", "POST", "/x"), ("express", "POST", "/x")}),
    ("@api.put('/x')", {("fastapi", "PUT", "/x")}),
    ("app.delete('/x')", {("express", "DELETE", "/x")}),
    ("router.patch('/x')", {("express", "PATCH", "/x")}),
    ("@RequestMapping('/x')", {("spring", "UNKNOWN", "/x")}),
    ("@GetMapping('/x')", {("spring", "UNKNOWN", "/x")}),
    ("@PostMapping('/x')", {("spring", "UNKNOWN", "/x")}),
    ("@PutMapping('/x')", {("spring", "UNKNOWN", "/x")}),
    ("@DeleteMapping('/x')", {("spring", "UNKNOWN", "/x")}),
    ("path('x/')", {("django", "UNKNOWN", "/x/")}),
    ("url('^x')", {("django", "UNKNOWN", "/^x")}),
    ("re_path('^x')", {("django", "UNKNOWN", "/^x")}),
    ("get 'x'", {("rails", "UNKNOWN", "/x")}),
    ("post 'x'", {("rails", "UNKNOWN", "/x")}),
    ("put 'x'", {("rails", "UNKNOWN", "/x")}),
    ("delete 'x'", {("rails", "UNKNOWN", "/x")}),
    ("z api/v1/items-2 z", {("generic", "UNKNOWN", "/v1/items-2")}),
    ("endpoints = 'x'", {("generic", "UNKNOWN", "/x")}),
    ("'route': 'x'", {("generic", "UNKNOWN", "/x")}),
]


def test_every_endpoint_form(files_of):
    tree = {f"r/f{n}.py": content for n, (content, _) in enumerate(ENDPOINT_ROWS)}
    got = {r["name"]: {(e["framework"], e["method"], e["path"]) for e in r["endpoints"]}
           for r in file_features(files_of(tree)).select("name", "endpoints").collect()}
    for n, (content, expected) in enumerate(ENDPOINT_ROWS):
        assert got[f"f{n}.py"] == expected, content


CALL_ROWS = [
    ("requests.get('/api/a')", {("python", "/api/a")}),
    ("aiohttp.post('/api/a')", {("python", "/api/a"), ("javascript", "/api/a")}),   # http.post inside
    ("fetch('/api/a')", {("javascript", "/api/a")}),
    ("axios.put('/api/a')", {("javascript", "/api/a")}),
    ("http.get('/api/a')", {("javascript", "/api/a")}),
    ("new RestTemplate().getForObject('/api/a')", {("java", "/api/a")}),
    ("RestTemplate().a('/api/a') + b('/api/b')", {("java", "/api/b")}),       # greedy up to the end of the line
    ("webClient.get().uri('/api/a')", {("java", "/api/a")}),
    ("HttpClient.x('/api/a')", {("java", "/api/a")}),
    ("x = 'https://svc/api/a'", {("urls", "http://svc/api/a")}),              # always rebuilt as http
    ("x = 'http://localhost:80/api/a'", {("urls", "/api/a"), ("urls", "http://localhost:80/api/a")}),
    ("x = '127.0.0.1:80/api/a'", {("urls", "/api/a")}),
    ("fetch('/img/api/logo.png')", set()),
]


def test_every_call_form(files_of):
    tree = {f"r/f{n}.ts": content for n, (content, _) in enumerate(CALL_ROWS)}
    got = {r["name"]: {(c["language"], c["url"]) for c in r["calls"]}
           for r in file_features(files_of(tree)).select("name", "calls").collect()}
    for n, (content, expected) in enumerate(CALL_ROWS):
        assert got[f"f{n}.ts"] == expected, content


@pytest.mark.parametrize("url, expected", [
    ("http://x/api/y", True), ("http://CDN/api/y", False), ("/a/b/", True), ("/a/b", False), ("/v12/x", True),
    ("/services/x", True), ("plain", False), ("grpc://x", True)])
def test_service_url(spark, url, expected):
    assert spark.range(1).select(urls.is_service_url(F.lit(url))).first()[0] is expected


@pytest.mark.parametrize("path, kind", [
    ("/Health/x", "health"), ("/metrics", "metrics"), ("/login", "auth"), ("/my-webhook", "webhook"),
    ("/settings", "config"), ("/admin/health", "health"), ("/admin", "admin"), ("/users/{id}", "resource"), ("/", "other")])
def test_endpoint_type(spark, path, kind):
    assert spark.range(1).select(urls.endpoint_type(F.lit(path))).first()[0] == kind


def test_hits_score_as_defined(files_of):
    files = files_of({
        "r/pages/pages/index.js": "it(x) it(y) describe(",       # a name counts once, a text per pattern
        "r/m.py": "import flask.views\nimport Flask",             # an import counts per listed name
        "r/notes.md": "import torch",                             # not important: no framework content
        "r/test_app.py": "", "r/kafka/redis.txt": "KAFKA_ REDIS_"})
    got = {}
    for r in ft.hits(file_features(files)).collect():
        key = (r["path"].split("/")[-1], r["family"], r["name"], r["kind"])
        got[key] = got.get(key, 0) + 1
    assert got[("index.js", "framework", "next", "file")] == 1
    assert got[("index.js", "framework", "jest", "content")] == 2
    assert got[("m.py", "framework", "flask", "import")] == 2
    assert ("notes.md", "framework", "pytorch", "content") not in got
    assert got[("test_app.py", "framework", "flask", "file")] == 1      # app.py inside test_app.py
    assert got[("test_app.py", "framework", "pytest", "file")] == 1     # test_*.py
    assert got[("redis.txt", "microservice", "message_queue", "file")] == 2
    assert got[("redis.txt", "microservice", "message_queue", "content")] == 2


def test_matching_plans_agree(spark, monkeypatch):
    """Both plans find what `in` finds: built-in literals, anchors across each other, signs of the search's own language, odd texts."""
    rng = random.Random(3)
    own = ["", "a", "ab", "]^-", "\\d+", "a.b", "'\"\\", "\n\t ", "é\U0001F600z", "\U0001F600\U0001F601\U0001F602", "aaa", "aaaa", "{1}[(", "x\u0000y"]
    for literals in (default_patterns().literals("content"), own, []):
        texts = [" ".join(literals[i::7]) + "é\U0001F600" for i in range(7)] + ["", None, "aaaaa", "\U0001F600" * 5 + "\U0001F601\U0001F602"]
        texts += ["".join(rng.choice("".join(literals) or "ab") for _ in range(rng.randrange(300))) for _ in range(200)]
        texts += [t[:len(t) // 2] + p + t[len(t) // 2:] for p in literals for t in rng.choices(texts[-200:], k=2)]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4).cache()
        want = {i: sorted(p for p in literals if t is not None and p in t) for i, t in enumerate(texts)}
        for engine in ("indexed", "plain"):
            for most in (matching.INDEXED, 100):                             # long texts take the plain way
                monkeypatch.setattr(matching, "INDEXED", most)
                got = df.select("i", matching.content_matches(F.col("t"), literals, engine).alias("m")).collect()
                assert {r.i: sorted(r.m) for r in got} == want
    with pytest.raises(ValueError):
        matching.content_matches(F.col("t"), literals, "other")


def test_features_need_no_python_workers(spark, files_of):
    plan = file_features(files_of({"r/a.py": "import flask"}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_package_dictionary(files_of):
    patterns = default_patterns({"react": ["react"]})
    features = file_features(files_of({"r/package.json": json.dumps({"dependencies": {"react": "1"}})}), patterns)
    assert column(ft.hits(features, patterns).where("kind = 'dependency'"), "name") == ["react"]
    assert text.DEPENDENCY_GROUPS[-1] == "peerDependencies"
