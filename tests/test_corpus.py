"""Ignore rules, project membership, file facts: worked out by hand."""

import random

import pytest
from conftest import column
from pyspark.sql import functions as F

from sourcetally import dictionaries as D
from sourcetally.functions import paths as P, text
from sourcetally.operators import corpus
from sourcetally.sources import files as src
from sourcetally.sources.patterns import Patterns, default_patterns, family


def test_substring_rules_hit_inside_names(files_of):
    files = files_of({p: "" for p in ["r/routes.js", "r/about.html", "r/blog/x.py", "r/database.py", "r/ok.py",
                                      "r/.hid", "r/x.pyc", "r/p.png", "r/__init__.py"]})
    assert column(corpus.ignore_filter(files), "path") == ["r/__init__.py", "r/ok.py"]


def test_segment_rules_hit_whole_names(files_of):
    files = files_of({p: "" for p in ["r/routes.js", "r/out/x.py", "r/x.pyc", "r/a.egg-info/x.py", "r/ok.py"]})
    rules = P.IgnoreRules(match="segment")
    kept = corpus.kept_files(files, rules)
    assert column(corpus.assign_projects(kept), "path", "project") == [
        ("r/ok.py", "r"), ("r/routes.js", "r")]


def test_given_patterns_replace_the_defaults_and_empty_means_defaults(files_of):
    files = files_of({p: "" for p in ["r/out/x.py", "r/mine/x.py", "r/ok.py"]})
    assert column(corpus.ignore_filter(files, P.IgnoreRules(["mine"])), "path") == ["r/ok.py", "r/out/x.py"]
    assert column(corpus.ignore_filter(files, P.IgnoreRules([])), "path") == ["r/mine/x.py", "r/ok.py"]
    assert column(corpus.ignore_filter(files, P.IgnoreRules(extra=["mine"])), "path") == ["r/ok.py"]
    assert D.HOME_IGNORE and D.DESKTOP_IGNORE


def test_hidden_files_can_be_included(files_of):
    files = files_of({"r/.github/x.yml": "", "r/.rc": ""})
    assert column(corpus.ignore_filter(files, P.IgnoreRules(["zzz"], include_hidden=True)), "path") == [
        "r/.github/x.yml", "r/.rc"]
    assert column(corpus.ignore_filter(files, P.IgnoreRules(["zzz"])), "path") == ["r/.github/x.yml"]


def test_whole_path_globs(files_of):
    files = files_of({p: "" for p in ["r/a/gen_x.py", "r/b/y.py", "q/a/z.py", "r/a[1].py"]})
    assert column(corpus.ignore_filter(files, P.IgnoreRules(["r/*.py"])), "path") == ["q/a/z.py"]
    assert column(corpus.ignore_filter(files, P.IgnoreRules(["gen_?.py", "[y]*"])), "path") == [
        "q/a/z.py", "r/a[1].py"]


def test_membership_prunes_below_the_project_only(files_of):
    files = files_of({"r/a/.hid/sub/f.py": "", "r/a/b/c/d/e.py": "", "r/top.py": ""})
    kept = corpus.kept_files(files)
    assert column(corpus.assign_projects(kept), "path", "project") == [
        ("r/a/.hid/sub/f.py", "r/a/.hid/sub"),
        ("r/a/b/c/d/e.py", "r"), ("r/a/b/c/d/e.py", "r/a"), ("r/a/b/c/d/e.py", "r/a/b"),
        ("r/a/b/c/d/e.py", "r/a/b/c"), ("r/top.py", "r")]
    assert column(corpus.assign_projects(corpus.kept_files(files, max_depth=1)), "project").count("r/a") == 1
    assert column(corpus.project_dirs(kept), "project") == ["r", "r/a", "r/a/.hid/sub", "r/a/b", "r/a/b/c"]


def test_size_rules(files_of):
    mib = 1024 * 1024
    files = files_of({"r/a.py": ("x", 10 * mib), "r/b.py": ("x", 10 * mib + 1), "r/c.py": ("x", None),
                      "r/d.py": ("import flask", 5 * mib), "r/e.md": ("x", 6 * mib), "r/f.py": (None, 3)})
    kept = corpus.kept_files(files, max_bytes=D.MAX_FILE_BYTES)
    assert column(kept, "path") == ["r/a.py", "r/d.py", "r/e.md", "r/f.py"]
    assert column(corpus.file_facts(kept, D.MAX_CONTENT_BYTES), "path", "analyzed", "error") == [
        ("r/a.py", False, "File too large for analysis"), ("r/d.py", True, None), ("r/e.md", False, None),
        ("r/f.py", False, "No read access")]


@pytest.mark.parametrize("name, ext", [("a.PY", ".py"), (".env", ""), ("a.tar.gz", ".gz"), ("..x", ""), ("x.", "."),
                                       ("noext", ""), ("..a.b", ".b"), ("a..b", ".b")])
def test_extension(spark, name, ext):
    assert spark.range(1).select(P.extension(F.lit(name))).first()[0] == ext


def test_languages_and_key_files(files_of):
    names = ["a.py", "a.jsx", "a.TS", "a.scala", "a.htm", "a.sass", "My.csproj", "myapp.py", "k8s.txt", "plain.rs"]
    facts = corpus.file_facts(corpus.kept_files(files_of({f"r/{n}": "" for n in names})))
    assert column(facts, "name", "language", "is_key_file") == sorted([
        ("a.py", "python", False), ("a.jsx", "javascript", False), ("a.TS", None, False),
        ("a.scala", "java", False), ("a.htm", "html", False), ("a.sass", "css", False),
        ("My.csproj", None, True), ("myapp.py", "python", True), ("k8s.txt", None, True),
        ("plain.rs", None, False)], key=repr)


def test_listing_orders_and_cuts(files_of):
    deep = "r/d1/d2/d3/d4/d5/x.py"
    files = files_of({deep: "", "r/B.py": "", "r/a.py": "", "r/zeta/q.py": ""})
    tree = corpus.directory_listing(corpus.kept_files(files)).where("project = 'r'")
    top = tree.where("parent = 'r'").orderBy("is_file", "lower_name", "name")
    assert [tuple(r) for r in top.select("name", "is_file", "is_last").collect()] == [
        ("d1", False, False), ("zeta", False, False), ("a.py", True, False), ("B.py", True, True)]
    assert column(tree.where("cut"), "name", "level") == [("d5", 4)]
    assert tree.where("name = 'x.py'").count() == 0


def test_decode_drops_bad_bytes(spark):
    df = spark.createDataFrame([(b"a\xffb\xc3\xa9",)], "raw binary")
    assert df.select(text.decode_text(F.col("raw"))).first()[0] == "abé"


def test_raw_tree_and_roots(spark, tmp_path):
    for path, content in {"corp/a/x.py": "import os", "corp/b/corp/y.js": "1", "corp/z.txt": "t"}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    files = src.read_tree(spark, str(tmp_path / "corp"))
    assert column(files, "root", "path", "length", "content") == [
        ("corp", "corp/a/x.py", 9, "import os"), ("corp", "corp/b/corp/y.js", 1, "1"), ("corp", "corp/z.txt", 1, "t")]
    assert column(src.expand_roots(files), "root", "path") == [("a", "a/x.py"), ("b", "b/corp/y.js")]
    assert column(src.root_names(src.union_roots(files, files)), "root") == ["a", "b"]
    files.write.parquet(str(tmp_path / "table"))
    assert src.read_files(spark, str(tmp_path / "table")).count() == 3


def test_dictionaries():
    patterns = default_patterns()
    frameworks = {r[1] for r in patterns.rows if r[0] == "framework"}
    assert len(frameworks) == 80
    assert len({r[1] for r in patterns.rows if r[0] == "microservice"}) == 9
    assert len({r[1] for r in patterns.rows if r[0] == "communication"}) == 6
    kinds = [r[2] for r in patterns.rows if r[0] == "framework"]
    assert (kinds.count("file"), kinds.count("content"), kinds.count("import")) == (105, 256, 68)
    # a later group replaces an entry and keeps its position
    rows = family("f", {"a": {"files": ["1"]}, "b": {}}, {"a": {"weight": 0.3, "files": ["2"]}})
    assert rows == [("f", "a", "file", "2", 3, 0)]
    with pytest.raises(ValueError):
        Patterns(tuple([("f", "a", "file", "x", 1, 0)] * 50_001))


def test_no_size_limit_unless_asked_for(files_of):
    big = "import flask\n" + "x" * (11 << 20)
    files = files_of({"r/app.py": big, "r/b.py": ("y", None)})
    kept = corpus.kept_files(files)
    assert column(kept, "path") == ["r/app.py", "r/b.py"]
    facts = {r.path: r for r in corpus.file_facts(kept).collect()}
    assert facts["r/app.py"].analyzed and facts["r/app.py"].error is None
    assert column(corpus.kept_files(files, max_bytes=10 << 20), "path") == []
    assert corpus.dropped_by_size(files).first().files == 2
    limited = {r.path: r for r in corpus.file_facts(kept, max_content=5 << 20).collect()}
    assert limited["r/app.py"].error == "File too large for analysis" and limited["r/b.py"].analyzed


def test_root_is_never_tested_and_files_of_no_project_go(files_of):
    files = files_of({".r/w.py": "x", ".r/.hid/y.py": "x", ".r/node_modules/q.js": "x", ".r/a/z.py": "x"})
    kept = corpus.kept_files(files, P.IgnoreRules(match="segment"))
    assert {r.path: r.projects for r in kept.collect()} == {".r/w.py": [".r"], ".r/a/z.py": [".r", ".r/a"]}


def test_valid_text_keeps_its_replacement_characters(spark):
    raw = [("a\ufffdb".encode(),), (b"a\xffb",), (b"",), (None,)]
    got = spark.createDataFrame(raw, "raw binary").select(text.decode_text(F.col("raw")).alias("t"))
    assert [r.t for r in got.collect()] == ["a\ufffdb", "ab", "", None]


def test_decoding_equals_dropping_bad_bytes(spark):
    """Random bytes around whole characters, with U+FFFD and U+FFFE among them, against Python's own decoding."""
    rng = random.Random(6)
    units = [b"a", b"0", b"1", b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x98", b"\x80", b"\xed\xa0\x80", "\ufffd".encode(), "\ufffe".encode(), "\u00e9\U0001F600".encode(), b"\xef\xbf"]
    raw = [b"".join(rng.choice(units) for _ in range(rng.randrange(12))) for _ in range(3000)]
    got = spark.createDataFrame([(r,) for r in raw], "raw binary").select("raw", text.decode_text(F.col("raw")).alias("t")).collect()
    assert all(r.t == bytes(r.raw).decode("utf-8", "ignore") for r in got)


def test_tree_with_every_kind_of_name(spark, tmp_path):
    """Names with `_` and `.`, odd characters, an unreadable file, links, empty and deep directories."""
    root = tmp_path / "_corp"
    deep = "/".join("d%d" % i for i in range(12))
    tree = {"a.py": b"x", "__init__.py": b"", "_d/x.py": b"import os", ".git/_x": b"g", f"{deep}/f.txt": b"deep", "b c/100% #1?.txt": b"\xff\xc3\xa9", "\u00e9/\U0001F600.js": b"1", "big.bin": b"z" * 300}
    for name, content in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (root / "empty").mkdir()
    (root / "gone.py").symlink_to(root / "nowhere")
    (root / "again").symlink_to(root)                                       # a circle, if it were followed
    (root / "linked.py").symlink_to(root / "a.py")
    got = {r.path: (r.root, r.length, r.content) for r in src.read_tree(spark, str(root)).collect()}
    want = {f"_corp/{name}": ("_corp", len(content), content.decode("utf-8", "ignore")) for name, content in tree.items()}
    assert got == want | {"_corp/gone.py": ("_corp", 0, None), "_corp/linked.py": ("_corp", 1, "x")}
    assert "_corp/big.bin" not in column(src.read_tree(spark, f"file://{root}", max_bytes=299), "path")
    assert src.read_tree(spark, str(root / "empty")).count() == 0
    assert src.read_tree(spark, str(root / "not there")).count() == 0


def test_tree_of_ten_thousand_files(spark, tmp_path):
    """One directory holds half of the files; tasks share the rest."""
    root = tmp_path / "wide"
    names = [f"pkg{i % 70}/sub{i % 7}/m{i}.py" for i in range(5000)] + [f"all/_m{i}.py" for i in range(5000)]
    for directory in {n.rpartition("/")[0] for n in names}:
        (root / directory).mkdir(parents=True)
    for i, name in enumerate(names):
        (root / name).write_text(f"n = {i}")
    got = src.read_tree(spark, str(root))
    assert got.rdd.getNumPartitions() > 1
    assert {r.path: r.content for r in got.collect()} == {f"wide/{name}": f"n = {i}" for i, name in enumerate(names)}
