"""The Merkle manifest against plain trees: every group size around the fan-out, odd rows, proofs that fold."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from sourcetally.llm import catalog, merkle

SF = "/root/testdata/sf0.001"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    """(root, siblings of each node level by level as (before, after))"""
    paths = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = at // fanout * fanout
            paths[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + fanout])))
            where[i] = at // fanout
        nodes = [h(*nodes[a:a + fanout]) for a in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain(rows, fanout):
    """{(id, group, leaf): (subroot, root, proof)} of (id, group, leaf), for rows that differ"""
    groups = {}
    for i, g, leaf in rows:
        groups.setdefault(g, []).append((i is not None, i, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done, roots = {}, []
    for g in names:
        order = sorted(groups[g], key=lambda r: (r[0], r[1] if r[0] else 0, r[2]))
        root, paths = tree([leaf for _, _, leaf in order], fanout)
        roots.append(root)
        for (_, i, leaf), path in zip(order, paths):
            done[(i, g, leaf)] = (root, path)
    top, above = tree(roots, fanout) if roots else (None, [])
    return {k: (root, top, path + above[names.index(k[1])]) for k, (root, path) in done.items()}


@pytest.mark.parametrize("fanout,levels,sizes", [(2, 1, [1, 2, 3, 4, 5, 6, 7, 8, 9, 21]), (3, 1, [1, 27, 28, 10, 82]), (2, 2, [40]), (8, 2, [64, 65, 1, 700]), (8, 4, [3])])
def test_manifest_equals_plain_trees(spark, fanout, levels, sizes):
    rows = [(n, f"g{g}", h(str(g), str(n))) for g, size in enumerate(sizes) for n in range(size)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, lang string, leaf string"), fanout=fanout, levels=levels).collect()
    assert {(r.doc_id, r.lang, r.leaf): (r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got} == plain(rows, fanout)
    assert len(got) == len(rows)


def test_odd_rows(spark):
    """Null ids and groups, groups whose bytes and letters order differently, equal ids, equal rows, names that clash."""
    rows = [(None, None, h("a"), 1, 2), (None, None, h("b"), 1, 2), (5, "é", h("c"), 1, 2), (5, "z", h("d"), 1, 2), (5, "z", h("e"), 1, 2), (7, "", h("f"), 1, 2),
            (9, "Z", h("g"), 1, 2), (2, "\U0001F600", h("i"), 1, 2), (2, "￮", h("j"), 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, root int, at int")
    got = merkle.manifest(docs, fanout=2, levels=1).collect()
    assert {(r.doc_id, r.lang, r.leaf): (r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got} == plain([r[:3] for r in rows], 2)
    assert {r["at"] for r in got} == {2}
    same = spark.createDataFrame([(1, "a", h("x"))] * 21, "doc_id long, lang string, leaf string")
    got = merkle.manifest(same, fanout=2, levels=2).withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(got) == 21 and {r.folded for r in got} == {tree([h("x")] * 21, 2)[0]}
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_leaves(spark):
    row = spark.createDataFrame([(None, "é:", 3, "")], "a long, b string, c int, d string").select(
        merkle.leaf_of(*[F.col(c) for c in "abcd"]).alias("leaf")).first()
    assert row.leaf == h("-3:é:1:30:")


def test_query(spark):
    docs = catalog.table(spark, SF, "documents").collect()
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    upper = str.maketrans(catalog.UPPER, catalog.LOWER)
    leaf = lambda d, text: h(*map(value, (d.doc_id, d.source, d.lang, d.n_chars, text)))
    known = {k[0]: (k[2], *v) for k, v in plain([(d.doc_id, d.lang, leaf(d, d.text)) for d in docs], 8).items()}
    got = {r.doc_id: r for r in catalog.op11_merkle_manifest(spark, SF).collect()}
    assert set(got) == set(known)
    tampered = 0
    for d in docs:
        mine, subroot, root, path = known[d.doc_id]
        hit = crc32(str(d.doc_id).encode()) % 3 == 0 and d.text is not None
        node = leaf(d, d.text.translate(upper)) if hit else mine
        for before, after in path:
            node = h(before, node, after)
        r = got[d.doc_id]
        assert (r.leaf, r.subroot, r.root, r.folded_root, r.verified) == (mine, subroot, root, node, node == root)
        assert r.proof_sha256 == h(*[b + a for b, a in path])
        tampered += not r.verified
    assert tampered
