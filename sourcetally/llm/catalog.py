"""Registered queries of the operators over the given tables: name -> (query, SQL or None)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcetally.llm import chunking, language, merkle, minhash, packing, pieces, sharding, simhash, tokens, tournament, toxicity, variants, vectors
from sourcetally.llm.arrow import small_batches


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in a session whose Arrow batches are small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id"))
    labels, net = language.learn(docs.where("not held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), labels, net, keep=["doc_id", "held_out"])


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(table(spark, sf_dir, "documents"), every=100)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Classifier:
    labels = table(spark, sf_dir, "labels").where(~language.held_out("doc_id"))
    return toxicity.learn(table(spark, sf_dir, "documents"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language.held_out("doc_id"))
    return toxicity.score(docs, toxicity_model(spark, sf_dir), keep=["doc_id", "held_out"])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(sharding.measured(table(spark, sf_dir, "documents")), 8)
    return dealt.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=Fraction(85, 100))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text freed of passages that an earlier document has."""
    done = chunking.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", (F.col("n_spans") > 0).alias("repeated"), "n_spans", "removed_bytes", F.length("text").cast("long").alias("n_chars"), "text")


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pieces.decode(pieces.encode(docs, path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "log_score", F.xxhash64("ids").alias("ids_hash"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"))


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of ``docs``."""
    cut = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"))
    return packing.pack(cut).withColumnRenamed("id", "doc_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


#: Columns that a leaf of the manifest covers; of one row in so many the text is tampered with.
COVERED, TAMPERED = ("doc_id", "source", "lang", "n_chars", "text"), 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf_of(*[text if c == "text" else F.col(c) for c in COVERED])
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(F.translate("text", UPPER, LOWER))).alias("tampered"))
    done = merkle.manifest(leaves).withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda level: F.concat(level["before"], level["after"])), "")
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tournament.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return placed.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.vocabulary(table(spark, sf_dir, "documents"))
    return variants.spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


#: Links of pairs (a, b), both ways, followed from every id.
REACH = """,
edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, seen) AS (SELECT id, id FROM ids UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.seen = e.a),
part AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
"""

MINHASH_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM split),
terms AS (SELECT doc_id, unnest(g) AS x FROM sets),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM terms p JOIN terms q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sets s ON s.doc_id = a JOIN sets t ON t.doc_id = b WHERE 100 * n >= 85 * (len(s.g) + len(t.g) - n)),
ids AS (SELECT doc_id AS id FROM documents)""" + REACH + """
SELECT s.doc_id, len(s.g) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sets s JOIN part p ON p.id = s.doc_id
"""

VECTORS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])),
links AS (SELECT p.id AS a, q.id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.id < q.id AND len(p.v) = len(q.v)
          WHERE list_cosine_similarity(p.v, q.v) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings)""" + REACH + """,
degree AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
SELECT p.id AS vec_id, coalesce(n, 0) AS n_links, component_id, p.id = component_id AS kept FROM part p LEFT JOIN degree d ON d.a = p.id
"""

#: crc32 of the bytes of an ASCII string, in SQL.
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split({0}, '')]),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))))"""


def manifest_sql(levels: int = 12) -> str:
    """Levels of the two trees as steps of their own: node i of a level is the run i of the one below."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    digest = lambda text: "sha256(" + " || ".join(text if c == "text" else part(c) for c in COVERED) + ")"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    steps = [f"""leaves AS (SELECT doc_id, lang, {digest(part('text'))} AS leaf,
  CASE WHEN {CRC_SQL.format('doc_id::VARCHAR')} % {TAMPERED} = 0 THEN {digest(part(lower))} END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth FROM leaves),
a0 AS (SELECT lang AS tree, nth, leaf AS node FROM placed)"""]

    def climb(name: str, path: str) -> None:
        for k in range(levels):
            steps.append(f"""{name}{k}c AS (SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS several FROM {name}{k}),
{name}{k + 1} AS (SELECT tree, nth // 8 AS nth, CASE WHEN any_value(several) THEN sha256(string_agg(node, '' ORDER BY nth)) ELSE any_value(node) END AS node FROM {name}{k}c GROUP BY tree, nth // 8),
{path}{k + 1} AS (SELECT p.*, coalesce((SELECT string_agg(node, '' ORDER BY c.nth) FROM {name}{k}c c WHERE several AND c.tree IS NOT DISTINCT FROM p.tree AND c.nth // 8 = p.here // 8 AND c.nth < p.here), '') AS before{name}{k},
  coalesce((SELECT string_agg(node, '' ORDER BY c.nth) FROM {name}{k}c c WHERE several AND c.tree IS NOT DISTINCT FROM p.tree AND c.nth // 8 = p.here // 8 AND c.nth > p.here), '') AS after{name}{k},
  (SELECT several FROM {name}{k}c c WHERE c.tree IS NOT DISTINCT FROM p.tree AND c.nth = p.here) AS up{name}{k}
  FROM (SELECT * REPLACE (here // {8 if k else 1} AS here) FROM {path}{k}) p)""")

    steps.append("p0 AS (SELECT doc_id, leaf, tampered, lang AS tree, nth AS here, lang FROM placed)")
    climb("a", "p")
    steps.append(f"""b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS nth, node FROM a{levels}),
names AS (SELECT tree AS lang, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS g, node AS subroot FROM a{levels}),
q0 AS (SELECT p.* REPLACE (0 AS tree, g AS here), subroot FROM p{levels} p JOIN names n ON n.lang IS NOT DISTINCT FROM p.lang)""")
    climb("b", "q")
    every = [f"{name}{k}" for name in "ab" for k in range(levels)]
    steps.append("f0 AS (SELECT *, coalesce(tampered, leaf) AS f FROM q%d)" % levels)
    for n, key in enumerate(every):
        steps.append(f"f{n + 1} AS (SELECT * REPLACE (CASE WHEN up{key} THEN sha256(before{key} || f || after{key}) ELSE f END AS f) FROM f{n})")
    siblings = " || ".join(f"before{key} || after{key}" for key in every)
    return ("WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, node AS root, sha256({siblings}) AS proof_sha256, f AS folded_root, f = node AS verified FROM f{len(every)}, b{levels}""")


VARIANTS_SQL = r"""
WITH RECURSIVE tables AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS given FROM documents),
each AS (
  SELECT doc_id, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(given) >= 6 GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(
    [CASE WHEN ascii(c) > 127 THEN [195::BIGINT, ascii(c) - 64] ELSE [ascii(c)::BIGINT] END FOR c IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')])),
    lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]))) AS h FROM each, tables),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min({'w': other, 'n': n}, (-n, encode(other))) AS first FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN first.n >= 5 * w.n THEN first.w END AS form, CASE WHEN first.n >= 5 * w.n THEN first.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
ways AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN forms f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w ON w.word = f.word WHERE w.next IS NULL
"""

REGISTRY = {f.__name__: (f, sql) for f, sql in (
    (op1_token_counts, None), (op2_language_id, None), (op3_fingerprints, None), (op4_toxicity, None), (op5_sharding, None),
    (op6_minhash_dedup, MINHASH_SQL), (op7_embedding_dedup, VECTORS_SQL), (op8_substring_dedup, None), (op9_piece_encoding, None),
    (op10_best_fit_packing, None), (op11_merkle_manifest, manifest_sql()), (op12_tournament_packing, None), (op13_spelling_variants, VARIANTS_SQL))}
