"""Endpoints, calls, the service map and the service graph.

Calls are resolved without comparing every URL with every spelling: the parts of a URL that
can be a spelling are looked up by equality (see ``contained_spellings``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..functions.literals import each
from .projects import PROJECT, by_project, project_name

GRAM = 4          # anchor of a spelling
WINDOW = 64       # longest spelling that is read off a window
CHUNK = 512       # start positions per row, so that a very long URL is many small rows
BITS = 1 << 20    # of the Bloom filter of anchors: 128 KiB, whatever the tables hold


def dedup_endpoints(features: DataFrame) -> DataFrame:
    """Endpoints of every project, each once; ``first`` is where it came up first."""
    rows = features.select("root", "projects", "path", F.col("name").alias("file"),
                           each("endpoints").alias("e"))
    return (by_project(rows, "file", "e.method", F.col("e.path").alias("endpoint"), "e.framework", "e.type",
                       F.struct("path", "e.form", "e.nth").alias("at"))
            .groupBy(*PROJECT, "endpoint", "method", "file", "framework", "type")
            .agg(F.min("at").alias("first")))


def dedup_calls(features: DataFrame) -> DataFrame:
    """Service calls of every project, each once; ``first`` is where it came up first."""
    rows = features.select("root", "projects", "path", F.col("name").alias("file"),
                           each("calls").alias("c"))
    return (by_project(rows, "file", "c.url", "c.language", F.struct("path", "c.form", "c.nth").alias("at"))
            .groupBy(*PROJECT, "url", "file", "language").agg(F.min("at").alias("first")))


def of_services(items: DataFrame, services: DataFrame, *columns: str) -> DataFrame:
    """Items (endpoints, calls) of the projects that are microservices.  A project near the
    root owns a large share of them: a plain join, whose hot partitions Spark splits as it measures
    them."""
    chosen = services.where("is_microservice").select(*PROJECT, *columns)
    return items.join(chosen, PROJECT).withColumn("service", project_name(F.col("project")))


def build_service_map(services: DataFrame, endpoints: DataFrame, drop_empty_pattern: bool = False) -> DataFrame:
    """root, pattern, service, pos.

    A spelling keeps the position of its first registration (``pos``, an ordered struct) and
    points to the service that registered it last.
    """
    registered = of_services(endpoints, services).select(
        "root", "service", "project", F.lit(0).alias("tail"), "first",
        F.posexplode(urls.service_spellings(F.col("service"), F.col("endpoint"))).alias("variant", "pattern"))
    nowhere = F.struct(F.lit("").alias("path"), F.lit(0).alias("form"), F.lit(0).alias("nth"))
    own = (services.where("is_microservice")
           .withColumn("service", project_name(F.col("project")))
           .select("root", "service", "project", F.lit(1).alias("tail"), nowhere.alias("first"),
                   F.posexplode(F.array("service", F.lower("service"))).alias("variant", "pattern")))
    ordered = registered.unionByName(own).withColumn(
        "at", F.struct("service", "project", "tail", "first", "variant"))
    if drop_empty_pattern:
        ordered = ordered.where("pattern <> ''")
    return ordered.groupBy("root", "pattern").agg(
        F.max_by("service", "at").alias("service"), F.min("at").alias("pos"))


def distinct_urls(calls: DataFrame) -> DataFrame:
    """root, url, uid: each URL once.  Long rows carry the digest instead of the URL."""
    return calls.select("root", "url").distinct().withColumn("uid", url_id(F.col("url")))


def url_id(url: Column) -> Column:
    return F.unhex(F.sha2(url, 256))


def anchors_of(spellings: DataFrame) -> DataFrame:
    """(root, anchor, n): the anchors of the spellings that are not empty and the lengths behind each.
    An anchor is the first ``GRAM`` characters, a shorter spelling itself, and of one longer than
    ``WINDOW`` its first ``WINDOW``."""
    size = F.length("pattern")
    return spellings.where(size > 0).select(
        "root", F.left("pattern", F.when(size > WINDOW, F.lit(WINDOW)).otherwise(F.lit(GRAM))).alias("anchor"), size.alias("n")).distinct()


def _bit(root: Column, anchor: Column) -> Column:
    return F.pmod(F.xxhash64(root, anchor), F.lit(BITS))


def bloom_filter(anchors: DataFrame) -> Column:
    """Bloom filter of (root, anchor) as a scalar: words of 64 bits, made by an aggregate of one row a
    word.  Its size is fixed; with very many anchors it lets more through, and nothing is lost."""
    bit = _bit(F.col("root"), F.col("anchor"))
    words = (anchors.select(F.shiftright(bit, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("bits"))
             .groupBy("id").agg(F.bit_or("bits").alias("bits")))
    every = anchors.sparkSession.range(BITS // 64).join(words, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))),
                                 lambda w: w["bits"]).alias("words")).scalar()


def anchored_places(url_table: DataFrame, anchors: DataFrame) -> DataFrame:
    """(root, uid, start, anchor, window): places of the lower-cased URLs whose gram the filter of
    anchors lets through.  All others are ruled out before there is a row for them."""
    words = bloom_filter(anchors)
    chunks = (url_table
              .withColumn("lu", F.lower("url"))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.length("lu") / CHUNK))))
              .select("root", "uid", "chunk",
                      F.col("lu").substr((F.col("chunk") * CHUNK + 1).cast("int"), F.lit(CHUNK + WINDOW)).alias("text"))
              .withColumn("words", words))

    def places(n: int) -> Column:
        def possible(i):
            bit = _bit(F.col("root"), F.substring(F.col("text"), i, F.lit(n)))
            word = F.element_at("words", (F.shiftright(bit, 6) + 1).cast("int"))
            return F.getbit(word, bit.bitwiseAND(63).cast("int")) == 1
        starts = F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.length("text") - (n - 1)))
        found = F.transform(F.filter(starts, possible), lambda i: F.struct(i.alias("i"), F.lit(n).alias("size")))
        return F.when(F.length("text") >= n, found).otherwise(F.array().cast("array<struct<i:int,size:int>>"))

    placed = chunks.select("root", "uid", "chunk", "text", F.explode(F.concat(*[places(n) for n in (*range(1, GRAM + 1), WINDOW)])).alias("p"))
    return placed.select("root", "uid", (F.col("chunk") * CHUNK + F.col("p.i")).cast("int").alias("start"),
                         F.substring(F.col("text"), F.col("p.i"), F.col("p.size")).alias("anchor"),
                         F.substring(F.col("text"), F.col("p.i"), F.lit(WINDOW)).alias("window"))


def contained_spellings(url_table: DataFrame, spellings: DataFrame) -> DataFrame:
    """(root, uid, pattern, ...) for every place of a spelling in a lower-cased URL, by equality.

    Spellings are anchored (``anchors_of``), and a Bloom filter of the anchors is tested on the grams of
    a URL before a row exists for any of its places.  Those let through are joined with the anchors,
    which lead to the lengths that spellings with this anchor have; the piece of each such length is
    a candidate, once for each URL.  A candidate that equals a spelling is contained, and no other
    can be, so the result is exact while nothing grows with (URLs x spellings).  The empty
    spelling is in every URL; it is a value of the root and no candidate.
    """
    everywhere = url_table.select("root", "uid").join(spellings.where("pattern = ''"), "root")
    spellings = spellings.where("pattern <> ''")
    anchors = anchors_of(spellings)
    led = anchored_places(url_table, anchors).join(anchors, ["root", "anchor"])
    near = led.where((F.col("n") <= WINDOW) & (F.col("n") <= F.length("window"))).select(
        "root", "uid", F.left("window", F.col("n")).alias("pattern"))
    long = (led.where((F.col("n") > WINDOW) & (F.length("anchor") == WINDOW)).select("root", "uid", "start", "n")
            .join(url_table, ["root", "uid"])
            .select("root", "uid", F.lower("url").substr(F.col("start"), F.col("n")).alias("pattern")))
    candidates = near.unionByName(long).distinct()
    return candidates.join(spellings, ["root", "pattern"]).unionByName(everywhere)


def resolve_direct(url_table: DataFrame, service_map: DataFrame) -> DataFrame:
    """(root, uid, target): the service of the first spelling contained in the URL."""
    return (contained_spellings(url_table, service_map)
            .groupBy("root", "uid").agg(F.min_by("service", "pos").alias("target")))


def resolve_by_key(url_table: DataFrame, service_map: DataFrame) -> DataFrame:
    """(root, uid, target): the first key of the URL that is itself a spelling."""
    keys = (url_table.select("root", "uid", F.posexplode(urls.url_keys(F.col("url"))).alias("rank", "pattern"))
            .groupBy("root", "uid", "pattern").agg(F.min("rank").alias("rank")))
    return (keys.join(service_map.select("root", "pattern", "service"), ["root", "pattern"])
            .groupBy("root", "uid").agg(F.min_by("service", "rank").alias("target")))


def resolve_calls(calls: DataFrame, service_map: DataFrame, keep=lambda df, name: df) -> DataFrame:
    """Target of every distinct URL: root, url, target (null if none), by containment first,
    by key for the rest.  ``keep`` (as ``session.stored``) pins what is read twice."""
    url_table = keep(distinct_urls(calls), "urls")
    direct = keep(resolve_direct(url_table, service_map), "direct")
    rest = url_table.join(direct, ["root", "uid"], "left_anti")
    found = direct.unionByName(resolve_by_key(rest, service_map))
    return url_table.join(found, ["root", "uid"], "left").select("root", "url", "target")


def service_relationships(calls: DataFrame, services: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges of the service graph: source, target, type, url, file; each (source, target, type)
    once, with its first call.  Self calls and unresolved calls make no edge."""
    made = (of_services(calls, services, "primary_communication")
            .withColumn("uid", url_id(F.col("url"))))
    targets = resolved.where("target IS NOT NULL").select(
        "root", url_id(F.col("url")).alias("uid"), "target")
    edges = made.join(targets, ["root", "uid"]).where(F.col("target") != F.col("service"))
    kind = urls.relationship_type(F.col("primary_communication"), F.col("url"))
    return (edges.select("root", F.col("service").alias("source"), "target", kind.alias("type"),
                         F.struct("project", "first", "url", "file").alias("at"))
            .groupBy("root", "source", "target", "type").agg(F.min("at").alias("at"))
            .select("root", "source", "target", "type", "at.url", "at.file"))


def call_targets(calls: DataFrame, services: DataFrame, relationships: DataFrame) -> DataFrame:
    """Target of every call of a service as the edges have it, else "Unknown"."""
    made = of_services(calls, services).withColumn("uid", url_id(F.col("url")))
    first = relationships.groupBy("root", F.col("source").alias("service"), "url").agg(
        F.min("target").alias("target")).select("root", "service", url_id(F.col("url")).alias("uid"), "target")
    return (made.join(first, ["root", "service", "uid"], "left")
            .select(*PROJECT, "service", "url", F.coalesce("target", F.lit("Unknown")).alias("target"), "file"))


def diagram_edges(relationships: DataFrame) -> DataFrame:
    """Edge list for a diagram: node identifiers and arrow."""
    return relationships.select(
        "root", urls.edge_node(F.col("source")).alias("source"), urls.edge_arrow(F.col("type")).alias("arrow"),
        urls.edge_node(F.col("target")).alias("target"))


def service_table(services: DataFrame, endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """Microservices with probability, communication and the counts of endpoints and calls."""
    def counted(items, name):
        return items.groupBy(*PROJECT).agg(F.count("*").alias(name))
    return (services.where("is_microservice")
            .join(counted(endpoints, "endpoint_count"), PROJECT, "left")
            .join(counted(calls, "call_count"), PROJECT, "left")
            .select(*PROJECT, "name", "project_type", "primary_language", "microservice_probability",
                    "primary_communication",
                    F.coalesce("endpoint_count", F.lit(0)).alias("endpoint_count"),
                    F.coalesce("call_count", F.lit(0)).alias("call_count")))
