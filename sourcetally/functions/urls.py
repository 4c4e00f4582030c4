"""Expressions over endpoint paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import dictionaries as D
from .paths import any_of, contains_any


def normalise_endpoint(path: Column) -> Column:
    return F.when(path.startswith("/") | path.startswith("http"), path).otherwise(
        F.concat(F.lit("/"), path))


def endpoint_type(path: Column) -> Column:
    lowered, chain = F.lower(path), F
    for label, terms in D.ENDPOINT_TYPES.items():
        chain = chain.when(contains_any(lowered, terms), F.lit(label))
    return chain.when(path.rlike(f"/{D.W}"), F.lit("resource")).otherwise(F.lit("other"))


def is_service_url(url: Column) -> Column:
    """Skip terms rule a URL out; then an indicator or a path form rules it in."""
    lowered = F.lower(url)
    return ~contains_any(lowered, D.URL_SKIP_TERMS) & (
        contains_any(lowered, D.URL_SERVICE_TERMS) | lowered.rlike(any_of(D.URL_SERVICE_FORMS)))


def wildcard_params(path: Column) -> Column:
    """Path parameters, <..> or {..}, as ``*``."""
    return F.regexp_replace(path, "[<{][^>}]+[>}]", "*")


def service_spellings(name: Column, path: Column) -> Column:
    """The eight spellings, in order, under which an endpoint of a service may be called."""
    clean = wildcard_params(path)
    bare = F.regexp_replace(clean, r"\A/", "")
    hosts = [part for host in ("localhost", "127.0.0.1")
             for part in (F.concat(F.lit(host + "/"), name, clean), F.concat(F.lit(host), clean))]
    return F.array(F.concat(name, clean), F.concat(F.lower(name), clean), clean, bare, *hosts)


def url_keys(url: Column) -> Column:
    """Ordered look-up keys of a URL: lower-cased segments each with its hyphen and underscore
    variants, then the host, then the labels of the host."""
    def variants(part):
        return F.array(part, F.translate(part, "-", ""), F.translate(part, "_", ""),
                       F.translate(part, "-", "_"), F.translate(part, "_", "-"))

    segments = F.flatten(F.transform(F.split(F.lower(url), "/"), variants))
    host = F.regexp_extract(url, r"\A[\s\S]*?://([^/:]*)", 1)
    hosts = F.when(F.contains(url, F.lit("://")), F.concat(F.array(host), F.split(host, r"\."))
                   ).otherwise(F.array().cast("array<string>"))
    return F.concat(segments, hosts)


def relationship_type(communication: Column, url: Column) -> Column:
    """Label by the caller's communication style, else by clues in the URL."""
    chain, lowered = F, F.lower(url)
    for style, label in D.RELATIONSHIP_LABELS.items():
        chain = chain.when(communication == style, F.lit(label))
    return (chain
            .when(F.contains(lowered, F.lit("graphql")), F.lit("GraphQL"))
            .when(F.contains(lowered, F.lit("grpc://")), F.lit("gRPC"))
            .when(contains_any(lowered, ["soap", "wsdl"]), F.lit("SOAP"))
            .when(contains_any(lowered, ["ws://", "wss://"]), F.lit("WebSocket"))
            .when(lowered.startswith("http://") | lowered.startswith("https://"), F.lit("REST"))
            .otherwise(F.lit("HTTP")))


def edge_node(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "_")


def edge_arrow(label: Column) -> Column:
    chain = F
    for name, arrow in D.EDGE_ARROWS.items():
        chain = chain.when(label == name, F.lit(arrow))
    return chain.otherwise(F.lit("-->"))
