"""Detection dictionaries as tables and as parameters.

A dictionary is small by nature (it is written by people), lives on the driver as plain rows
and is turned into literals or a broadcast table.  ``MAX_PATTERNS`` guards that assumption.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import dictionaries as D
from ..functions.literals import sql_string

PATTERNS_SCHEMA = "family string, name string, kind string, pattern string, weight10 int, ord int"
MAX_PATTERNS = 50_000


@dataclass(frozen=True)
class Patterns:
    """Rows (family, name, kind, pattern, weight10, ord); ``ord`` is the position of the name in
    its family and breaks ties."""
    rows: tuple = field(default_factory=tuple)

    def __post_init__(self):
        if len(self.rows) > MAX_PATTERNS:
            raise ValueError(f"{len(self.rows)} patterns: a dictionary may have {MAX_PATTERNS}")
        if any(not 0 <= r[5] < MAX_PATTERNS for r in self.rows):
            raise ValueError(f"ord must be between 0 and {MAX_PATTERNS}")
        weights: dict = {}
        for r in self.rows:
            if weights.setdefault((r[0], r[1]), (r[4], r[5])) != (r[4], r[5]):
                raise ValueError(f"{r[0]} {r[1]!r} has two weights or positions")

    def literals(self, kind: str, *families: str) -> list[str]:
        """Distinct patterns of one kind: each is searched once, whoever shares it."""
        return list(dict.fromkeys(r[3] for r in self.rows
                                  if r[2] == kind and (not families or r[0] in families)))

    def names(self, family: str) -> list[str]:
        """Entries of a family by ``ord``; a position no row has is empty."""
        by_ord = {r[5]: r[1] for r in self.rows if r[0] == family}
        return [by_ord.get(n, "") for n in range(max(by_ord, default=-1) + 1)]

    def table(self, spark: SparkSession) -> DataFrame:
        """All rows.  Inline values: Spark knows the size and needs no job to read them."""
        return _inline(spark, self.rows, "family, name, kind, pattern, weight10, ord")

    def entries(self, spark: SparkSession) -> DataFrame:
        """(family, name, weight10, ord): one row per dictionary entry."""
        rows = dict.fromkeys((r[0], r[1], r[4], r[5]) for r in self.rows)
        return _inline(spark, rows, "family, name, weight10, ord")


def _inline(spark: SparkSession, rows, columns: str) -> DataFrame:
    values = ", ".join("(" + ", ".join(sql_string(v) if isinstance(v, str) else str(v) for v in r) + ")"
                       for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def family(name: str, *groups: dict, package_dependencies: dict | None = None) -> list[tuple]:
    """Rows of one family from dictionaries; a later group replaces the same name of an earlier
    one but keeps its position."""
    merged: dict = {}
    for group in groups:
        merged.update(group)
    rows = []
    for ord_, (entry, spec) in enumerate(merged.items()):
        tenths = round(spec.get("weight", 0.5) * 10)
        kinds = {"file": spec.get("files", []), "content": spec.get("content", []),
                 "import": spec.get("imports", []),
                 "dependency": (package_dependencies or {}).get(entry, [])}
        rows += [(name, entry, kind, pattern, tenths, ord_)
                 for kind, patterns in kinds.items() for pattern in patterns]
    return rows


def default_patterns(package_dependencies: dict | None = None) -> Patterns:
    """The built-in dictionaries.  ``package_dependencies`` (framework -> package names) adds
    hits on package manifests; there are none by default."""
    return Patterns(tuple(
        family("framework", *D.FRAMEWORK_GROUPS, package_dependencies=package_dependencies)
        + family("microservice", D.MICROSERVICE)
        + family("communication", D.COMMUNICATION)))


def load_patterns(spark: SparkSession, path: str | None = None) -> Patterns:
    """The built-in dictionaries, or a user's table of the same shape."""
    if path is None:
        return default_patterns()
    table = spark.read.schema(PATTERNS_SCHEMA).parquet(path)
    return Patterns(tuple(tuple(r) for r in table.limit(MAX_PATTERNS + 1).toLocalIterator()))
