"""Expressions over the text of one file.

Every regular expression is guarded by a literal that each of its matches contains, so
most files cost a substring search instead of a regular expression scan.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import dictionaries as D
from . import urls
from .literals import no_strings, sql_array, sql_string, string_array
from .paths import glob_search, is_glob


def decode_text(raw: Column) -> Column:
    """UTF-8 text of raw bytes with the undecodable bytes dropped.  U+FFFD that the bytes themselves
    spell stays: it is written otherwise, by way of U+FFFE, while the ones that stand for bad bytes
    go.  Both are whole characters wherever their bytes occur, so bytes can be replaced."""
    text = raw.cast("string")
    given, other = F.lit("\ufffd"), "\ufffe"
    hidden = F.replace(F.replace(text, F.lit(other), F.lit(other + "0")), given, F.lit(other + "1"))
    clean = F.replace(F.make_valid_utf8(hidden), given, F.lit(""))
    shown = F.replace(F.replace(clean, F.lit(other + "1"), given), F.lit(other + "0"), F.lit(other))
    return F.when(F.is_valid_utf8(text), text).otherwise(shown)


def has_main(content: Column) -> Column:
    return F.contains(content, F.lit("__main__")) & content.rlike(D.MAIN_GUARD)


def imports(content: Column) -> Column:
    """Distinct module names of the import statements in a Python text."""
    found = F.array_distinct(F.concat(*[
        F.regexp_extract_all(content, F.lit(form), F.lit(1)) for form in D.IMPORT_FORMS]))
    return F.when(F.contains(content, F.lit("import")), found).otherwise(no_strings())


def dotted_prefixes(module: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]"""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, 1, n), "."))


def matched_modules(imported: Column, listed: list[str]) -> Column:
    """Listed module names that equal an import or one of its parents."""
    return F.array_intersect(F.flatten(F.transform(imported, dotted_prefixes)), string_array(listed))


def _matches(column: str, guard: str, form: str, group: int) -> str:
    """SQL: captured group of every match of one expression."""
    return (f"if(contains({column}, {sql_string(guard)}), "
            f"regexp_extract_all({column}, {sql_string(form)}, {group}), {sql_array([])})")


def _pairs(column: str, guard: str, form: str, first: int, second: int) -> str:
    """SQL: structs (m, p) of two groups of every match: the text is read once for the matches,
    which are short, and those are split.  Forms look at nothing outside their match."""
    group = lambda n: f"regexp_extract(x, {sql_string(form)}, {n})"
    return f"transform({_matches(column, guard, form, 0)}, x -> struct({group(first)} AS m, {group(second)} AS p))"


def endpoints(column: str) -> Column:
    """Array of struct(form, nth, method, path, framework, type) of the endpoints in a text."""
    def found(number, framework, guard, form, method_group, path_group):
        if method_group:
            pairs = _pairs(column, guard, form, method_group, path_group)
        else:
            pairs = f"transform({_matches(column, guard, form, path_group)}, p -> struct('unknown' AS m, p AS p))"
        return (f"transform({pairs}, (x, i) -> struct({number} AS form, i AS nth, upper(x.m) AS method, "
                f"x.p AS path, {sql_string(framework)} AS framework))")

    raw = F.expr("concat(" + ", ".join(found(n, *f) for n, f in enumerate(D.ENDPOINT_FORMS)) + ")")

    def finish(e):
        path = urls.normalise_endpoint(e["path"])
        return F.struct(e["form"].alias("form"), e["nth"].alias("nth"), e["method"].alias("method"),
                        path.alias("path"), e["framework"].alias("framework"),
                        urls.endpoint_type(path).alias("type"))

    return F.transform(raw, finish)


def service_calls(column: str) -> Column:
    """Array of struct(form, nth, url, language) of the likely service calls in a text."""
    def found(number, language, guard, form, groups, prefix):
        if len(groups) == 2:
            texts = f"transform({_pairs(column, guard, form, *groups)}, x -> x.m || x.p)"
        else:
            texts = _matches(column, guard, form, groups[0])
        return (f"transform({texts}, (u, i) -> struct({number} AS form, i AS nth, "
                f"{sql_string(prefix)} || u AS url, {sql_string(language)} AS language))")

    raw = F.expr("concat(" + ", ".join(found(n, *f) for n, f in enumerate(D.CALL_FORMS)) + ")")
    return F.filter(raw, lambda c: (c["url"] != "") & urls.is_service_url(c["url"]))


DEPENDENCY_GROUPS = ["dependencies", "devDependencies", "peerDependencies"]


def package_manifest(content: Column) -> Column:
    """Parsed package manifest: one map per dependency group, plus ``bad`` for unparsable text."""
    fields = ", ".join(f"{g} map<string,string>" for g in DEPENDENCY_GROUPS)
    return F.from_json(content, f"struct<{fields}, bad string>",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad",
                        "allowSingleQuotes": "false"})


def dependencies(manifest: str) -> Column:
    """Array of struct(package, grp, pos, version): the groups merged, a later group winning on
    a name."""
    groups = ", ".join(
        f"coalesce(transform(map_entries({manifest}.{field}), (e, i) -> "
        f"struct(e.key AS package, {n} AS grp, i AS pos, e.value AS version)), array())"
        for n, field in enumerate(DEPENDENCY_GROUPS))
    ordered = F.array_sort(F.expr(f"concat({groups})"))
    return F.filter(ordered, lambda e, i: F.coalesce(
        F.get(ordered, i + 1)["package"] != e["package"], F.lit(True)))


def manifest_error(content: Column, manifest: Column) -> Column:
    """Error text of a package manifest, null when it parses."""
    wrapped = F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>",
                          {"allowSingleQuotes": "false"})
    whole = F.coalesce(F.size(wrapped) == 1, F.lit(False))
    is_object = F.ltrim(content).startswith("{")
    bad_group = F.lit(False)
    for g in DEPENDENCY_GROUPS:
        present = F.coalesce(F.array_contains(F.json_object_keys(content), g), F.lit(False))
        bad_group = bad_group | (present & manifest[g].isNull())
    return (F.when(~whole | (is_object & manifest["bad"].isNotNull() & ~bad_group),
                   F.lit("Invalid JSON in package.json"))
            .when(is_object & bad_group, F.lit("Error analyzing file: a dependency group is not an object"))
            .when(F.trim(content).rlike(r"\A[^\[{\"]"),
                  F.lit("Error analyzing file: package.json is not an object")))


def literal_matches(text: Column, literals: list[str]) -> Column:
    """Literals that occur in the text, in list order."""
    return F.filter(string_array(literals), lambda p: F.contains(text, p))


def pattern_matches(path: Column, patterns: list[str]) -> Column:
    """File patterns that occur in the path; a pattern with wildcards may match anywhere in it."""
    found = literal_matches(path, [p for p in patterns if not is_glob(p)])
    globs = [p for p in patterns if is_glob(p)]
    if globs:
        found = F.concat(found, F.array_compact(F.array(*[
            F.when(F.contains(path, F.lit(p)) | path.rlike(glob_search(p, inside=True)), F.lit(p)) for p in globs])))
    return found
