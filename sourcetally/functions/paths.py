"""Expressions over file paths.  A path is relative and starts with its root's name."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import dictionaries as D


def quote(text: str) -> str:
    """Escape a literal for a Java expression."""
    return re.sub(r"([^\w/ ])", r"\\\1", text)


def glob_regex(pattern: str) -> str:
    """Expression (unanchored) for a shell glob; ``*`` and ``?`` cross directories."""
    out, rest = "", pattern
    while rest:
        bracket = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if bracket:
            negate, members = bracket.groups()
            members = re.sub(r"([\\\[\]&~^])", r"\\\1", members)
            out += f"[{'^' if negate else ''}{members}]"
            rest = rest[bracket.end():]
        else:
            out += {"*": r"[\s\S]*", "?": r"[\s\S]"}.get(rest[0]) or quote(rest[0])
            rest = rest[1:]
    return out


def glob_search(pattern: str, inside: bool = False) -> str:
    """Expression whose search finds what the glob matches as a whole (``inside``: as a part).

    Stars at the ends become missing anchors: a search for a suffix is cheap, a leading ``.*``
    would be tried, and undone, at every position.
    """
    core = pattern if "[" in pattern else pattern.strip("*")
    stripped = core != pattern
    start = "" if inside or (stripped and pattern.startswith("*")) else r"\A"
    end = "" if inside or (stripped and pattern.endswith("*")) else r"\z"
    return start + glob_regex(core) + end


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def any_of(expressions) -> str:
    return "|".join(expressions)


def contains_any(column: Column, terms) -> Column:
    """True if the column contains one of the literals: one compiled expression, so the
    stage stays small enough to be compiled whatever the length of the list."""
    return column.rlike(any_of(quote(t) for t in terms)) if terms else F.lit(False)


def ends_with_any(column: Column, suffixes) -> Column:
    return column.rlike(f"(?:{any_of(quote(s) for s in suffixes)})\\z")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; empty when there is none or the name starts with it."""
    return F.lower(F.regexp_extract(name, r"[^./][^/]*(\.[^./]*)\z", 1))


def language(name: Column) -> Column:
    """Language bucket of a file name (case-sensitive), null outside the six buckets."""
    chain = F
    for lang, suffixes in D.LANGUAGES.items():
        chain = chain.when(ends_with_any(name, suffixes), F.lit(lang))
    return chain


def is_key_file(name: Column, path: Column) -> Column:
    """Listed name, glob on the name, or a listed name anywhere in the path."""
    globs = [p for p in D.KEY_FILES if is_glob(p)]
    return contains_any(path, D.KEY_FILES) | name.rlike(any_of(map(glob_search, globs)))


def is_media(name: Column) -> Column:
    return ends_with_any(name, D.MEDIA_SUFFIXES)


def is_important(name: Column, key_file: Column) -> Column:
    return key_file | ends_with_any(name, D.IMPORTANT_SUFFIXES)


class IgnoreRules:
    """A list of ignore patterns compiled to three expressions.

    ``match='substring'``: a pattern hits when it occurs anywhere in the path, or as a glob
    on the base name or on the whole path.  ``match='segment'``: only whole path segments
    (or globs on them) count.  Names starting with a dot are ignored unless
    ``include_hidden``.
    """

    def __init__(self, patterns=None, match="substring", include_hidden=False, extra=()):
        if match not in ("substring", "segment"):
            raise ValueError(f"match must be 'substring' or 'segment', not {match!r}")
        self.patterns = list(patterns or D.DEFAULT_IGNORE) + list(extra)
        self.substrings = self.patterns if match == "substring" else []
        globs = [p for p in self.patterns if match == "segment" or is_glob(p)]
        self.name_regex = any_of(([] if include_hidden else [r"\A\."]) + [glob_search(p) for p in globs])
        # A glob of the form *text (no slash) hits a path exactly when it hits the base name.
        self.path_regex = any_of(
            glob_search(p) for p in globs if match == "substring"
            and ("/" in p or not p.startswith("*") or is_glob(p[1:])))

    def name_or_glob_hit(self, name: Column, path: Column) -> Column:
        """Hidden or glob hit of one directory or file: what its own name decides."""
        hit = name.rlike(self.name_regex) if self.name_regex else F.lit(False)
        return hit | path.rlike(self.path_regex) if self.path_regex else hit

    def hit(self, path: Column) -> Column:
        """True if the file or directory at ``path`` is ignored on its own."""
        return contains_any(path, self.substrings) | self.name_or_glob_hit(file_name(path), path)


def prefix(segments: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(segments, 1, n), "/")


def owning_projects(path: Column, rules: IgnoreRules, max_depth: int) -> Column:
    """Projects a kept file belongs to: the ancestor directories at depth 0..max_depth that
    are not ignored themselves and have no ignored directory between them and the file.

    A substring hit on a directory is also one on the file, so only names and globs are left
    to test; the file belongs to every ancestor below the deepest directory they hit.  The root
    was asked for by name and is not tested.
    """
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    below = F.coalesce(F.array_max(F.transform(
        dirs, lambda d, i: F.when((i > 0) & rules.name_or_glob_hit(d, prefix(dirs, i + 1)), i + 1))), F.lit(0))
    last = F.least(F.size(dirs), F.lit(max_depth + 1))
    return F.when(below < last,
                  F.transform(F.sequence(below + 1, last), lambda n: prefix(dirs, n))
                  ).otherwise(F.array().cast("array<string>"))
