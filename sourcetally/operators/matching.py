"""Matching of dictionary patterns in texts, by column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text
from ..functions.literals import no_strings, sql_array, sql_string, string_array

#: Characters of an anchor; characters of a text above which its grams are not held at once.
GRAM, INDEXED = 3, 1_000_000
#: Letters from frequent to rare; it decides how fast a search is, never what is found.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"


def _rarity(gram: str) -> tuple[float, ...]:
    return tuple(1 + LETTERS.index(c) / 8 if c in LETTERS else 2 if c in " .," else 4 for c in gram)


def anchors(literals: list[str]) -> dict[str, list[str]]:
    """Literals by anchor, the piece of GRAM characters with the rarest first one, as most places of a text
    are passed over for theirs.  A literal can only be in a text that holds its anchor."""
    found: dict[str, list[str]] = {}
    for literal in literals:
        pieces = [literal[a:a + GRAM] for a in range(len(literal) - GRAM + 1)]
        found.setdefault(max(pieces, key=lambda p: (_rarity(p), p)), []).append(literal)
    return found


def gram_pattern(grams: list[str]) -> str:
    """A regular expression that matches the empty string before each place of a gram whose characters
    could be an anchor's, each at its position; the gram is its group."""
    sets = ("".join(f"\\x{{{ord(c):x}}}" for c in sorted({g[k] for g in grams})) for k in range(GRAM))
    return "(?=(" + "".join(f"[{s}]" for s in sets) + "))"


def indexed_matches(content: Column, literals: list[str]) -> Column:
    """Literals that occur in the text: its grams are read off once, those that are anchors lead to
    the few literals that can occur, and these are searched.  Literals shorter than an anchor are
    searched in any case."""
    by_anchor = anchors([p for p in literals if len(p) >= GRAM])
    short = [p for p in literals if len(p) < GRAM]
    parts = [text.literal_matches(content, short)] if short else []
    if by_anchor:
        held = F.array_intersect(F.regexp_extract_all(content, F.lit(gram_pattern(list(by_anchor))), F.lit(1)), string_array(by_anchor))
        owned = F.expr("map(" + ", ".join(f"{sql_string(a)}, {sql_array(owned)}" for a, owned in by_anchor.items()) + ")")
        possible = F.flatten(F.transform(held, lambda a: F.element_at(owned, a)))
        parts.append(F.filter(possible, lambda p: F.contains(content, p)))
    return F.coalesce(F.concat(*parts), no_strings()) if parts else no_strings()


def content_matches(content: Column, literals: list[str], engine: str = "indexed") -> Column:
    """Array of the literals that occur in a text, each once; empty for a null text.

    Both plans are exact and stay in the JVM.  ``plain`` searches literal by literal, so its cost per
    byte grows with the dictionary.  ``indexed`` reads a text once for all literals and searches those
    whose anchor it holds (figures in README); a text of more than INDEXED characters, whose grams
    would take much memory, is searched plainly.
    """
    if engine not in ("indexed", "plain"):
        raise ValueError(f"engine must be 'indexed' or 'plain', not {engine!r}")
    literals = list(dict.fromkeys(literals))
    plain = F.coalesce(text.literal_matches(content, literals), no_strings())
    if engine == "plain":
        return plain
    return F.when(F.length(content) > INDEXED, plain).otherwise(indexed_matches(content, literals))
