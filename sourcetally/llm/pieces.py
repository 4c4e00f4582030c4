"""Encoding by a Viterbi search over a double-array trie of scored pieces, and decoding."""

from __future__ import annotations

import functools
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcetally.llm.arrow import Remembered, gathered, text_slices

MARK = "▁"
#: Units up to so many bytes are searched side by side, longer ones one at a time.
SHORT, SIDE = 48, 1 << 16
UNIT = re.compile(" +[^ ]*")


class Trie:
    """A double-array trie over byte strings: from state s, byte c leads to base[s] + c + 1 if check
    there is s.  value has the number of the string that ends in a state, or -1."""

    def __init__(self, strings: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for string, number in strings.items():
            node = 0
            for byte in string:
                if byte not in tree[node]:
                    tree[node][byte] = len(tree)
                    tree.append({})
                node = tree[node][byte]
            ends[node] = number
        size = 4 * len(tree) + 2048
        base, check, value = [0] * size, [-1] * size, [-1] * size
        after = list(range(size))                            # of each slot the next one that may be free

        def free(slot: int) -> int:
            end = slot
            while after[end] != end:
                end = after[end]
            while after[slot] != end:
                after[slot], slot = end, after[slot]
            return end

        def take(slot: int, parent: int):
            check[slot], after[slot] = parent, slot + 1

        take(0, 0)
        place, last, queue = {0: 0}, 1, [0]
        for node in queue:
            state, codes = place[node], sorted(c + 1 for c in tree[node])
            value[state] = ends.get(node, -1)
            if not codes:
                continue
            # Single children fill the holes; brothers go where the array is still thin.
            slot = free(codes[0] + 1 if len(codes) == 1 else max(codes[0] + 1, last - 400))
            while any(check[slot - codes[0] + c] != -1 for c in codes[1:]):
                slot = free(slot + 1)
            base[state], last = slot - codes[0], max(last, slot - codes[0] + codes[-1])
            if last + 1024 >= size:
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
                after += range(size, 2 * size)
                size *= 2
            for c in codes:
                take(base[state] + c, state)
                child = tree[node][c - 1]
                place[child] = base[state] + c
                queue.append(child)
        # Room past the end, so that a step from any state stays inside the arrays.
        self.base, self.check, self.value = (np.array(x + [fill] * 300, np.int64) for x, fill in ((base, 0), (check, -1), (value, -1)))
        self.depth = max(map(len, strings), default=0)


class Pieces:
    """A vocabulary with log scores, a piece for each byte, and white space shown as MARK."""

    def __init__(self, names: list[str], scores: list[float], byte_ids: list[int], unknown: int, skipped: frozenset[int] = frozenset()):
        self.names, apart = names, {*skipped, *byte_ids, unknown}
        self.plain = plain = [i for i in range(len(names)) if i not in apart]
        self.trie = Trie({names[i].encode(): i for i in reversed(plain) if names[i]})
        self.scores = np.array(scores, np.float64)
        self.apart = not any(MARK in names[i].lstrip(MARK) for i in plain)
        self.lost = float(min(scores[i] for i in plain)) - 10 if plain else -10.0
        self.byte_ids, self.unknown = byte_ids, unknown
        self.texts = [b"" if i in skipped else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.texts[unknown] = " ⁇ ".encode()
        for byte, i in enumerate(byte_ids):
            self.texts[i] = bytes([byte])

    @classmethod
    def of_model(cls, path: str) -> Pieces:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        byte_ids = [i for i in range(count) if model.is_byte(i)]
        skipped = frozenset(i for i in range(count) if model.is_control(i) or model.is_unused(i))
        return cls([model.id_to_piece(i) for i in range(count)], [model.get_score(i) for i in range(count)], byte_ids, model.unk_id(), skipped)

    # -- search ---------------------------------------------------------------------------------

    def _spelled(self, raw: bytes) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]

    def _one(self, raw: bytes) -> tuple[list[int], float]:
        """Best segmentation of one unit: highest sum of scores; of equal ones that whose last piece
        is longest, and so on towards the front."""
        base, check, value = self.lists
        scores, count = self.score_list, len(raw)
        best, origin, piece = array("d", [-np.inf]) * (count + 1), array("q", [0]) * (count + 1), array("i", [-1]) * (count + 1)
        best[0] = 0.0
        for i in range(count):
            if best[i] == -np.inf:
                continue
            width = _width(raw[i])
            state, covered = 0, False
            for j in range(i, count):
                after = base[state] + raw[j] + 1
                if check[after] != state:
                    break
                state = after
                if value[state] >= 0:
                    covered = covered or j + 1 - i == width
                    if best[i] + scores[value[state]] > best[j + 1]:
                        best[j + 1], origin[j + 1], piece[j + 1] = best[i] + scores[value[state]], i, value[state]
            end = min(count, i + width)
            if not covered and best[i] + self.lost > best[end]:
                best[end], origin[end], piece[end] = best[i] + self.lost, i, -1
        ids, at = array("i"), count                          # read from the end, turned round at last
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(reversed(self._spelled(raw[origin[at]:at])))
            at = origin[at]
        ids.reverse()
        return ids.tolist(), best[count]

    def _side_by_side(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many short units at once: one step of the trie moves all of them."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        sizes = np.array([len(u) for u in units])
        width, count = int(sizes.max()), len(units)
        text = np.zeros((width + 1, count), np.int64)
        flat = np.frombuffer(b"".join(units), np.uint8)
        owner = np.repeat(np.arange(count), sizes)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = flat
        best = np.full((width + 5, count), -np.inf)
        origin, piece = np.zeros((width + 5, count), np.int16), np.full((width + 5, count), -1, np.int32)
        best[0] = 0
        for i in range(width):
            rows = np.flatnonzero((best[i] > -np.inf) & (sizes > i))
            if not len(rows):
                continue
            begun, first = best[i, rows], text[i, rows]
            wide = WIDTHS[first]
            covered = np.zeros(len(rows), bool)
            alive, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for j in range(i, min(width, i + self.trie.depth)):
                after = base[state] + text[j, rows[alive]] + 1
                on = (check[after] == state) & (sizes[rows[alive]] > j)
                alive, state = alive[on], after[on]
                if not len(alive):
                    break
                found = value[state]
                named = found >= 0
                who, number = alive[named], found[named]
                covered[who[wide[who] == j + 1 - i]] = True
                sums, where = begun[who] + self.scores[number], rows[who]
                better = sums > best[j + 1, where]
                where = where[better]
                best[j + 1, where], origin[j + 1, where], piece[j + 1, where] = sums[better], i, number[better]
            who = np.flatnonzero(~covered)
            if len(who):
                where = rows[who]
                end = np.minimum(sizes[where], i + wide[who])
                sums = begun[who] + self.lost
                better = sums > best[end, where]
                where, end = where[better], end[better]
                best[end, where], origin[end, where], piece[end, where] = sums[better], i, -1
        return *self._back(units, sizes, origin, piece), best[sizes, np.arange(count)]

    def _back(self, units, sizes, origin, piece) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit and all ids, along the best paths, read from the ends of all
        units at once."""
        at, who, steps = sizes.copy(), np.flatnonzero(sizes), []
        while len(who):
            begin = origin[at[who], who]
            steps.append((who, piece[at[who], who], begin, at[who]))
            at[who] = begin
            who = who[begin > 0]
        who, number, begin, end = (np.concatenate(x) for x in zip(*reversed(steps)))
        order = np.argsort(who, kind="stable")
        who, number, begin, end = who[order], number[order], begin[order], end[order]
        lost = np.flatnonzero(number < 0)
        spelled = [self._spelled(units[who[k]][begin[k]:end[k]]) for k in lost.tolist()]
        width = np.ones(len(who), np.int64)
        width[lost] = [len(x) for x in spelled]
        flat = np.repeat(number, width)
        first = np.cumsum(width) - width
        for k, ids in zip(lost.tolist(), spelled):
            flat[first[k]:first[k] + len(ids)] = ids
        return np.bincount(who, width, len(units)).astype(np.int64), flat

    @functools.cached_property
    def lists(self):
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()

    @functools.cached_property
    def score_list(self):
        return self.scores.tolist()

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each unit, all ids in order, and the score of each unit."""
        raw = [u.replace(" ", MARK).encode() for u in units]
        length = np.array([len(r) for r in raw], np.int64)
        starts, sizes, scores = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), np.zeros(len(raw))
        parts, held = [np.zeros(0, np.int32)], 0

        def add(rows, counts, ids, sums):
            nonlocal held
            starts[rows], sizes[rows], scores[rows] = held + np.cumsum(counts) - counts, counts, sums
            parts.append(ids)
            held += len(ids)

        order = np.argsort(length, kind="stable")
        short = order[length[order] <= SHORT]
        for at in range(0, len(short), SIDE):
            rows = short[at:at + SIDE]
            add(rows, *self._side_by_side([raw[i] for i in rows.tolist()]))
        for i in order[len(short):].tolist():
            ids, score = self._one(raw[i])
            add(np.array([i]), np.array([len(ids)]), np.array(ids, np.int32), score)
        return sizes, gathered(np.concatenate(parts), starts, sizes)[0], scores

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids and the sum of log scores of each text.  A text is marked at its start and falls into
        units, each a run of spaces and what follows up to the next one.  No piece spans two units,
        so each distinct unit of the batch is searched once; a vocabulary where one could takes each
        text as one unit."""
        found = [[] if not t else UNIT.findall(" " + t) if self.apart else [" " + t] for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        coded = pa.array([u for f in found for u in f], pa.large_string()).dictionary_encode()
        del found
        codes = coded.indices.to_numpy()
        starts, sizes, score, flat = self.units(coded.dictionary.to_pylist(), codes)
        ids, ends = gathered(flat, starts[codes], sizes[codes])
        cuts = np.concatenate([[0], ends])[bounds].tolist()
        each = score[codes]
        sums = np.array([float(each[a:b].sum()) for a, b in zip(bounds.tolist(), bounds[1:].tolist())])
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])], sums

    @functools.cached_property
    def units(self) -> Remembered:
        return Remembered(self.encode_units)

    def decode(self, ids: list[int]) -> str:
        """Pieces in a row, markers as spaces, runs of byte pieces as UTF-8 (ill-formed ones become
        U+FFFD), without the marker of the start.  Numbers outside the vocabulary are unknown pieces."""
        raw = b"".join([self.texts[i] if 0 <= i < len(self.texts) else self.texts[self.unknown] for i in ids])
        return raw.removeprefix(b" ").decode(errors="replace")


def _width(byte: int) -> int:
    """Bytes of the character that starts with ``byte``."""
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


WIDTHS = np.array([_width(b) for b in range(256)])


@functools.cache
def vocabulary(path: str) -> Pieces:
    """The pieces of a model file, read once per Python worker."""
    return Pieces.of_model(path)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus ids array<int> and log_score double.

    Pieces and scores come from the model file at ``path``.  A null or empty text has no ids and
    score 0.  Characters without a piece are spelled in byte pieces.  Columns of those two names are
    replaced, all others stay; repeated rows stay; no shuffle.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "log_score")]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = vocabulary(path)
        for batch in batches:
            sizes, parts, sums = [0], [np.zeros(0, np.int32)], [np.zeros(0)]
            for texts in text_slices(batch):
                ids, scores = pieces.encode([t or "" for t in texts.to_pylist()])
                sizes += [len(x) for x in ids]
                parts.append(np.concatenate([parts[0], *ids]))
                sums.append(scores)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(parts), pa.int32()))
            yield pa.StructArray.from_arrays([lists, pa.array(np.concatenate(sums))], ["ids", "log_score"])

    found = F.arrow_udf(run, "ids array<int>, log_score double")(F.col(f"`{text_col}`"))
    return docs.select(*kept, found.alias("_found")).select(*kept, "_found.ids", "_found.log_score")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` plus the text that ``ids_col`` stands for, as ``text_col``; null ids give an empty text."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = vocabulary(path)
        for batch in batches:
            yield pa.array([pieces.decode(x.values.to_pylist() if x.is_valid else []) for x in batch], pa.string())

    return rows.select(*kept, F.arrow_udf(run, "string")(F.col(f"`{ids_col}`")).alias(text_col))
