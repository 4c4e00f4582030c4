"""Packing of tokenised documents into sequences of bounded length by a grouping genetic algorithm."""

from __future__ import annotations

import functools
import itertools
import os
import random
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sourcetally.llm.arrow import byte_slices, gathered, merged, whole_texts, words_of
from sourcetally.session import stored

ROOM, BLOCK, END, CALL_WORDS, SLICE, MEMORY = 2048, 8192, 0, 8192, 3 << 20, 250_000
ISLANDS, EPOCHS, GENERATIONS, MEMBERS = 3, 2, 8, 6


# --- pieces -------------------------------------------------------------------------------------

class Tokenizer:
    """The tokenizer at ``path``, word by word.  That is right only if white space is no part of any
    token, which is checked on a few strings, as is what the short cuts below rest on."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")                  # Spark's tasks are the threads; more cost memory
        import tokenizers
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        marks = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.mark, self.marker = marks[0] if marks else (-1, "")
        for left, right in (("It's", "we'll"), ("a", "'s"), ("1", "2"), ("<|end", "oftext|>"), ("é!", "́x"), ("Σ", "Σ")):
            for space in (" ", "\n", "\t\r ", "\x0b", "\x0c"):
                if self.ids(left + space + right) != self.ids(left) + self.ids(right):
                    raise ValueError("this tokenizer does not encode words independently of white space")
        self.folds = all(self.ids(a) == self.ids(b) + self.ids(c) for a, b, c in (("Word,", "word", ","), ("THE...", "the", "..."), ("x.,", "x", ".,")))
        # Each run of letters is encoded by itself, and with such a suffix its last token alone shows where it ends.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known, self.starts, self.sizes, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of each word.  Many go in one call with a special token between them, which parts them
        and whose id shows where; words that might hold a special token go alone."""
        out: list[list[int]] = [[]] * len(words)
        alone = [i for i, w in enumerate(words) if self.mark < 0 or "<" in w or ">" in w or "|" in w]
        apart = set(alone)
        rest = [i for i in range(len(words)) if i not in apart]
        for at in range(0, len(alone), CALL_WORDS):
            for i, e in zip(alone[at:at + CALL_WORDS], self.tokenizer.encode_batch_fast([words[i] for i in alone[at:at + CALL_WORDS]], add_special_tokens=False)):
                out[i] = e.ids
        for at in range(0, len(rest), 64 * 64):
            groups = [rest[k:k + 64] for k in range(at, min(len(rest), at + 64 * 64), 64)]
            calls = self.tokenizer.encode_batch_fast([self.marker.join([words[i] for i in g]) for g in groups], add_special_tokens=False)
            for group, call in zip(groups, calls):
                ids = call.ids
                begin = 0
                for i in group[:-1]:
                    end = ids.index(self.mark, begin)
                    out[i] = ids[begin:end]
                    begin = end + 1
                out[group[-1]] = ids[begin:]
        return out

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, flat ids) of words.  Words of letters alone go many to a call, with spaces between
        them, and are told apart by their last tokens; a call whose numbers do not agree counts for nothing, and
        its words take the other way, as all others do."""
        out, texts = [], words.to_pylist()
        starts, sizes, held = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        letters = pc.match_substring_regex(words, r"^\p{L}+$").to_numpy(zero_copy_only=False) if self.last.any() else np.zeros(len(words), bool)
        simple, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
        groups = [simple[at:at + CALL_WORDS // 16] for at in range(0, len(simple), CALL_WORDS // 16)]
        for at in range(0, len(groups), 16):
            calls = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g.tolist()]) for g in groups[at:at + 16]], add_special_tokens=False)
            for group, call in zip(groups[at:at + 16], calls):
                ids = np.array(call.ids, np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(group) or ends[-1] != len(ids):
                    rest = np.append(rest, group)
                    continue
                sizes[group] = np.diff(ends, prepend=0)
                starts[group] = held + ends - sizes[group]
                out.append(ids)
                held += len(ids)
        others = self.encoded([texts[i] for i in rest.tolist()])
        sizes[rest] = [len(ids) for ids in others]
        starts[rest] = held + np.cumsum(sizes[rest]) - sizes[rest]
        out.append(np.fromiter(itertools.chain.from_iterable(others), np.uint32, int(sizes[rest].sum())))
        return starts, sizes, np.concatenate(out)

    def words(self, words: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes) of the ids of distinct ``words``, and the ids that the starts point into.  Words that
        ``codes`` names more than once are remembered for the life of the worker, the most frequent
        first, MEMORY of them at most."""
        row = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(row < 0)
        starts, sizes, flat = self.find(words.take(pa.array(missing)))
        before, old = len(self.flat), row >= 0
        all_starts, all_sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        all_starts[old], all_sizes[old] = self.starts[row[old]], self.sizes[row[old]]
        all_starts[missing], all_sizes[missing] = starts + before, sizes
        whole = np.concatenate([self.flat, flat])
        free = MEMORY - len(self.known)
        if free > 0 and len(missing):
            times = np.bincount(codes, minlength=len(words))[missing]
            often = np.argsort(-times, kind="stable")[:min(free, int((times > 1).sum()))]
            kept, ends = gathered(flat, starts[often], sizes[often])
            self.known = pa.concat_arrays([self.known, words.take(pa.array(missing[often]))])
            self.starts, self.sizes = np.append(self.starts, before + ends - sizes[often]), np.append(self.sizes, sizes[often])
            self.flat = np.concatenate([self.flat, kept])
        return all_starts, all_sizes, whole

    def plain(self, given: pa.Array) -> pa.Array:
        """The texts with fewer distinct words and the same ids: A-Z as a-z, and a space between a
        letter and the marks that end a word, which are tokens of their own.  Texts that might hold
        a special token stay as they are."""
        if not self.folds:
            return given
        apart = pc.replace_substring_regex(pc.ascii_lower(given), r"([a-z])([.,!?;:]+)([ \t\r\n]|$)", r"\1 \2\3")
        return pc.if_else(pc.match_substring(given, "<|"), given, apart)


@functools.cache
def word_tokenizer(path: str) -> Tokenizer:
    """The tokenizer at ``path``, read once per Python worker."""
    return Tokenizer(path)


def token_stream(tokenizer: Tokenizer, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, each followed by ``end``, and where each text begins, the length of the
    whole last.  Null texts are empty ones."""
    codes, words, counts = words_of(tokenizer.plain(whole_texts(texts)))
    starts, sizes, flat = tokenizer.words(words, codes)
    closed = np.insert(codes, np.cumsum(counts), len(words)) if len(codes) else np.full(len(counts), len(words))
    ids, ends = gathered(np.append(flat, np.uint32(end)), np.append(starts, len(flat))[closed], np.append(sizes, 1)[closed])
    return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts + 1)])]


def token_ids(tokenizer: Tokenizer, texts: list[str], end: int = END) -> list[np.ndarray]:
    """Token ids of each text, ``end`` last."""
    ids, cuts = token_stream(tokenizer, pa.array(texts, pa.large_string()), end)
    return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM) -> DataFrame:
    """(id, piece, start, length, ids_crc32): tokens of each text and the end token, cut every
    ``room`` tokens.  A null or empty text is one piece that holds the end token alone."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("piece", IntegerType()), StructField("start", LongType()),
                         StructField("length", LongType()), StructField("ids_crc32", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in merged(batches, "text", SLICE):
            for part in byte_slices(batch, "text", SLICE):
                row, piece, length, check = [], [], [], []
                ids, cuts = token_stream(tokenizer, part.column("text"))
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                for i, (begin, close) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                    for n, at in enumerate(range(begin, close, room)):
                        row.append(i)
                        piece.append(n)
                        length.append(min(room, close - at))
                        check.append(crc32(raw[4 * at:4 * min(at + room, close)]))
                numbers = pa.array(piece, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row, pa.int64())), numbers, pc.multiply(pc.cast(numbers, pa.int64()), room),
                     pa.array(length, pa.int64()), pa.array(check, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


# --- the genetic algorithm on one block ------------------------------------------------------------

#: A bin is (load, items); bins are never changed, so packings share those they have in common.
Bin = tuple[int, tuple[int, ...]]
Bins = list[Bin]


def best_fit(items: list[int], sizes: list[int], bins: Bins, room: int) -> Bins:
    """Put each item, in order, where the least room is left over; open a bin where none has room.
    ``waiting`` has a bit for every residual that some bin has, so a search is one shift."""
    by_room: dict[int, list[int]] = {}
    for b, (load, _) in enumerate(bins):
        by_room.setdefault(room - load, []).append(b)
    waiting = sum(1 << left for left in by_room)
    loads, added = [load for load, _ in bins], {}
    for i in items:
        size = sizes[i]
        above = waiting >> size
        if above:
            left = size + (above & -above).bit_length() - 1
            same = by_room[left]
            b = same.pop()
            if not same:
                del by_room[left]
                waiting ^= 1 << left
        else:
            left, b = room, len(loads)
            loads.append(0)
        if b in added:
            added[b].append(i)
        else:
            added[b] = [i]
        loads[b] += size
        left -= size
        if left in by_room:
            by_room[left].append(b)
        else:
            by_room[left] = [b]
            waiting |= 1 << left
    out = list(bins) + [(0, ())] * (len(loads) - len(bins))
    for b, more in added.items():
        out[b] = (loads[b], (*out[b][1], *more))
    return out


def fitness(bins: Bins, room: int) -> tuple[int, float]:
    """Fewer bins are better, then unequal fill: squares favour bins that are full or nearly empty."""
    return len(bins), -sum(load * load for load, _ in bins) / (room * room)


def crossover(giver: Bins, taker: Bins, sizes: list[int], room: int, rng: random.Random) -> Bins:
    """Inject whole well-filled bins of ``giver`` into ``taker``: bins of the taker that share an item
    with them go, and what was only in those is placed by best fit, largest first."""
    ranked = sorted(giver, key=lambda b: -b[0])
    share = rng.uniform(0.05, 0.4)
    chosen = [b for b in ranked[:max(1, 2 * len(ranked) // 3)] if rng.random() < share] or ranked[:1]
    taken = {i for _, held in chosen for i in held}
    kept, displaced = list(chosen), []
    for b in taker:
        if taken.isdisjoint(b[1]):
            kept.append(b)
        else:
            displaced += [i for i in b[1] if i not in taken]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(displaced, sizes, kept, room)


def mutate(bins: Bins, sizes: list[int], room: int, rng: random.Random, share: float = 0.02) -> Bins:
    """Empty the least filled bin, half of those that are not full and a share of the others, and
    place their items again, largest first but for some noise."""
    last = min(range(len(bins)), key=lambda b: bins[b][0])
    gone = {last, *(b for b in range(len(bins)) if rng.random() < (share if bins[b][0] == room else 0.5))}
    items = sorted((i for b in gone for i in bins[b][1]), key=lambda i: -sizes[i] * rng.uniform(0.9, 1.1))
    return best_fit(items, sizes, [b for n, b in enumerate(bins) if n not in gone], room)


def least_bins(sizes: list[int], room: int) -> int:
    """No packing has fewer bins: the sum needs so many, and so do items over half the room."""
    return max(-(-sum(sizes) // room), sum(2 * s > room for s in sizes))


def decreasing(sizes: list[int], room: int) -> Bins:
    return best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, [], room)


def evolve(population: list[Bins], sizes: list[int], room: int, seed: str, generations: int = GENERATIONS, members: int = MEMBERS) -> list[Bins]:
    """The population after some generations, best first; ends early at the least number of bins.
    A population that is too small is filled up with strongly mutated members."""
    rng = random.Random(seed)
    started = len(population)
    population = [*population, *(mutate(population[k % started], sizes, room, rng, 0.15) for k in range(members - started))]
    rate = lambda bins: fitness(bins, room)
    population = sorted(population, key=rate)
    floor = least_bins(sizes, room)
    for _ in range(generations):
        if len(population[0]) <= floor:
            break
        children = []
        for _ in range(members // 2):
            giver, taker = (population[min(rng.randrange(members), rng.randrange(members))] for _ in "gt")
            child = crossover(giver, taker, sizes, room, rng)
            children.append(mutate(child, sizes, room, rng) if rng.random() < 0.6 else child)
        population = sorted([*population, *children], key=rate)[:members]
    return population


# --- blocks and islands in Spark -------------------------------------------------------------------

def _number(bins: Bins, count: int) -> list[int]:
    out = [0] * count
    for b, (_, held) in enumerate(bins):
        for i in held:
            out[i] = b
    return out


def _read(bin_of: list[int], sizes: list[int]) -> Bins:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(bin_of):
        out.setdefault(b, []).append(i)
    return [(sum(sizes[i] for i in held), tuple(held)) for held in out.values()]


def pack(items: DataFrame, room: int = ROOM, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS,
         id_col: str = "id", length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to ``items``, whose lengths lie between 1 and ``room``.

    Items are dealt into blocks of about ``block`` items by a hash of the row's number, so equal rows
    spread; the number of blocks grows with the table, and a block is small enough for one task.  Best fit decreasing opens each block; where it needs more
    bins than the sum of lengths does, the block goes on as ``islands`` populations, and after each
    epoch the best packing of every island migrates to the next one.  The best island's packing
    stays.  Items that fill a sequence get one each.  Repeated rows are items of their own, null ids
    are allowed, other columns stay, an empty table gives an empty result.
    """
    rest = [c for c in items.columns if c not in ("sequence_id", "offset")]
    items = stored(items.select(*rest).withColumn("_row", F.monotonically_increasing_id()), "packing-items")
    blocks = max(1, -(-items.count() // block))
    dealt = items.select(F.struct(*rest).alias("row"), F.col(length_col).cast("long").alias("size"),
                         F.pmod(F.xxhash64("_row", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))
    state = StructType([dealt.schema["row"], StructField("size", LongType()), StructField("block", IntegerType()), StructField("island", IntegerType()),
                        StructField("item", IntegerType()), StructField("bin", IntegerType()), StructField("bins", IntegerType()), StructField("floor", IntegerType())])

    def made(table: pa.Table, block: int, island: int, best: Bins, floor: int) -> pa.Table:
        count = len(table)
        same = lambda x: pa.array(np.full(count, x, np.int32))
        return pa.table([table["row"], table["size"], same(block), same(island), pa.array(np.arange(count, dtype=np.int32)),
                         pa.array(_number(best, count), pa.int32()), same(len(best)), same(floor)], names=state.names)

    def begin(key, table):
        fields = table["row"].combine_chunks().flatten()
        order = pc.sort_indices(pa.table([table["size"], *fields], names=[str(i) for i in range(len(fields) + 1)]),
                                sort_keys=[(str(i), "ascending") for i, f in enumerate([table["size"], *fields]) if not pa.types.is_nested(f.type)])
        table = table.take(order)
        sizes = table["size"].to_pylist()
        return made(table, key[0].as_py(), 0, decreasing(sizes, room), least_bins(sizes, room))

    def go_on(epoch: int):
        def run(key, table):
            number, island = key[0].as_py(), key[1].as_py()
            table = table.sort_by([("native", "descending"), ("item", "ascending")])
            native = table.filter(table["native"])
            count, sizes = len(native), native["size"].to_pylist()
            assigned = table["bin"].to_pylist()
            population = [_read(assigned[at:at + count], sizes) for at in range(0, len(assigned), count)]
            best = evolve(population, sizes, room, f"{number}/{island}/{epoch}")[0]
            return made(native, number, island, best, native["floor"][0].as_py())
        return run

    if epochs < 1:
        raise ValueError("at least one epoch")
    opened = stored(dealt.groupBy("block").applyInArrow(begin, state), "packing-opened")
    done, now = [opened.where("bins <= floor")], opened.where("bins > floor")
    island = F.explode(F.array(*[F.lit(i) for i in range(islands)]))
    now = now.withColumn("island", island)
    for epoch in range(epochs):
        if now.isEmpty():
            break
        settled = now.withColumn("native", F.lit(True))
        if epoch:                                            # the first time all islands start alike
            elite = now.withColumns({"island": ((F.col("island") + 1) % islands).cast("int"), "native": F.lit(False)})
            settled = settled.unionByName(elite)
        after = stored(settled.groupBy("block", "island").applyInArrow(go_on(epoch), state), "packing-epoch")
        least = after.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best"), F.max("floor").alias("floor"))
        ended = least.where((F.col("best.bins") <= F.col("floor")) | F.lit(epoch == epochs - 1)).select("block", F.col("best.island").alias("island"))
        done.append(after.join(ended, ["block", "island"], "left_semi"))
        now = after.join(ended, "block", "left_anti")
    packed = functools.reduce(DataFrame.unionByName, [d.select(*state.names) for d in done])
    place = StructType([dealt.schema["row"], StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def lay(key, table):
        table = table.sort_by([("bin", "ascending"), ("item", "ascending")])
        sizes, bins = table["size"].to_numpy(), table["bin"].to_numpy()
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(bins, bins)
        return pa.table([table["row"], pa.array((np.int64(key[0].as_py()) << 32) + bins), pa.array((before - before[first]).astype(np.int64))], names=place.names)

    return packed.groupBy("block").applyInArrow(lay, place).select("row.*", "sequence_id", "offset")
