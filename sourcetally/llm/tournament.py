"""Packing of token sequences by first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from sourcetally.llm.arrow import byte_slices, merged
from sourcetally.llm.packing import token_stream, word_tokenizer

#: Tokens of a sequence, pieces of a group, the id that ends a document, bytes of text tokenised at a time.
ROOM, GROUP, END, SLICE = 2048, 8192, 1, 3 << 20

#: A piece's part in a sequence: (piece, first token, tokens).
Part = tuple[int, int, int]


def first_fit(order: list[int], sizes: list[int], room: int) -> list[list[int]]:
    """Put each item, in order, into the first bin that has room for it.

    The bins are leaves of a tournament tree: a node holds the largest residual capacity below it, so
    the first bin with room is found from the root, to the left wherever the left child's champion
    is large enough, and only the way back up is played again.
    """
    width = 1
    while width < len(order):
        width *= 2
    tree = [room] * (2 * width)
    bins: list[list[int]] = []
    for item in order:
        size, at = sizes[item], 1
        while at < width:
            at *= 2
            if tree[at] < size:
                at += 1
        if at - width == len(bins):
            bins.append([item])
        else:
            bins[at - width].append(item)
        tree[at] -= size
        while at > 1:
            best = max(tree[at], tree[at ^ 1])
            at //= 2
            if tree[at] == best:
                break
            tree[at] = best
    return bins


def unpadded(size: int, room: int) -> bool:
    """Whether a sequence of that many tokens needs no padding: it is full or a power of two."""
    return size == room or size & (size - 1) == 0


def filled(bins: list[list[int]], sizes: list[int], room: int) -> list[list[Part]]:
    """The bins as sequences that need no padding.  Where a bin has room left, tokens of the least
    filled bin move there: whole pieces as they fit, largest first, and then a part of one.  What is
    left at the end is cut into sequences whose sizes are powers of two."""
    loads = [sum(sizes[i] for i in held) for held in bins]
    parts: list[list[Part]] = [[(i, 0, sizes[i]) for i in held] for held in bins]
    short = sorted((b for b in range(len(bins)) if not unpadded(loads[b], room)), key=lambda b: (-loads[b], b))
    low, high = 0, len(short) - 1
    while low < high:
        taker, giver = short[low], short[high]
        gap = room - loads[taker]
        given = parts[giver]
        given.sort(key=lambda p: (p[2], p[0], p[1]))
        fitting = [n for n, p in enumerate(given) if p[2] <= gap]
        if fitting:
            moved = given.pop(fitting[-1])
        else:                                                      # the smallest is too large: its head goes
            item, start, size = given[0]
            moved, given[0] = (item, start, gap), (item, start + gap, size - gap)
        parts[taker].append(moved)
        loads[taker] += moved[2]
        loads[giver] -= moved[2]
        low += loads[taker] == room
        high -= loads[giver] == 0
    done = [p for b, p in enumerate(parts) if p and (low > high or b != short[low])] if short else parts
    if short and low == high:
        size, rest = loads[short[low]], list(parts[short[low]])
        while size:
            want = min(room, 1 << (size.bit_length() - 1))
            size -= want
            here: list[Part] = []
            while want:
                item, start, length = rest.pop(0)
                here.append((item, start, min(length, want)))
                if length > want:
                    rest.insert(0, (item, start + want, length - want))
                want -= min(length, want)
            done.append(here)
    return done


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end: int = END) -> DataFrame:
    """(id, row, start, ids, width, doc_tokens): tokens of each text and ``end``, every ``room`` of them
    a piece.  ``ids`` are little-endian unsigned numbers of ``width`` bytes each, 2 where the vocabulary
    allows it.  ``row`` numbers the documents, so equal rows differ.  A null text is an empty one."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("row", LongType()), StructField("start", LongType()),
                         StructField("ids", BinaryType()), StructField("width", IntegerType()), StructField("doc_tokens", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        width = 2 if max(tokenizer.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        for batch in merged(batches, "text", SLICE):
            for part in byte_slices(batch, "text", SLICE):
                row, start, held, total = [], [], [], []
                ids, cuts = token_stream(tokenizer, part.column("text"), end)
                raw = ids.astype(f"<u{width}").tobytes()
                for i, (begin, close) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                    for at in range(begin, close, room):
                        row.append(i)
                        start.append(at - begin)
                        held.append(raw[width * at:width * min(at + room, close)])
                        total.append(close - begin)
                for a in range(0, len(row), 1000):
                    b = min(len(row), a + 1000)
                    mine = pa.array(row[a:b], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(mine), part.column("row").take(mine), pa.array(start[a:b], pa.int64()), pa.array(held[a:b], pa.binary()),
                         pa.array([width] * (b - a), pa.int32()), pa.array(total[a:b], pa.int64())], schema.names)

    numbered = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return numbered.mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, group: int = GROUP, end: int = END) -> DataFrame:
    """(id, start, ids, doc_tokens, sequence_id, offset): every token of every document in one piece, the
    pieces in sequences of at most ``room`` tokens.  ``ids`` are little-endian unsigned 32-bit numbers.

    Documents longer than ``room`` are cut first.  The pieces are dealt into groups of about
    ``group`` by a hash of the row's number, so equal rows and long documents spread, and the number
    of groups grows with the table.  Each group is packed by itself: first-fit decreasing, then bins
    that are not full are filled with tokens of the least filled ones, which cuts a few documents, and
    the last one is cut into powers of two; so no sequence needs padding.  A null or empty text is the
    end token alone.  Repeated rows are documents of their own, null ids are allowed, an empty table
    gives an empty result, other columns are ignored.
    """
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    # A token has at least a byte, so this many pieces there are at most; no result depends on it.
    groups = max(1, -(-(size.rows + size.bytes // (2 * room)) // group))
    made = pieces(docs, path, id_col, text_col, room, end)
    dealt = made.withColumn("group", F.pmod(F.xxhash64("row", "start", F.lit("tournament")), F.lit(groups)).cast("int"))
    schema = StructType([made.schema["id"], StructField("start", LongType()), StructField("ids", BinaryType()), StructField("doc_tokens", LongType()),
                         StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(key, table):
        table = table.combine_chunks()
        width = table["width"][0].as_py()
        held = table["ids"].to_pylist()
        sizes = [len(x) // width for x in held]
        rows, starts = table["row"].to_pylist(), table["start"].to_pylist()
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], rows[i], starts[i]))
        item, first, ids, sequence, offset = [], [], [], [], []
        for number, parts in enumerate(filled(first_fit(order, sizes, room), sizes, room)):
            at = 0
            for i, begin, count in parts:
                item.append(i)
                first.append(starts[i] + begin)
                raw = held[i][width * begin:width * (begin + count)]
                ids.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                sequence.append((key[0].as_py() << 32) + number)
                offset.append(at)
                at += count
        taken = pa.array(item, pa.int64())
        return pa.table([table["id"].take(taken), pa.array(first, pa.int64()), pa.array(ids, pa.binary()), table["doc_tokens"].take(taken),
                         pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return dealt.groupBy("group").applyInArrow(place, schema)
