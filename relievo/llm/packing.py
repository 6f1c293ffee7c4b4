"""Best-fit packing of documents into fixed token windows by linear grouping."""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import chunks, default_path
from .common import query, stored, table, texts

#: Tokens of a sequence, the id that ends a document, and the longest length that counts as small.
CAPACITY, END_ID, SMALL = 4096, 1, 512
#: Groups of equal cardinality that the large lengths are rounded into.
GROUPS = 32
#: Stretches of text that a worker remembers before it starts over; bounds its memory.
REMEMBERED = 1_000_000
#: Rows numbered in one task; it only sets how finely the numbering is cut for parallel work.
SLICE_ROWS = 20_000


class Lookup:
    """Token ids of texts: the library encodes each different stretch between blanks once.

    Normaliser and split pattern of the vocabulary never join what a blank separates, so a text's ids
    are those of its stretches in order.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, values: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        known = self.known
        cuts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in values]
        fresh = list({w for c in cuts for w in c if w not in known})
        for i in range(0, len(fresh), 10_000):
            some = fresh[i:i + 10_000]
            ids = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, ids))
        return [b"".join([known[w] for w in c]) for c in cuts]


@lru_cache(maxsize=4)
def lookup(path: str) -> Lookup:
    return Lookup(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most `capacity`: (d, piece, start, length, crc) and, if asked, ids.

    Every document ends with `end_id`, so an empty or NULL text is one piece of one token.
    """
    path = path or default_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        tok = lookup(path)
        for pdf in batches:
            d, t, at = pdf["d"].tolist(), pdf["t"].tolist(), 0
            for part in chunks(t):
                rows = []
                for k, ids in zip(d[at:at + len(part)], tok.encode(part)):
                    ids += end
                    for i, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[lo:lo + 4 * capacity]
                        rows.append((k, i, lo // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
                at += len(part)
                yield pd.DataFrame(rows, columns=["d", "piece", "start", "length", "crc", "ids"])

    rows = texts(docs, key, text).withColumn("d", F.col("d").cast("string"))
    return rows.mapInPandas(work, "d string, piece int, start long, length long, crc long, ids binary").withColumn(
        "d", F.col("d").cast("long"))


def _fill(space: int, sizes: list[int], left: list[int]) -> list[int]:
    """How many of each size fill `space` best, within what is left of each."""
    reach, came = 1, {}
    mask = (1 << (space + 1)) - 1
    for g, s in enumerate(sizes):
        for _ in range(min(left[g], space // s)):
            new = (reach << s) & mask & ~reach
            if not new:
                break
            reach |= new
            while new:
                bit = new & -new
                came[bit.bit_length() - 1] = g
                new ^= bit
        if reach >> space:
            break
    total, used = reach.bit_length() - 1, [0] * len(sizes)
    while total:
        g = came[total]
        used[g] += 1
        total -= sizes[g]
    return used


def plan_large(counts: dict[int, int], capacity: int, small: int, groups: int):
    """Configurations for the lengths above `small`, from their counts alone.

    Lengths, longest first, are cut into groups of equal cardinality and rounded up to the longest of
    their group. Each configuration takes the largest size left and the best filling of the rest, and is
    used as often as it can be, so every one uses up a size. Few sizes, so few configurations.
    Returns sizes, how many items each group has, and configurations (times, {group: items}).
    """
    lengths = sorted((x for x in counts if x > small), reverse=True)
    total = sum(counts[x] for x in lengths)
    if not total:
        return [], [], []
    bounds = [i * total // groups for i in range(groups + 1)]
    ends = np.cumsum([counts[x] for x in lengths])
    sizes, items = [], []
    for lo, hi in zip(bounds, bounds[1:]):
        if hi > lo:
            sizes.append(lengths[int(np.searchsorted(ends, lo, "right"))])
            items.append(hi - lo)
    left, plan = list(items), []
    for g in range(len(sizes)):
        while left[g]:
            left[g] -= 1
            used = _fill(capacity - sizes[g], sizes[g:], left[g:])
            left[g] += 1
            used = {g + i: n + (i == 0) for i, n in enumerate(used) if n or i == 0}
            times = min(left[i] // n for i, n in used.items())
            for i, n in used.items():
                left[i] -= n * times
            plan.append((times, used))
    return sizes, items, plan


def plan_small(gaps: dict[int, int], counts: dict[int, int], capacity: int):
    """Best fit of small lengths into the gaps of sequences, from counts of both alone.

    Sequences with the same gap move as runs (gap at the start, first number among those, how many).
    Each length, longest first, goes into the tightest gap that takes it; what no gap takes opens
    new sequences. Returns moves (length, first item, items, gap at the start, first sequence): item
    i goes to the i-th sequence from there; gap -1 stands for new sequences; and how many are new.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {g: [(g, 0, n)] for g, n in gaps.items() if n and g > 0}
    open_gaps = sorted(runs)
    moves, opened = [], 0

    def put(gap, run):
        if gap <= 0:
            return
        if gap in runs:
            runs[gap].append(run)
        else:
            runs[gap] = [run]
            bisect.insort(open_gaps, gap)

    for x in sorted(counts, reverse=True):
        item, n = 0, counts[x]
        while n:
            at = bisect.bisect_left(open_gaps, x)
            if at == len(open_gaps):
                each = capacity // x
                full, rest = divmod(n, each)
                for number, fill in ((full, each), (1 if rest else 0, rest)):
                    if number:
                        for layer in range(fill):
                            moves.append((x, item + layer * number, number, -1, opened))
                        item += number * fill
                        put(capacity - fill * x, (-1, opened, number))
                        opened += number
                break
            gap = open_gaps[at]
            origin, first, size = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                open_gaps.pop(at)
            take = min(size, n)
            moves.append((x, item, take, origin, first))
            if size > take:
                put(gap, (origin, first + take, size - take))
            put(gap - x, (origin, first, take))
            item, n = item + take, n - take
    return moves, opened


def _numbered(df: DataFrame, by: str, unique: str, rows: int, name: str) -> DataFrame:
    """`df` with `name`: 0, 1, ... within each value of `by`, in any order that stays the same.

    A value is numbered in slices by a digest of `unique`, so one that holds a third of all rows
    spreads like the rest; the counts of the slices before are added.
    """
    slices = max(1, min(1 << 16, rows // SLICE_ROWS))
    cut = df.withColumn("_slice", F.expr(f"pmod(xxhash64({unique}), {slices}L)"))
    ahead = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = (cut.groupBy(by, "_slice").agg(F.count("*").alias("_k"))
            .select(by, "_slice", F.coalesce(F.sum("_k").over(ahead), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(by, "_slice").orderBy(unique)
    return (cut.withColumn("_r", F.row_number().over(inside) - 1).join(base, [by, "_slice"])
            .withColumn(name, F.col("_base") + F.col("_r")).drop("_slice", "_base", "_r"))


def _starts(values) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(values, "int64"))))


def _place_large(items: DataFrame, counts: dict[int, int], members: list[int], plan) -> DataFrame:
    """(pid, length, seq): actual documents put into the configurations' places, group by group.

    `items` carry `r`, their number among equal lengths. The plan has a few hundred entries, however
    many documents there are.
    """
    above, seen = {}, 0  # large items that are longer than a length
    for x in sorted(counts, reverse=True):
        above[x] = seen
        seen += counts[x]
    group_start = _starts(members)
    uses: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for times, used in plan:
        for g, n in used.items():
            uses.setdefault(g, []).append((times, n, base))
        base += times
    table = {g: (_starts([t * n for t, n, _ in u]), np.array([n for _, n, _ in u]), np.array([b for _, _, b in u]))
             for g, u in uses.items()}

    def work(batches):
        for pdf in batches:
            rank = pdf["length"].map(above).to_numpy() + pdf["r"].to_numpy()
            group = np.searchsorted(group_start, rank, "right") - 1
            at, seq = rank - group_start[group], np.zeros(len(rank), "int64")
            for g in np.unique(group).tolist():
                own = group == g
                starts, each, first = table[g]
                use = np.searchsorted(starts, at[own], "right") - 1
                seq[own] = first[use] + (at[own] - starts[use]) // each[use]
            yield pd.DataFrame({"pid": pdf["pid"], "length": pdf["length"], "seq": seq})

    return items.select("pid", "length", "r").mapInPandas(work, "pid long, length long, seq long")


def _place_small(items: DataFrame, moves, first_new: int) -> DataFrame:
    """(pid, length, gap, number, seq): the gap and its number among equal gaps, or the new sequence."""
    by_length: dict[int, list] = {}
    for x, item, n, gap, first in moves:
        by_length.setdefault(x, []).append((item, gap, first))
    table = {x: tuple(np.array(c, "int64") for c in zip(*m)) for x, m in by_length.items()}

    def work(batches):
        for pdf in batches:
            r, length = pdf["r"].to_numpy(), pdf["length"].to_numpy()
            gap, number = np.zeros(len(r), "int64"), np.zeros(len(r), "int64")
            for x in np.unique(length).tolist():
                own = length == x
                item, gaps, first = table[x]
                use = np.searchsorted(item, r[own], "right") - 1
                gap[own], number[own] = gaps[use], first[use] + r[own] - item[use]
            new = gap < 0
            yield pd.DataFrame({"pid": pdf["pid"], "length": length, "gap": gap, "number": number,
                                "seq": np.where(new, first_new + number, -1)})

    return items.select("pid", "length", "r").mapInPandas(work, "pid long, length long, gap long, number long, seq long")


def pack(items: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """Put items (pid, length) into sequences of `capacity`: (pid, sequence_id, offset).

    Only counts by length (at most `capacity` rows) reach the driver. From them, large lengths are
    rounded up into groups of equal cardinality and packed by configurations; the actual items, numbered
    within their length, then take the places. What rounding left over is a gap of each sequence; counts
    by gap and by small length give a best fit of the small ones, and what finds no gap opens new
    sequences. Items lie in a sequence longest first, without holes.
    Equal items are interchangeable. An empty table gives an empty result.
    """
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    big, little = {x: n for x, n in counts.items() if x > small}, {x: n for x, n in counts.items() if x <= small}
    numbered = _numbered(items.select("pid", "length"), "length", "pid", rows, "r")
    _, members, plan = plan_large(big, capacity, small, groups)
    large = stored(_place_large(numbered.where(F.col("length") > small), big, members, plan), "pack")
    filled = stored(large.groupBy("seq").agg((F.lit(capacity) - F.sum("length")).alias("gap")), "pack")
    gaps = {r["gap"]: r["n"] for r in filled.groupBy("gap").agg(F.count("*").alias("n")).collect()}
    moves, _ = plan_small(gaps, little, capacity)
    first_new = sum(times for times, _ in plan)
    put = stored(_place_small(numbered.where(F.col("length") <= small), moves, first_new), "pack")
    known = _numbered(filled, "gap", "seq", max(1, first_new), "number").select("gap", "number", F.col("seq").alias("of"))
    fitted = (put.where("gap >= 0").join(known, ["gap", "number"]).select("pid", "length", F.col("of").alias("seq"))
              .unionByName(put.where("gap < 0").select("pid", "length", "seq")))
    before = Window.partitionBy("seq").orderBy(F.desc("length"), "pid").rowsBetween(Window.unboundedPreceding, -1)
    return large.unionByName(fitted).select(
        "pid", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenize documents, cut those longer than a sequence, and pack the pieces into few sequences.

    Returns one row per piece: key, piece, start, length, ids_crc32, sequence_id, offset and, with
    keep_ids, the ids as little-endian 32-bit integers. NULL or empty text: one piece with the end id
    alone. Repeated rows are packed as often as they occur; a NULL identifier stays NULL.
    """
    made = stored(pieces(docs, path, capacity, end_id, key, text, keep_ids).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    placed = pack(made.select("pid", "length"), capacity)
    return made.join(placed, "pid").select(
        F.col("d").alias(key), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset",
        *(["ids"] if keep_ids else []))


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
