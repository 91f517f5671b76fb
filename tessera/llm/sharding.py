"""Minimax contiguous partition of atomic groups into shards (operator 2).

Documents with equal texts form a group that is never split.  Groups are put in
a fixed order, those larger than an even share first and the rest by digest,
and cut into runs so that the largest run is as small as can be: the smallest
feasible capacity is found by binary search with a greedy check, and the greedy
cuts at that capacity are the shards.

The order holds too many groups for one machine, so the driver sees cells:
digest prefixes with their bytes, group counts and largest groups.  Each round
bounds the capacity from below (cells that can flow) and above (cells that
cannot), and only cells in which a cut can still fall are divided further, a
few hundred cells by 256 each round.  When none of those can be divided the
cuts are exact.  What reaches the driver does not grow with the corpus.

Defined results: a null text has size 1, as an empty one, and joins its group;
repeated rows are rows of one group; an empty table gives an empty result; null
ids are kept; with fewer groups than shards the last shards stay empty; groups
of one size are told apart by their digests, so there are no ties; a text of any
length is one size and one digest, and one longer than an even share has a shard
of its own; columns other than id and text are never read.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed, width

_FIRST, _STEP, _DIGITS = 3, 2, 32  # hex digits of the first cells, of each division, and of a digest


@dataclass
class Cell:
    """Groups whose digests begin with prefix: bytes in all, how many groups, the largest."""

    prefix: str
    total: int
    groups: int
    largest: int

    @property
    def solid(self) -> bool:
        return self.groups <= 1 or len(self.prefix) >= _DIGITS


def greedy(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Ends of runs filled up to capacity, or None if more runs than shards are needed."""
    ends, held = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if held + size > capacity:
            ends.append(i)
            held = 0
            if len(ends) == shards:
                return None
        held += size
    return [*ends, len(sizes)]


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which a greedy filling needs no more than the shards."""
    low, high = max([0, -(-sum(sizes) // shards), *sizes]), max(sum(sizes), 0)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(sizes, shards, middle) is not None else (middle + 1, high)
    return low


def _fluid(cells: list[Cell], sums: list[int], shards: int, capacity: int) -> list[int] | None:
    """Positions, in bytes, no exact greedy cut at this capacity can be beyond; None if not even these suffice."""
    at, out = 0, []
    for _ in range(shards):
        at += capacity
        if at >= sums[-1]:
            return out
        i = bisect.bisect_right(sums, at) - 1
        if cells[i].solid:
            at = sums[i]
        out.append(at)
        if cells[i].solid and out[-1] == (out[-2] if len(out) > 1 else 0):
            return None
    return None


def _open_cells(cells: list[Cell], shards: int) -> list[int]:
    """Cells that can be divided and in which a cut can fall at a capacity that may be the smallest."""
    sizes = [c.total for c in cells]
    sums = [0]
    for size in sizes:
        sums.append(sums[-1] + size)
    high = smallest_capacity(sizes, shards)
    low, top = max([-(-sums[-1] // shards), *(c.largest for c in cells)]), high
    while low < top:
        middle = (low + top) // 2
        low, top = (low, middle) if _fluid(cells, sums, shards, middle) is not None else (middle + 1, top)
    late = _fluid(cells, sums, shards, high) or []
    found: set[int] = set()
    at = 0
    for cut in late:
        at = sums[max(0, bisect.bisect_right(sums, at + low) - 1)]  # whole cells only: no later than the exact cut
        first, last = bisect.bisect_right(sums, at) - 1, bisect.bisect_right(sums, cut) - 1
        found.update(i for i in range(first, min(last, len(cells) - 1) + 1) if not cells[i].solid)
    return sorted(found)


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[str], list[tuple[str, int]]]:
    """From groups (digest, total): the large groups' digests in order, and for the others each further shard's first prefix.

    Returns the giants, one shard each, and pairs (first prefix, shard).
    """

    def cells(frame: DataFrame, digits: int) -> list[Cell]:
        rows = frame.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sum("total"), F.count("*"), F.max("total")).collect()
        return sorted((Cell(*r) for r in rows), key=lambda c: c.prefix)

    total = int(groups.agg(F.sum("total")).first()[0] or 0)
    giants: list[tuple[str, int]] = []
    left = shards
    while left > 1:  # each is over an even share of what is left, so there are fewer than shards of them
        even = (total - sum(size for _, size in giants)) / left
        more = groups.where(F.col("total") > even).where(~F.col("digest").isin([d for d, _ in giants]) if giants else F.lit(True))
        found = [(r["digest"], int(r["total"])) for r in more.orderBy(F.desc("total"), "digest").limit(left - 1).collect()]
        if not found:
            break
        giants += found
        left -= len(found)
    rest = groups.where(~F.col("digest").isin([d for d, _ in giants])) if giants else groups
    known, digits = cells(rest, _FIRST), _FIRST
    while known and (divided := _open_cells(known, left)):
        digits += _STEP
        names = [known[i].prefix for i in divided]
        by_length: dict[int, list[str]] = {}
        for name in names:
            by_length.setdefault(len(name), []).append(name)
        parts = []
        for length, prefixes in by_length.items():
            chosen = rest.where(F.substring("digest", 1, length).isin(prefixes))
            parts += cells(chosen, length + _STEP)
        gone = set(names)
        known = sorted([c for c in known if c.prefix not in gone] + parts, key=lambda c: c.prefix)
    sizes = [c.total for c in known]
    ends = (greedy(sizes, left, smallest_capacity(sizes, left)) or [0])[:-1] if known else []
    first = len(giants)
    return [d for d, _ in giants], [(known[e].prefix, first + 1 + k) for k, e in enumerate(ends)]


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_a_slot_run: int = 200_000) -> DataFrame:
    """A row for each row of df: id, size, text_crc32, digest, law, shard, slot and grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("digest"),
        )
    )
    groups = checkpointed(rows.groupBy("digest").agg(F.sum("size").alias("total"), F.count("*").alias("n")))
    giants, cuts = plan_cuts(groups, shards)
    number = F.lit(len(giants))
    for prefix, k in cuts:
        number = F.when(F.col("digest") >= prefix, k).otherwise(number)
    for k, digest in enumerate(giants):
        number = F.when(F.col("digest") == digest, k).otherwise(number)
    placed = rows.withColumn("shard", number.cast("int"))

    # Slots are in order of a hash of id and text: runs of it of a bounded number of rows, whatever group they are of, each behind the runs before it.
    runs = max(width(df.sparkSession), -(-rows.count() // rows_a_slot_run))
    digits = max(1, math.ceil(math.log(runs, 16)))
    mixed = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("/"), F.col("digest")).cast("binary"))
    placed = placed.withColumn("mixed", mixed).withColumn("run", F.substring("mixed", 1, digits))
    counted = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "run").orderBy("mixed", "id", "digest")
    numbered = placed.withColumn("place", F.row_number().over(inside))
    joined = numbered.join(offsets, ["shard", "run"])
    return joined.select(
        F.col("id").alias(id_col), "size", "text_crc32", "digest", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
