"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.runtime import checkpointed, lean, ship, spare, task_count
from wattline.llm.slots import gapless, ranked_by

#: Weights are whole numbers of this many bits: after 2^31 slots a source is off its target by 2^-31 of a block for it.
GRID = 62
_HALF = GRID // 2
_LOW = np.uint64((1 << GRID) - 1)
PLACED = "grp int, block long, slot long, release long, deadline long"


def earliest_deadline_first(share: dict[str, Fraction], start: int = 0) -> Iterator[tuple[str, int, int]]:
    """(source, release, deadline) of the block in each slot from ``start`` on, without end; the shares add up to 1."""
    window = lambda s, i: (start + (i - 1) * share[s].denominator // share[s].numerator, start - (-i * share[s].denominator // share[s].numerator))
    released: list[tuple] = []
    waiting = [(start, window(s, 1)[1], -w, s, 1) for s, w in share.items()]
    heapq.heapify(waiting)
    for t in count(start):
        while waiting and waiting[0][0] <= t:
            r, d, w, s, i = heapq.heappop(waiting)
            heapq.heappush(released, (d, w, s, i, r))
        d, w, s, i, r = heapq.heappop(released)
        yield s, r, d
        heapq.heappush(waiting, (*window(s, i + 1), w, s, i + 1))


def pfair(blocks: dict[str, int], weights: dict[str, Fraction]) -> list[tuple[str, int, int, int]]:
    """(source, block, release, deadline) of every block, in the order of the slots, one block a slot: the schedule in one piece.

    A source of weight w gets for its i-th block the window from floor((i-1)/w)
    to ceil(i/w); among the released blocks the one of the earliest deadline
    goes first, ties to the larger weight, then by name. With weights that add
    up to 1 every block meets its deadline, so after t slots a source has
    less than one block more or less than w * t. When a source runs out, the
    others' weights are scaled up to 1 and their windows start anew at that slot.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out: list[tuple[str, int, int, int]] = []
    while left:
        whole = sum(weights[s] for s in left)
        for s, r, d in earliest_deadline_first({s: weights[s] / whole for s in left}, len(out)):
            out.append((s, done[s], r, d))
            done[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
    return out


def on_grid(weights: list[float]) -> list[int]:
    """Whole numbers, 1 at least, in the weights' proportions and with the sum 2^``GRID``: the largest remainders are rounded up."""
    whole = sum(map(Fraction, weights))
    exact = [Fraction(w) * (1 << GRID) / whole for w in weights]
    parts = [max(1, int(x)) for x in exact]
    missing = (1 << GRID) - sum(parts)
    for i in sorted(range(len(parts)), key=lambda i: (parts[i] - exact[i], i))[: max(0, missing)]:
        parts[i] += 1
    if missing < 0:  # weights too small for the grid
        parts[max(range(len(parts)), key=parts.__getitem__)] += missing
    return parts


class Phase:
    """An endless Pfair schedule of some sources that can be entered at the start of any period.

    Every block stands in its window, for the exact weights. At the border of
    two periods, a time T, a source has been given floor(w * T) blocks or one more. Which
    sources have one more is told by T alone: those with the earliest deadlines, as
    far as their blocks and those that were due before fit into the slots between
    their releases and T, looking back one period. Such a choice leaves no
    block behind that could not meet its deadline (greedy choices under nested
    bounds hold as many of the first deadlines as any choice can), so within each
    period earliest deadline first places exactly the blocks between its borders.
    A period has ``least`` slots or more, and as many as the smallest source has to
    a block, so that what one border has given ahead is due at the next.
    """

    def __init__(self, parts: list[int], least: int):
        self.parts, self.period = parts, max(least, -(-(1 << GRID) // min(parts)))
        whole = np.array(parts, dtype=np.uint64)
        self.whole = whole
        self.high, self.low = (whole >> np.uint64(_HALF)).astype(np.int64), (whole & np.uint64((1 << _HALF) - 1)).astype(np.int64)

    def floors(self, t: np.ndarray) -> np.ndarray:
        """floor(w * t) of every source (rows) at the times ``t`` (columns)."""
        if t.max(initial=0) < 1 << _HALF:
            return (self.high[:, None] * t[None] + ((self.low[:, None] * t[None]) >> _HALF)) >> _HALF
        return ((self.whole.astype(object)[:, None] * t.astype(object)[None]) >> GRID).astype(np.int64)

    def broken(self, t: np.ndarray) -> np.ndarray:
        """Where w * t is no whole number."""
        return ((self.whole[:, None] * t.astype(np.uint64)[None]) & _LOW) != 0

    def release(self, s: int, i: int) -> int:
        return ((i - 1) << GRID) // self.parts[s]

    def deadline(self, s: int, i: int) -> int:
        return -((-i << GRID) // self.parts[s])

    def done(self, t: int) -> np.ndarray:
        """Blocks of each source before the slot ``t``, a border of periods."""
        at = np.array([t], dtype=np.int64)
        given = self.floors(at)[:, 0]
        extra = t - int(given.sum())
        if not extra:
            return given
        back = min(t, self.period - 1)
        room = np.zeros(back + 1, dtype=np.int64)  # by the number of slots before t: those that due blocks released in them leave free
        for a in range(1, back + 1, 512):
            u = np.arange(a, min(a + 512, back + 1))
            due = given[:, None] - self.floors(t - u) - self.broken(t - u)
            room[u] = u - np.maximum(due, 0).sum(axis=0)
        open_ = np.flatnonzero(self.broken(at)[:, 0]).tolist()
        given = given.copy()
        for _, _, s in sorted((self.deadline(s, int(given[s]) + 1), -self.parts[s], s) for s in open_):
            age = t - self.release(s, int(given[s]) + 1)
            if age <= back:
                if room[age:].min() < 1:
                    continue
                room[age:] -= 1
            given[s] += 1
            extra -= 1
            if not extra:
                return given
        raise AssertionError("weights that add up to 1 leave room for every block")

    def slots(self, k: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(slot, source, block, release, deadline) of period ``k``; blocks from 0, slots and windows from the start of the phase."""
        begin, end = k * self.period, (k + 1) * self.period
        first, last = self.done(begin).tolist(), self.done(end).tolist()
        waiting = [(max(begin, self.release(s, i + 1)), s, i) for s, i in enumerate(first) if i < last[s]]
        heapq.heapify(waiting)
        released: list[tuple] = []
        for t in range(begin, end):
            while waiting and waiting[0][0] <= t:
                _, s, i = heapq.heappop(waiting)
                due = self.deadline(s, i + 1)
                heapq.heappush(released, (min(due, end), due, -self.parts[s], s, i))
            _, due, _, s, i = heapq.heappop(released)
            yield t, s, i, self.release(s, i + 1), due
            if i + 1 < last[s]:
                heapq.heappush(waiting, (max(begin, self.release(s, i + 2)), s, i + 1))


@dataclass
class Part:
    """A phase of the whole schedule: until one of its sources (by number) has no block left."""

    start: int
    slots: int
    sources: list[int]
    parts: list[int]
    #: Blocks of each source before this phase.
    before: list[int]
    period: int


def phases(blocks: dict[int, int], weights: dict[int, float], period: int) -> list[Part]:
    """The phases of a schedule of all blocks; the work here grows with the sources and the logarithm of the blocks."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, start = dict.fromkeys(left, 0), 0
    out: list[Part] = []
    while left:
        sources = sorted(left)
        n = np.array([left[s] for s in sources])
        plan = Phase(on_grid([weights[s] for s in sources]), period)
        low, high = 0, int(n.sum()) // plan.period + 1  # periods before which none, and after which some source has run out
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if (plan.done(mid * plan.period) >= n).any() else (mid, high)
        given = plan.done(low * plan.period).tolist()
        end = low * plan.period
        for t, s, i, _, _ in plan.slots(low):
            given[s], end = i + 1, t + 1
            if given[s] == n[s]:
                break
        out.append(Part(start, end, sources, plan.parts, [done[s] for s in sources], plan.period))
        for s, m in zip(sources, given):
            done[s] += m
            left[s] -= m
            if not left[s]:
                del left[s]
        start += end
    return out


def slot_table(spark: SparkSession, plan: list[Part]) -> DataFrame:
    """``PLACED``: the slot and window of every block of the schedule; tasks work out periods of their own."""
    ship(spark)
    firsts = np.concatenate(([0], np.cumsum([-(-p.slots // p.period) for p in plan]))).astype(int).tolist()
    told = spark.sparkContext.broadcast(plan)
    names = [x.split()[0] for x in PLACED.split(", ")]

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                at = bisect_right(firsts, number) - 1
                part = told.value[at]
                rows = [(part.sources[s], part.before[s] + i, part.start + t, part.start + r, part.start + d) for t, s, i, r, d in Phase(part.parts, part.period).slots(number - firsts[at]) if t < part.slots]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 4))], names=names)

    return spark.range(0, firsts[-1], 1, min(firsts[-1], 4 * task_count(spark)) or 1).mapInArrow(work, PLACED)


def schedule_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, block_bytes: int = 1 << 16, period: int = 4096, most_sources: int = 256) -> DataFrame:
    """The place of every document in the mixture: doc, doc_id, source, size, block, release, deadline, slot, position.

    Each source's documents, in the order of a hash, stand one after another on
    a line of bytes, cut into blocks of ``block_bytes``; a document belongs to
    the block in which it begins, and one longer than a block leaves the blocks
    that it covers empty, so they are charged to its source. Blocks are scheduled
    as in ``pfair`` towards ``weights`` (by source; sources not named there weigh
    their bytes to the power ``exponent``, relative to these values): every block
    stands in its window, so no source is ever a block or more off its target.
    ``period`` is the number of slots that a task works out at a time, or more
    where the smallest share of a source is less than one in so many. ``position``
    numbers all documents from 0 without gaps in the mixed order. Every document has one place; none is
    repeated or left out.

    One row a source reaches the driver for the first ``most_sources``: named
    ones, then the largest. All others are scheduled together with the sum of
    their weights; within that sum the blocks of each stand in the order of their
    fluid deadlines, block number over weight, so their own weights hold there
    too, though a source may then be some blocks off.

    A null source is a source of its own, named None in ``weights``; null and
    empty texts have size 1 and a place like any other; very long texts are
    charged as said; repeated rows and null ids take neighbouring places; an
    empty table gives no rows; other columns are ignored.
    """
    return _scheduled(docs, weights, exponent, block_bytes, period, most_sources).drop("tie")


def _scheduled(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, block_bytes: int = 1 << 16, period: int = 4096, most_sources: int = 256) -> DataFrame:
    """``schedule_mix`` with the hash of the text, ``tie``."""
    spark = docs.sparkSession
    weights = weights or {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    raw = F.col("text").cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.coalesce(F.length(raw), F.lit(0)) + 1).cast("long").alias("size"), F.xxhash64("text").alias("tie"), place_key().alias("doc"),
    )
    named = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, named double")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("size")).join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name")), "left")
    weight = F.coalesce("named", F.pow(F.col("size").cast("double"), F.lit(float(exponent))))
    sizes = checkpointed(sizes.select("source", "size", F.ceil(F.col("size") / block_bytes).cast("long").alias("blocks"), weight.alias("weight"), F.col("named").isNotNull().alias("named")))
    chosen = sizes.orderBy(F.desc("named"), F.desc("size"), "source").limit(most_sources).collect()
    group = {r["source"]: i for i, r in enumerate(chosen)}
    table = spark.createDataFrame(list(group.items()), "name string, grp int")
    grouped = lambda df: df.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    rest = grouped(sizes).where("grp is null")
    pooled = rest.agg(F.sum("blocks").alias("blocks"), F.sum("weight").alias("weight")).first()
    blocks = {i: r["blocks"] for i, r in enumerate(chosen)} | ({len(chosen): pooled["blocks"]} if pooled["blocks"] else {})
    shares = {i: r["weight"] for i, r in enumerate(chosen)} | ({len(chosen): pooled["weight"]} if pooled["blocks"] else {})
    slots = slot_table(spark, phases(blocks, shares, period))

    dealt = grouped(narrow)
    line = F.coalesce(F.col("grp").cast("string"), F.concat(F.lit("-"), F.col("source")), F.lit(""))
    rows = gapless(dealt, "row", line, ["doc", "tie", "size"], restart=True, weight="size", ahead="ahead")
    cut = rows.withColumn("block", F.floor(F.col("ahead") / block_bytes).cast("long"))
    if pooled["blocks"]:
        # Every block of the other sources, those that no document begins in as well, by its number in their sum.
        each = rest.select("source", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        numbers = ranked_by(each.withColumn("due", (F.col("block") + 1) / F.col("weight")), "in_pool", ["due", "source", "block"]).select(F.col("source").alias("name"), F.col("block").alias("own"), "in_pool")
        cut = cut.join(numbers, F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("own")), "left").drop("name", "own")
        keyed = cut.withColumns({"key": F.coalesce("in_pool", "block"), "grp": F.coalesce("grp", F.lit(len(chosen)))})
    else:
        keyed = cut.withColumn("key", F.col("block"))
    found = slots.select("grp", F.col("block").alias("key"), "slot", "release", "deadline")
    placed = checkpointed(keyed.join(found, ["grp", "key"]).select("doc", "tie", "doc_id", "source", "size", "block", "row", "release", "deadline", "slot"))
    ranks = (placed.agg(F.max("slot")).first()[0] or 0) + 1
    return gapless(placed, "position", F.lit(0), ["row", "doc", "tie", "size"], rank="slot", ranks=ranks).drop("row")


def place_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def place_keys(docs: DataFrame) -> dict[str, Column]:
    """The columns by which ``places`` finds a row, under names that ``docs`` does not have."""
    key, tie = spare([*docs.columns, "position"], "_key", "_tie")
    return {key: place_key(), tie: F.coalesce(F.xxhash64("text"), F.lit(0))}


def places(docs: DataFrame, **settings) -> DataFrame:
    """place_key, place_tie, position: the place of every document in the mixture; repeated rows share their first.

    It follows from the rows alone, not from how they are laid out or partitioned.
    """
    found = _scheduled(docs, **settings)
    return found.groupBy(F.col("doc").alias("place_key"), F.coalesce("tie", F.lit(0)).alias("place_tie")).agg(F.min("position").alias("position"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` laid out in the mixed order: range partitions of the position, sorted within. Columns stay as they are.

    Written to files, they keep it: their names and rows are in this order. ``schedule_mix`` says what becomes of null sources,
    null, empty and very long texts and repeated rows; an empty table gives no
    rows; columns may have any names.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    (key, _), (tie, _) = keys = list(place_keys(docs).items())
    own, other, at = spare([*docs.columns, key, tie], "_own", "_other", "_at")
    found = places(docs, **settings).toDF(own, other, at)
    placed = docs.withColumns(dict(keys)).join(found, (F.col(key) == F.col(own)) & (F.col(tie) == F.col(other)))
    return placed.repartitionByRange(task_count(docs.sparkSession), at).sortWithinPartitions(at).select(*names)
