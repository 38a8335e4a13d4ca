"""Problem 7: filling fixed-capacity containers with items, none divided unless it alone exceeds the capacity.

Method: the configuration linear program over the histogram of lengths. A configuration is a multiset of lengths within
the capacity; the program asks for the least total multiplicity of configurations that covers every length's items.
Lengths above capacity / SMALL are grouped into at most GROUPS classes of equal mass, each counted with its mean length;
shorter items are one divisible class that fills what a configuration leaves free. Multiplicative weights solve it: each
class has a price, its length times exp(-rate x its cover so far); a knapsack dynamic program finds the configuration of
the highest price; it enters with the multiplicity that covers its scarcest class once, and the covered classes get
cheaper. The average over the rounds is the fractional solution, and the prices of every round give a lower bound by
duality; rounds end when the two lie within GAP of each other, which they must, as the rate falls with the root of the
covers. A program that is slow to close is solved less closely: each PATIENCE rounds a class accept GAP more. Multiplicities are then rounded along their
running sum, so they keep their total; a configuration's places take items of their classes, the last place the longest
item that leaves the planned room; and what the program does not place (small items, the part of a class that rounding
leaves over) goes to where it fits best, else into new containers.

All this works on the histogram: at most `capacity` numbers on the driver, and a number of rounds that depends on GROUPS
and GAP, not on the number of items. Items then find their containers by their rank within their length. Ranks are made in
salted buckets of a length, so a length that a third of all items share is spread over tasks, and only (length, bucket)
counts are gathered.

An item above the capacity is divided into full containers and one remainder. Defined results: null and empty texts are
no items; repeated ids are items of their own; ties in a length go by hash bucket and id.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from math import log, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, spread, table
from .tokenizer import sizes

GROUPS = 96
SMALL = 16
GAP = 0.03
PATIENCE = 8


def knapsack(lengths: np.ndarray, values: np.ndarray, counts: np.ndarray, capacity: int, density: float = 0.0) -> dict[int, int]:
    """The configuration of the largest value within the capacity, by dynamic programming over the capacity.

    Several copies of a length enter in powers of two. density is what a unit of free room is worth.
    """
    items: list[tuple[int, float, int, int]] = []
    for j, (n, v, c) in enumerate(zip(lengths.tolist(), values.tolist(), counts.tolist())):
        c, k = min(c, capacity // n), 1
        while c > 0:
            k = min(k, c)
            items.append((n * k, v * k, j, k))
            c -= k
            k *= 2
    best = np.zeros(capacity + 1)
    took = np.zeros((len(items), capacity + 1), bool)
    for i, (n, v, _, _) in enumerate(items):
        if n > capacity:
            continue
        other = best[: capacity + 1 - n] + v
        took[i, n:] = other > best[n:] + 1e-12
        np.maximum(best[n:], other, out=best[n:])
    at, found = int((best - density * np.arange(capacity + 1)).argmax()), {}
    for i in range(len(items) - 1, -1, -1):
        if took[i, at]:
            n, _, j, k = items[i]
            found[j] = found.get(j, 0) + k
            at -= n
    return found


@dataclass
class Program:
    """The classes of a histogram and the fractional solution over them."""

    length: np.ndarray  # of every class, the mean of its items, rounded up
    need: np.ndarray
    members: list[list[int]]  # lengths of every class
    configs: list[tuple[dict[int, int], float]] = field(default_factory=list)  # class -> copies, multiplicity
    value: float = 0.0  # containers of the fractional solution, scaled to cover every class
    bound: float = 0.0  # by duality no solution over these classes has fewer
    rounds: int = 0


def solve(histogram: dict[int, int], capacity: int, groups: int = GROUPS, gap: float = GAP) -> Program:
    """The configuration program by multiplicative weights."""
    large = [n for n in sorted(histogram) if histogram[n] > 0 and capacity // SMALL < n <= capacity]
    sand = float(sum(n * c for n, c in histogram.items() if 0 < n <= capacity // SMALL))
    if not large:
        return Program(np.empty(0, np.int64), np.empty(0), [], value=sand / capacity, bound=sand / capacity)
    mass = np.cumsum([n * histogram[n] for n in large])
    _, of = np.unique(np.minimum((mass - 1) * groups // mass[-1], groups - 1), return_inverse=True)
    members: list[list[int]] = [[] for _ in range(of.max() + 1)]
    for n, g in zip(large, of):
        members[g].append(n)
    need = [sum(histogram[n] for n in m) for m in members]
    program = Program(np.array([-(-sum(n * histogram[n] for n in m) // c) for m, c in zip(members, need)]), np.array(need), members)
    length, need, m = program.length, program.need.astype(float), len(members)
    if sand:
        need = np.append(need, sand)
    cover = np.zeros(len(need))
    held: dict[tuple, float] = {}
    total = 0.0
    while total > (1 + gap * (1 + program.rounds / (PATIENCE * len(need)))) * program.bound * cover.min() or not total:
        rate = min(1.0, sqrt(log(len(need) + 1) / max(cover.min(), 1.0)))
        weight = np.exp(-rate * (cover - cover.min())) / capacity
        price = length * weight[:m]
        density = weight[m] if sand else 0.0
        config = knapsack(length, price, program.need, capacity, density)
        free = (capacity - sum(int(length[j]) * k for j, k in config.items())) if sand else 0
        worth = sum(price[j] * k for j, k in config.items()) + density * free
        program.bound = max(program.bound, (float(price @ need[:m]) + density * sand) / worth)
        times = min([need[j] / k for j, k in config.items()] + ([sand / free] if free else []))
        for j, k in config.items():
            cover[j] += times * k / need[j]
        if free:
            cover[m] += times * free / sand
        key = tuple(sorted(config.items()))
        held[key] = held.get(key, 0.0) + times
        total += times
        program.rounds += 1
    # Scaled to the bound, so that hardly a class is covered more than once; `value` is scaled to cover all.
    program.configs = [(dict(c), x * program.bound / total) for c, x in held.items()]
    program.value = total / cover.min()
    return program


@dataclass
class Plan:
    """Configurations (length -> items) with their multiplicities, and what the program said."""

    configs: list[tuple[dict[int, int], int]]
    program: Program
    placed: int  # items that the program placed


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, gap: float = GAP) -> Plan:
    """Containers that together hold exactly the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0 and 0 < n <= capacity}
    program = solve(left, capacity, groups, gap)
    #: Containers alike, by free room: [items by length, how many].
    open_: list[list] = [[] for _ in range(capacity + 1)]
    rooms: set[int] = set()

    def put(config: dict[int, int], times: int, room: int) -> None:
        open_[room].append([config, times])
        rooms.add(room)

    lengths = sorted(left)
    small = [n for n in lengths if n * SMALL <= capacity]
    #: A room that the average small item does not fit into is not planned.
    least = sum(n * left[n] for n in small) / sum(left[n] for n in small) if small else capacity
    exact = done = placed = 0.0
    for config, x in sorted(program.configs, key=lambda c: -c[1]):
        exact += x
        times = int(exact + 0.5 - done)
        done += times
        places = [j for j in sorted(config, reverse=True) for _ in range(config[j])]
        planned = capacity - sum(int(program.length[j]) for j in places)
        planned *= planned >= least
        while times:
            got: dict[int, int] = {}
            room = capacity
            for i, j in enumerate(places):
                if i + 1 < len(places):
                    # Any member will do: the one of which most are left.
                    n = max((n for n in program.members[j] if n <= room), key=lambda n: left[n] - got.get(n, 0), default=0)
                else:
                    k = bisect_right(lengths, max(room - planned, 0)) - 1
                    while k >= 0 and left[lengths[k]] <= got.get(lengths[k], 0):
                        k -= 1
                    n = lengths[k] if k >= 0 and lengths[k] * SMALL > capacity else 0
                if n and left[n] > got.get(n, 0):
                    got[n] = got.get(n, 0) + 1
                    room -= n
            if not got:
                break  # every class of this configuration is placed
            step = min([times, *(left[n] // k for n, k in got.items())])
            for n, k in got.items():
                left[n] -= k * step
                placed += k * step
            put(got, step, room)
            times -= step
    # The rest, longest first, to the place that it fills best.
    for n in sorted(left, reverse=True):
        while left[n]:
            fits = [r for r in rooms if r >= n]
            if fits:
                room = min(fits)
                config, times = open_[room].pop()
                if not open_[room]:
                    rooms.discard(room)
                # As many of this length as go into each of these containers, while they last.
                step = min(times, left[n])
                k = max(1, min(room // n, left[n] // times)) if step == times else 1
                if step < times:
                    put(config, times - step, room)
            else:
                config, room, k = {}, capacity, min(capacity // n, left[n])
                step = left[n] // k
            put(config | {n: config.get(n, 0) + k}, step, room - n * k)
            left[n] -= k * step
    return Plan([(c, t) for runs in open_ for c, t in runs], program, int(placed))


def parts(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, tokens): one row per item, more for an item above the capacity."""
    n = F.expr(f"cast(({size} + {capacity} - 1) div {capacity} as int)")
    rows = items.where(f"{size} > 0").select(key, F.col(size).alias("_size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return rows.select(key, "part", F.least(F.lit(capacity), F.col("_size") - F.col("part") * capacity).cast("int").alias("tokens"))


def pack(items: DataFrame, key: str, size: str, capacity: int, buckets: int | None = None) -> DataFrame:
    """(container_id, key, part, tokens) for every part. items is read several times: give it checkpointed."""
    rows = parts(items, key, size, capacity)
    histogram = {r.tokens: r.n for r in rows.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = buckets or max(16, sum(histogram.values()) // 500_000)
    # For every length, where the ranks of each configuration start, its first container and its items of that length.
    starts: dict[int, list] = {n: [] for n in histogram}
    base = 0
    done = dict.fromkeys(histogram, 0)
    for config, times in plan(histogram, capacity).configs:
        for n, k in config.items():
            starts[n].append((done[n], base, k))
            done[n] += k * times
        base += times
    spark = items.sparkSession
    slots = spark.createDataFrame([(n, s) for n, s in starts.items()], "tokens int, slots array<struct<first: long, base: long, per: int>>")
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64(key, "part"), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("tokens", "bucket").agg(F.count("*").alias("n"))
    # (length, bucket) counts: at most capacity x buckets rows.
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("tokens", "bucket", F.coalesce("offset", F.lit(0)).alias("offset"))
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy(key, "part")) - 1)
    ranked = ranked.join(offsets, ["tokens", "bucket"]).withColumn("_rank", F.col("_row") + F.col("offset"))
    # slots has one row per length, at most `capacity`, whatever the number of items.
    placed = ranked.join(F.broadcast(slots), "tokens").withColumn("_slot", F.expr("element_at(filter(slots, s -> s.first <= _rank), -1)"))
    return placed.select((F.col("_slot.base") + F.floor((F.col("_rank") - F.col("_slot.first")) / F.col("_slot.per"))).cast("long").alias("container_id"), key, "part", "tokens")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container."""
    capacity = table(spark, sf_dir, "size_limits").where("item = 'container'").first().capacity
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").where("length(text) > 0")
    return pack(checkpointed(sizes(spread(documents), "doc_id", "text")), "doc_id", "tokens", capacity)
