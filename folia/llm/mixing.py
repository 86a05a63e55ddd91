"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, form blocks. With share s,
block j of a source is released at slot floor(j / s) and due at ceil((j + 1) / s);
at each slot the released block with the earliest deadline runs. Any prefix of the
mix then differs from each source's target by less than one block.

Weights are whole tickets, so the schedule repeats after as many slots as there are
tickets: one period is worked out on the driver, and every block's slot follows from
its number by arithmetic in the DataFrame. When a source has no blocks left a new
phase begins, in which the others share by their tickets.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Documents of a block.
BLOCK_DOCS = 16
#: Documents of a range of the order, about; documents are numbered range by range, so that no window grows with the table.
RANGE_DOCS = 50_000


def period(tickets: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of as many slots as there are tickets, earliest deadline first."""
    total = sum(tickets.values())
    due = lambda j, t: -(-(j + 1) * total // t)
    names = sorted(tickets)
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: dict[str, list[int]] = {name: [] for name in names}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(j, tickets[names[i]]), i, j))
        deadline, i, j = heapq.heappop(ready)
        assert slot < deadline
        slots[names[i]].append(slot)
        if j + 1 < tickets[names[i]]:
            heapq.heappush(waiting, ((j + 1) * total // tickets[names[i]], i, j + 1))
    return slots


def phases(tickets: dict[str, int], blocks: dict[str, int]) -> dict[str, list[tuple[int, int, int, list[int]]]]:
    """For each source, its phases: (first block, first slot, tickets of all active sources, slots of a period)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out: dict[str, list] = {s: [] for s in left}
    start = 0
    while left:
        active = {s: tickets[s] for s in left}
        total, slots = sum(active.values()), period(active)
        for s in left:
            out[s].append((done[s], start, total, slots[s]))
        ends = {s: (n - 1) // active[s] * total + slots[s][(n - 1) % active[s]] + 1 for s, n in left.items()}
        length = min(ends.values())
        for s in list(left):
            used = length // total * active[s] + bisect_left(slots[s], length % total)
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        start += length
    return out


def root_tickets(sizes: dict[str, int], total: int = 1000) -> dict[str, int]:
    """Tickets in proportion to the square root of each source's documents: large sources weigh less than their size."""
    whole = sum(n**0.5 for n in sizes.values())
    return {s: max(1, round(total * n**0.5 / whole)) for s, n in sizes.items() if n > 0}


def _schedule(spark: SparkSession, plan: dict[str, list], tickets: dict[str, int]) -> DataFrame:
    rows = [(s, tickets[s], [p[0] for p in x], [p[1] for p in x], [p[2] for p in x], [p[3] for p in x]) for s, x in plan.items()]
    return spark.createDataFrame(rows, "__source string, tickets bigint, firsts array<bigint>, starts array<bigint>, totals array<bigint>, slots array<array<bigint>>")


def numbered(docs: DataFrame, source: Column, id_col: str, total: int) -> DataFrame:
    """The ``total`` rows of ``docs`` with ``__source`` and ``__rank``, the place from 0 in its source's order, by two levels of counting."""
    bits = max(10, (total // RANGE_DOCS).bit_length())
    order = F.xxhash64(F.lit("mix"), F.col(id_col), source)
    keyed = docs.withColumns({"__source": source, "__hash": order, "__bucket": F.shiftrightunsigned(order, 64 - bits).cast("int")})
    counts = keyed.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(W.partitionBy("__source").orderBy("__bucket")) - F.col("__n")).drop("__n")  # a row a range and source
    before = common.stored(before, "offsets")
    few = common.small_enough(before)
    ranked = keyed.withColumn("__row", F.row_number().over(W.partitionBy("__source", "__bucket").orderBy("__hash", id_col)))
    joined = ranked.join(F.broadcast(before) if few else before, ["__source", "__bucket"])
    return joined.withColumn("__rank", F.col("__before") + F.col("__row") - 1).drop("__hash", "__bucket", "__before", "__row")


def mixed(docs: DataFrame, tickets: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``id_col, source, block, slot, release, deadline, place`` of each row of ``docs``.

    ``tickets``: whole positive weights by source, by default ``root_tickets``; a
    source without one gets 1. ``slot``: the block's turn in the mix; ``place``: the
    document's turn within all. release and deadline count in slots from the start
    of the phase. A null source is a source named ''. Repeated rows and null ids
    are placed like others; ties of the pseudo-random order go by id, those of equal
    ids are equal rows. Whole input: every row has a turn; an empty table gives no
    rows. Other columns, whatever their names, aren't read. Only the table of sources
    goes to the driver.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    narrow = docs.select(id_col, source_col)
    sizes = {r[0]: r[1] for r in narrow.groupBy(source.alias("s")).agg(F.count("*").alias("n")).collect()}  # a row a source
    given = {s: int((tickets or {}).get(s, 1)) for s in sizes} if tickets else root_tickets(sizes)
    plan = phases(given, {s: -(-n // block_docs) for s, n in sizes.items()})
    schedule = _schedule(spark, plan, given)
    rows = numbered(narrow, source, id_col, sum(sizes.values())).join(F.broadcast(schedule), "__source")  # a row a source
    block = F.floor(F.col("__rank") / block_docs)
    phase = F.size(F.filter("firsts", lambda x: x <= F.col("block"))) - 1
    rows = rows.withColumn("block", block).withColumn("__phase", phase)
    own = F.col("block") - F.get("firsts", F.col("__phase"))
    rows = rows.withColumns({"__own": own, "__total": F.get("totals", F.col("__phase"))})
    turn = F.get(F.get("slots", F.col("__phase")), (F.col("__own") % F.col("tickets")).cast("int"))
    slot = F.get("starts", F.col("__phase")) + F.floor(F.col("__own") / F.col("tickets")) * F.col("__total") + turn
    release = F.floor(F.col("__own") * F.col("__total") / F.col("tickets"))
    deadline = F.ceil((F.col("__own") + 1) * F.col("__total") / F.col("tickets"))
    return rows.select(id_col, F.col("__source").alias("source"), "block", slot.alias("slot"), release.alias("release"), deadline.alias("deadline"), (slot * block_docs + F.col("__rank") % block_docs).alias("place"))
