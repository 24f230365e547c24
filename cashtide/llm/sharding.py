"""A consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashtide.llm.common import staged, text_of


def ring_points(shards: int, virtual: int) -> tuple[list[int], list[int]]:
    """Sorted positions of the virtual nodes in 0 .. 2^48, and the shard of each."""
    points = sorted(
        (int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:6], "big"), s)
        for s in range(shards)
        for v in range(virtual)
    )
    return [p for p, _ in points], [s for _, s in points]


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may hold: an even share times 1 + slack, the remainder one by one to the first."""
    most = int(total * (1 + slack))
    return [most // shards + (s < most % shards) for s in range(shards)]


def fill_ring(owners: Sequence[int], counts: Sequence[int], room: Sequence[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each arc, pieces (first, size, shard, slot): where the rows of that arc go, in their order.

    Arcs give their rows in ring order. Rows that find a shard full continue clockwise to the next
    shard with room. Full nodes are skipped through links to the next node with room, so the work
    is about that of the number of nodes, whatever the number of rows.
    """
    n, left, used = len(owners), list(room), [0] * len(room)
    onward = list(range(n + 1))  # next node that may have room; n wraps to 0

    def find(i: int) -> int:
        path = []
        while i < n and (onward[i] != i or not left[owners[i]]):
            path.append(i)
            i = onward[i] if onward[i] != i else i + 1
        for p in path:
            onward[p] = i
        return i

    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in owners]
    for arc, count in enumerate(counts):
        first = 0
        while first < count:
            at = find(arc)
            if at == n:
                at = find(0)
            if at == n:
                raise ValueError("the shards hold fewer rows than there are")
            shard = owners[at]
            size = min(count - first, left[shard])
            pieces[arc].append((first, size, shard, used[shard]))
            left[shard] -= size
            used[shard] += size
            first += size
    return pieces


def shard_rows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = 40,
    virtual: int = 64,
    slack: float = 0.0,
    slice_rows: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot, arc.

    A row's place on the ring is a hash of its text, so equal texts meet in a shard while it has
    room; its arc ends at the next virtual node clockwise, whose shard takes it. A shard holds at
    most its even share times 1 + slack, and what overflows continues clockwise. Without slack
    every shard is filled to its share, so counts are at most one apart; with slack fewer rows move
    when a shard is added.

    Only one count per arc comes to the driver (shards x virtual numbers). Rows are numbered within
    slices of an arc, so that a text or an id with a third of all rows is numbered by many tasks (copies of both together by one); a slice holds
    about ``slice_rows`` rows, by default a quarter of what a shuffle partition gets of all rows. A null text has no bytes; rows that repeat an id are rows of their own,
    and which of them is which is open only among rows that agree in all returned columns. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    points, owners = ring_points(shards, virtual)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(text_of(text)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text_of(text)).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text_of(text)), 16).alias("place"),
    )
    # The arc of a place: a table over its first bits narrows the nodes down to few.
    bits = 12
    starts = [bisect.bisect_left(points, i << (48 - bits)) for i in range((1 << bits) + 1)]
    widest = max(b - a for a, b in zip(starts, starts[1:], strict=False))
    nodes = F.array(*map(F.lit, [*points, *[1 << 50] * (widest + 1)]))
    lookup = spark.createDataFrame([(i, s) for i, s in enumerate(starts[:-1])], "cell int, first int")
    lookup = lookup.select(
        "cell", "first", F.slice(nodes, F.col("first") + 1, F.lit(widest)).alias("near")
    )
    rows = rows.withColumn("cell", F.shiftright("place", 48 - bits).cast("int")).join(F.broadcast(lookup), "cell")
    beyond = F.size(F.filter("near", lambda p: p < F.col("place")))
    rows = rows.withColumn("arc", F.pmod(F.col("first") + beyond, F.lit(len(points))).cast("int"))
    rows = staged(rows.select("doc_id", "size", "text_crc32", "arc"), "ring")

    counts = [0] * len(points)
    for r in rows.groupBy("arc").count().collect():
        counts[r["arc"]] = r["count"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slice_rows = slice_rows or max(1, sum(counts) // (4 * partitions))
    pieces = fill_ring(owners, counts, capacities(sum(counts), shards, slack))
    placed = [
        (arc, max(1, -(-counts[arc] // slice_rows)), [dict(zip(("from", "rows", "shard", "slot"), p, strict=True)) for p in ps])
        for arc, ps in enumerate(pieces)
        if ps
    ]
    plan = spark.createDataFrame(placed, 'arc int, slices int, pieces array<struct<`from`: long, rows: long, shard: int, slot: long>>')
    # At most one piece per arc and one more per shard that fills up: shards x (virtual + 1) in all.
    cut = rows.join(F.broadcast(plan), "arc").withColumn("slice", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), "slices").cast("int"))
    inside = Window.partitionBy("arc", "slice").orderBy("doc_id", "size", "text_crc32")
    before = Window.partitionBy("arc").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("arc", "slice").count().select(
        "arc", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    rank = F.col("offset") + F.col("nth") - 1
    piece = F.element_at(F.filter("pieces", lambda p: (p["from"] <= F.col("rank")) & (F.col("rank") < p["from"] + p["rows"])), 1)
    return (
        cut.withColumn("nth", F.row_number().over(inside))
        .join(offsets, ["arc", "slice"])
        .withColumn("rank", rank)
        .withColumn("piece", piece)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("piece.shard").alias("shard"),
            (F.col("piece.slot") + F.col("rank") - F.col("piece.from")).alias("slot"),
            "arc",
        )
    )
