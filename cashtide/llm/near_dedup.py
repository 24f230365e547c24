"""Near duplicates by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.blocks import slices
from cashtide.llm.common import components, fresh, staged, text_of
from cashtide.llm.shingles import MinMax, common, set_digest, shingle_sets

_SETS = "doc_id long, n_shingles long, shingles binary"


def _signatures(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """doc_id, the size and the name of its set, and its band keys (none for an empty set)."""
    signer = MinMax(rows, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 500):
            sets = list(shingle_sets(part.column("t").to_pylist(), words))
            full = [s for s in sets if len(s)]
            keys = iter(signer.keys(full).view(np.int64) if full else [])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 500):
            sets = list(shingle_sets(part.column("t").to_pylist(), words))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "shingles"],
            )

    return docs.mapInArrow(run, _SETS)


def _linked(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether their full sets are similar enough.

    Pairs too different in size are decided without their sets. Both joins are ones whose hot keys
    adaptive execution splits.
    """
    left = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            linked = []
            for n, m, s, t in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True):
                possible = 100 * min(n, m) >= percent * max(n, m)
                linked.append(possible and _linked(common(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)), n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def _counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``: a product of 0/1 matrices by parts."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for a in range(0, len(shared), columns):
        some = shared[a : a + columns]

        def matrix(sets: list[np.ndarray], some: np.ndarray = some) -> np.ndarray:
            flat = np.concatenate(sets)
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            hit = some[at] == flat
            m = np.zeros((len(sets), len(some)), dtype=np.float32)
            m[row[hit], at[hit]] = 1
            return m

        out += np.rint(matrix(left) @ matrix(right).T).astype(np.int64)
    return out


def _block_links(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For the strays of a block, links to others of it; of each member, only one link to what is connected already."""
    strays, others = block[block["stray"]], block[~block["stray"]]
    if strays.empty or others.empty:
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    s = [np.frombuffer(x, np.uint64) for x in strays["shingles"]]
    o = [np.frombuffer(x, np.uint64) for x in others["shingles"]]
    both = _counts(s, o)
    n, m = strays["n_shingles"].to_numpy()[:, None], others["n_shingles"].to_numpy()[None, :]
    rows, cols = np.nonzero(100 * both >= percent * (n + m - both))
    a, b = strays["doc_id"].to_numpy()[rows], others["doc_id"].to_numpy()[cols]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = find(x), find(y)
        if u != v:
            root[u] = v
            kept.append((x, y))
    return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")


def _group_links(grouped: DataFrame, sets: DataFrame, percent: int, stray_part: int, part: int) -> DataFrame:
    """Links of strays to the members of their leader's group or bucket (leader, doc_id, stray), found in blocks.

    A group is cut into parts of bounded total set size; each part of strays meets each part of members
    in a task of its own, as a product of matrices, so a group of any size is many bounded tasks and
    no pair becomes a row. Members that are linked to the leader need not meet one another.
    """
    sized = grouped.join(sets, "doc_id")
    sizes = sized.groupBy("leader").agg(
        F.ceil(F.sum(F.when(F.col("stray"), F.col("n_shingles"))) / stray_part).cast("int").alias("strays"),
        F.ceil(F.sum("n_shingles") / part).cast("int").alias("parts"),
    ).where("strays > 0")
    dealt = sized.join(sizes, "leader")
    own = F.pmod(F.xxhash64("doc_id"), F.col("strays")).cast("int")
    place = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    fields = ["leader", "doc_id", "n_shingles", "shingles"]
    strays = dealt.where("stray").select(*fields, F.lit(True).alias("stray"), own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    members = dealt.select(*fields, F.lit(False).alias("stray"), F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("i"), place.alias("j"))
    # Dealt by block, also where a join before it was by leader: that would count as grouped by block already.
    blocks = strays.unionByName(members).repartition("leader", "i", "j")
    return blocks.groupBy("leader", "i", "j").applyInPandas(lambda block: _block_links(block, percent), "a long, b long")


def _by_row(source: DataFrame, words: int, **options) -> DataFrame:
    """``near_dedup`` where ids repeat with different texts: of rows, each with a number, then of ids through their rows."""
    numbered = staged(source.where("doc_id is not null").withColumn("row", F.monotonically_increasing_id()), "rows")
    found = staged(near_dedup(numbered, "row", "t", words, **options), "by-row")
    ids = numbered.select(F.col("doc_id").alias("id"), F.col("row").alias("doc_id"))
    rows = staged(found.join(ids, "doc_id").select(F.col("doc_id").alias("row"), "id", "n_shingles", "component_id"), "ids")
    # A component of rows stands for its rows; those of one id are tied to the first of them.
    first = rows.groupBy("id").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most")).where("least <> most")
    ties = rows.join(first, "id").selectExpr("component_id a", "least b").where("a <> b")
    joined = rows.join(components(ties).withColumnRenamed("node", "component_id"), "component_id", "left")
    joined = staged(joined.select("id", "n_shingles", F.coalesce("root", "component_id").alias("root")), "joined")
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    return joined.join(least, "root").select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def near_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    rows: int = 6,
    bands: int = 40,
    stray_part: int = 250_000,
    part: int = 500_000,
    few_most: int = 16,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are sets of distinct shingles of ``words`` words; two are linked if their intersection is at
    least ``percent`` hundredths of their union. component_id is the smallest id reachable by links,
    kept is true for it. An empty or null text has no shingles and is linked with nothing; nor is a
    row whose id is null (component_id null, kept true). Rows that repeat an id are one node with the
    links of all their texts, in whatever order they come. Ids are whole numbers. Other columns are
    not read. An empty table gives no rows.

    Equal sets count once. Others become candidates where a band of min-max values agrees, and every
    candidate pair is either confirmed on the full sets or already connected through confirmed
    links; a pair at a similarity of exactly 0.8 is missed in about 5 cases of a million. Nothing
    forms all pairs of a group: a document is first compared with one leader, that of its buckets
    which meets most others; those that the leader does not link are compared with its group in
    blocks; last come the pairs in one bucket whose leaders differ: as rows where at most ``few_most``
    members stand outside the bucket's largest group, which bounds them by the members, else in blocks.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t"))
    known = source.where("doc_id is not null")
    unknown = _sets(source.where("doc_id is null"), words).select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")
    )
    texts = known.select("doc_id", F.xxhash64("t").alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    if not texts.where("low <> high").isEmpty():
        return _by_row(source, words, percent=percent, rows=rows, bands=bands, stray_part=stray_part, part=part, few_most=few_most).unionByName(unknown)
    signed = staged(_signatures(known, words, rows, bands), "signatures")
    full = signed.where("n_shingles > 0")
    # Of equal sets the smallest id goes on.
    first = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    copies = full.select("doc_id", "digest").distinct().join(first, "digest").where("doc_id <> rep")
    reps = full.groupBy("digest").agg(F.min(F.struct("doc_id", "keys")).alias("one")).select("one.*")

    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1")
    members = staged(keyed.join(shared, "key"), "members")
    # Leader: of those a document meets, itself included, the one that meets most.
    degree = members.groupBy("doc_id").agg(F.sum(F.col("count") - 1).alias("degree"))
    ranked = members.join(degree, "doc_id").withColumn("rank", F.struct("degree", (-F.col("doc_id")).alias("minus")))
    best = ranked.groupBy("key").agg(F.max("rank").alias("rank"))
    led = members.join(best, "key").groupBy("doc_id").agg((-F.max("rank")["minus"]).alias("leader"))
    led = staged(led, "leaders")

    compared = known.join(led.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = staged(_sets(compared, words), "sets")
    tried = led.where("leader <> doc_id").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    tried = staged(_confirmed(tried, sets, percent), "led")
    grouped = tried.select(F.col("b").alias("leader"), F.col("a").alias("doc_id"), (~F.col("linked")).alias("stray"))
    inside = _group_links(grouped, sets, percent, stray_part, part)
    links = staged(tried.where("linked").select("a", "b").union(inside), "links")

    rooted = led.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "leader", F.coalesce("root", "doc_id").alias("root")
    )
    placed = members.select("key", "doc_id").join(staged(rooted, "roots"), "doc_id")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    placed = staged(placed.join(mixed.select("key"), "key", "left_semi"), "mixed")
    # Pairs whose leaders differ: all members of a bucket against those outside its largest group.
    largest = placed.groupBy("key", "leader").count().groupBy("key").agg(F.max_by("leader", "count").alias("most"))
    apart = placed.join(largest, "key").withColumn("stray", F.col("leader") != F.col("most"))
    apart = staged(apart.select("key", "doc_id", "leader", "root", "stray"), "apart")
    crowded = apart.where("stray").groupBy("key").count().where(F.col("count") > few_most).select("key")
    pairwise = apart.join(crowded, "key", "left_anti")
    few = pairwise.where("stray").selectExpr("key", "doc_id a", "leader la", "root ra")
    many = pairwise.selectExpr("key", "doc_id b", "leader lb", "root rb")
    left = few.join(many, "key").where("la <> lb and ra <> rb and a <> lb and b <> la")
    left = left.selectExpr("least(a, b) a", "greatest(a, b) b").distinct()
    late = _confirmed(left, sets, percent).where("linked").select("a", "b")
    # A bucket with more of them is compared in blocks, as a leader's group is.
    crowds = apart.join(crowded, "key", "left_semi").selectExpr("key leader", "doc_id", "stray")
    late = late.union(_group_links(crowds, sets, percent, stray_part, part))

    edges = links.union(late).union(copies.select("doc_id", "rep"))
    found = components(edges).withColumnRenamed("node", "doc_id")
    joined = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    return out.unionByName(unknown)


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` but those of documents that ``near_dedup`` does not keep, with all their columns."""
    name = fresh("__gone", docs)
    gone = near_dedup(docs, doc_id, text, **options).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone[name], "left_anti")
