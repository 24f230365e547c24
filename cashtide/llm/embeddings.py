"""Near duplicates of embeddings by Euclidean p-stable hashing, confirmed by exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.blocks import mix
from cashtide.llm.common import components, staged


def usable(vector: np.ndarray | None) -> bool:
    """Whether a vector has a direction: neither null, empty nor zero, all components finite."""
    return vector is not None and len(vector) > 0 and bool(np.isfinite(vector).all()) and bool(vector.any())


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled first, so that neither large nor small components are lost."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Projections:
    """Keys of unit vectors in ``tables`` tables: ``width``-wide cells of ``parts`` Gaussian projections each.

    The distance of two projections is the vectors' Euclidean distance times a standard normal
    number, so near vectors share cells often and far ones seldom.
    """

    def __init__(self, tables: int = 256, parts: int = 16, width: float = 1.5, seed: int = 11):
        self.tables, self.parts, self.width, self._seed = tables, parts, width, seed
        self._drawn: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def keys(self, units: np.ndarray) -> np.ndarray:
        """One 32-bit key per row and table."""
        size = units.shape[1]
        if size not in self._drawn:
            draw = np.random.default_rng([self._seed, size])
            self._drawn[size] = (
                draw.standard_normal((size, self.tables * self.parts)) / self.width,
                draw.random(self.tables * self.parts),
                draw.integers(0, 1 << 63, size=self.parts, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            )
        lines, shifts, odd = self._drawn[size]
        cells = np.floor(units @ lines + shifts).astype(np.int64).reshape(len(units), self.tables, self.parts)
        h = np.full((len(units), self.tables), size, dtype=np.uint64)
        for p in range(self.parts):
            h = mix(h * odd[p] + cells[:, :, p].view(np.uint64))
        return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _hashed(vectors: DataFrame, shape: Projections) -> DataFrame:
    """vec_id, the unit vector as bytes, and its keys, one row per row; both null without an id or a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
                rest: list[int | None] = []
                for i, v in zip(part.column("vec_id").to_pylist(), part.column("v").to_pylist(), strict=True):
                    v = None if v is None or None in v else np.array(v, dtype=np.float64)
                    if i is not None and usable(v):
                        by_size.setdefault(len(v), []).append((i, v))
                    else:
                        rest.append(i)
                if rest:
                    none = [None] * len(rest)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rest, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.list_(pa.int32()))],
                        names=["vec_id", "u", "keys"],
                    )
                for found in by_size.values():
                    units = unit(np.stack([v for _, v in found]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([i for i, _ in found], pa.int64()),
                            pa.array([u.tobytes() for u in units + 0.0], pa.binary()),
                            pa.array(list(shape.keys(units)), pa.list_(pa.int32())),
                        ],
                        names=["vec_id", "u", "keys"],
                    )

    return vectors.mapInArrow(run, "vec_id long, u binary, keys array<int>")


def _block(side: np.ndarray, ids: np.ndarray, copies: np.ndarray, units: np.ndarray, keys: np.ndarray, table: int, same: bool, least: float):
    """Of one bucket, or two parts of one: its members, their links counted here, and for each one that joins it to others.

    A pair that agrees in several tables is counted in the first of them only.
    """
    left = np.arange(len(ids)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    near = units[left] @ units[right].T >= least
    if same:
        near = np.triu(near, 1)
    links = np.zeros(len(ids), dtype=np.int64)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for row in np.flatnonzero(near.any(axis=1)):
        me, others = left[row], right[near[row]]
        for a, b in ((0, 8), (8, 32), (32, table)):  # most pairs agree within the first few tables
            b = min(b, table)
            if a < b and len(others):
                others = others[~(keys[others, a:b] == keys[me, a:b]).any(axis=1)]
        links[me] += copies[others].sum()
        links[others] += copies[me]
        for other in others.tolist():
            a, b = find(int(me)), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
    hit = np.flatnonzero(links)
    return ids[hit], links[hit], ids[[find(x) for x in hit.tolist()]] if len(hit) else ids[hit]


_BLOCK_KEY = ("at", "key", "dims", "i", "j")


def _blocks(least: float):
    """Rows sorted by block: each block, which may go on in the next batch, to the links found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            plain = {c: rows.column(c).to_numpy() for c in ("side", "node", "copies", "at", "dims", "i", "j")}
            units, keys = rows.column("u").to_pylist(), rows.column("keys").combine_chunks()
            keys = np.asarray(keys.flatten()).reshape(rows.num_rows, -1)
            out = []
            for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                matrix = np.frombuffer(b"".join(units[a:b]), np.float64).reshape(b - a, -1)
                own = {c: v[a:b] for c, v in plain.items() if c in ("side", "node", "copies")}
                same = plain["i"][a] == plain["j"][a]
                out.append(_block(own["side"], own["node"], own["copies"], matrix, keys[a:b], int(plain["at"][a]), same, least))
            columns = [pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays(columns, names=["node", "links", "other"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = [rows.column(c).to_numpy() for c in _BLOCK_KEY]
            if not rows.num_rows:
                continue
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            if len(cuts):
                yield found(rows.slice(0, int(cuts[-1])).combine_chunks(), cuts)
            held = rows.slice(int(cuts[-1]) if len(cuts) else 0).combine_chunks()
        if held is not None and held.num_rows:
            yield found(held, np.array([held.num_rows]))

    return run


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    least: float = 0.9,
    tables: int = 256,
    parts: int = 16,
    width: float = 1.5,
    part: int = 512,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are linked at a cosine of at least ``least`` in double precision; n_links counts the
    other vectors linked directly, component_id is the smallest id reachable, kept is true for it.
    Null, empty and zero vectors and those with null or non-finite components are linked with
    nothing, nor are vectors of different lengths. A row with a null id is linked with nothing: no
    links, component_id null, kept true. Ids are whole numbers. Rows that repeat an id and a unit
    vector (in doubles) are one vector: it counts once, each of them gets its answer. Rows of one id with
    different directions are different vectors, each linked by its own direction only, and count as
    others to each other. Other columns are not read. An empty table gives no rows.

    Vectors of one direction are one until the end, where their number counts. A bucket's members
    meet in blocks of at most ``part`` rows, each a task of its own for large buckets, and give a count
    and one link per member, not a row per pair. Each pair is counted in the first table in
    which it agrees. At a cosine of 0.95 one pair in a million
    agrees in no table, at 0.9 exactly 4 in 100; what is linked is never below ``least``.
    """
    shape = Projections(tables, parts, width)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    hashed = staged(_hashed(rows, shape).withColumn("row", F.monotonically_increasing_id()), "hashed")
    usable_rows = hashed.where("u is not null")
    # Each direction is a node, of the row that stands for it. Nodes are numbered in the order of
    # their smallest ids, so that the smallest node of a component has its smallest id.
    vectors_once = usable_rows.groupBy("u", "vec_id").agg(F.min("row").alias("row"))
    same = vectors_once.groupBy("u").agg(F.min(F.struct("vec_id", "row")).alias("first"), F.count("*").alias("copies"))
    same = same.select("u", F.col("first.vec_id").alias("rep"), F.col("first.row").alias("row"), "copies")
    same = staged(same.orderBy("rep", "u").withColumn("node", F.monotonically_increasing_id()), "directions")
    keyed = usable_rows.select("row", "keys").join(same.select("row", "u", "node", "copies"), "row")
    firsts = staged(keyed.select("node", "u", "keys", "copies"), "firsts")

    bucket = ["at", "key", "dims"]
    cells = firsts.select("node", F.octet_length("u").alias("dims"), F.posexplode("keys").alias("at", "key"))
    buckets = cells.groupBy(*bucket).count().where("count > 1")
    members = staged(cells.join(buckets, bucket), "members")
    full = members.join(firsts, "node")
    blocks = F.ceil(F.col("count") / part).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = full.withColumn("blocks", blocks).withColumn("own", own)
    spread = spread.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        *bucket, F.least("own", "meets").alias("i"), F.greatest("own", "meets").alias("j"),
        (F.col("own") > F.col("meets")).cast("int").alias("side"), "node", "u", "copies", "keys",
    )
    dealt = spread.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)
    found = dealt.mapInArrow(_blocks(least), "node long, links long, other long")
    found = staged(found, "found")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = found.where("node <> other").selectExpr("node a", "other b").distinct()
    roots = components(joined).join(same.selectExpr("node root", "rep component"), "root").select("node", "component")
    grouped = same.join(counts, "node", "left").join(roots, "node", "left").select(
        "u", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = usable_rows.select("vec_id", "u").join(grouped, "u").select("vec_id", "n_links", "component_id")
    alone = hashed.where("u is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
