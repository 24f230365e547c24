"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import fresh, staged, text_of

#: What white space is to this operator.
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ("digest", "check", "n_bytes")


def _digests(docs: DataFrame, doc_id: str, text: str, row: Column | None = None) -> DataFrame:
    number = F.monotonically_increasing_id() if row is None else row
    original = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"), number.alias("seq"))
    bare = original.withColumn("bare", F.translate("t", _SPACE, ""))
    return bare.select(
        "doc_id",
        F.unhex(F.sha2("bare", 256)).alias("digest"),
        F.xxhash64("bare").alias("check"),
        F.octet_length("bare").cast("long").alias("n_bytes"),
        F.length("t").cast("long").alias("n_chars"),
        "seq",
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, then best row first: one row per key, its counts summed.

    Keys are compared whole. The last key of a batch waits for the next batch, so memory holds one
    batch and one row.
    """
    kept: dict | None = None
    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        keys = [batch.column(c) for c in ("lane", *_KEY)]
        new = np.ones(batch.num_rows, dtype=bool)
        if batch.num_rows > 1:
            same = np.ones(batch.num_rows - 1, dtype=bool)
            for k in keys:
                same &= np.asarray(pc.equal(k[1:], k[:-1]).fill_null(False))
            new[1:] = ~same
        heads = np.flatnonzero(new)
        sizes = np.add.reduceat(np.asarray(batch.column("group_size")), heads)
        firsts = batch.take(pa.array(heads)).to_pylist()
        for row, size in zip(firsts, sizes.tolist(), strict=True):
            row["group_size"] = size
        if kept is not None:
            if all(kept[c] == firsts[0][c] for c in ("lane", *_KEY)):
                kept["group_size"] += firsts[0]["group_size"]
                firsts[0] = kept
            else:
                firsts.insert(0, kept)
        kept = firsts.pop()
        if firsts:
            yield pa.RecordBatch.from_pylist(firsts, schema=schema)
    if kept is not None:
        yield pa.RecordBatch.from_pylist([kept], schema=schema)


def _merged(runs: DataFrame) -> DataFrame:
    order = ["lane", *_KEY, F.desc("n_chars"), F.asc_nulls_last("doc_id"), "seq"]
    return runs.sortWithinPartitions(*order).mapInArrow(_merge, runs.schema)


def digest_groups(digests: DataFrame, fan: int = 4, lanes: int | None = None) -> DataFrame:
    """One row per distinct text: its key, the row that stays (doc_id, n_chars, seq) and the group's size.

    Every partition sorts its digests into one run, in which a text occurs once. In each round
    ``fan`` lanes exchange runs: a lane keeps the digests whose next digit is its own and takes
    those of its peers, then merges what it has, sorted, to one row a text. After log(lanes) rounds
    each lane holds all that was found of its share of the digests, and no lane more than that: a
    text with a third of all rows is one row from the first round on.
    """
    spark = digests.sparkSession
    wanted = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while fan**rounds < wanted:
        rounds += 1
    count = fan**rounds
    runs = digests.withColumn("group_size", F.lit(1).cast("long"))
    runs = _merged(runs.withColumn("lane", F.lit(0)))
    home = F.pmod(F.xxhash64("digest"), F.lit(count)).cast("int")
    runs = runs.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(count)).cast("int"))
    for r in range(rounds):
        unit = fan**r
        digit = F.floor(F.col("lane") / unit) % fan
        own = F.floor(home / unit) % fan
        runs = runs.withColumn("lane", (F.col("lane") + (own - digit) * unit).cast("int"))
        # A lane is a partition; hashed lane numbers would share some and leave others empty.
        runs = _merged(runs.repartitionById(count, "lane"))
    return runs.drop("lane")


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = 4, lanes: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when they are identical without white space (blank, tab to carriage return).
    The row with the most code points stays, then the one with the smallest id; a null id counts as
    the largest, and of rows that repeat both id and text one stays. A null text is empty, and all
    empty texts are equal. Equality is verified by SHA-256, a second hash and the length in bytes
    together. Columns of ``docs`` other than the two named are neither read nor returned; an empty
    table gives no rows.
    """
    digests = staged(_digests(docs, doc_id, text), "digests")
    groups = digest_groups(digests, fan, lanes).select(
        *_KEY, F.col("doc_id").alias("keep_id"), F.col("seq").alias("keep_seq"), "group_size"
    )
    return digests.join(groups, list(_KEY)).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("seq") == F.col("keep_seq")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever these are called."""
    row = fresh("__row", docs)
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    digests = _digests(numbered, doc_id, text, F.col(row))
    stay = digest_groups(staged(digests, "digests")).select(F.col("seq").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)
