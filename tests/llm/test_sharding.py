import zlib
from collections import Counter

import pytest

from cashtide.llm.common import table
from cashtide.llm.sharding import capacities, fill_ring, ring_points, shard_rows


def walked(owners, counts, room):
    """Row by row along the ring."""
    left, used, out = list(room), [0] * len(room), []
    for arc, count in enumerate(counts):
        placed = []
        for _ in range(count):
            at = arc
            while not left[owners[at]]:
                at = (at + 1) % len(owners)
            left[owners[at]] -= 1
            placed.append((owners[at], used[owners[at]]))
            used[owners[at]] += 1
        out.append(placed)
    return out


@pytest.mark.parametrize("slack", [0.0, 0.1, 1.0])
def test_ring_against_single_steps(slack):
    _, owners = ring_points(5, 7)
    counts = [(i * 37) % 11 * (9 if i == 3 else 1) for i in range(len(owners))]
    room = capacities(sum(counts), 5, slack)
    pieces = fill_ring(owners, counts, room)
    rows = [[(shard, slot + k) for _, size, shard, slot in arc for k in range(size)] for arc in pieces]
    assert rows == walked(owners, counts, room)


def check(found, rows, shards):
    assert len(found) == len(rows)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    sizes = [len(by_shard.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == expected


@pytest.mark.parametrize("slice_rows", [3, 1000])
def test_awkward_rows(awkward, slice_rows):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(200)]
    rows += [(None, None), (None, None), (7, ""), (7, ""), (900, "x" * 300_000)]
    check(shard_rows(awkward(rows), shards=6, virtual=5, slice_rows=slice_rows).collect(), rows, 6)
    assert shard_rows(awkward([]), shards=6, virtual=5).count() == 0


def test_one_id_on_many_texts(awkward):
    rows = [(7 if i % 3 == 0 else i, f"text {i % 50}") for i in range(300)] + [(None, f"text {i}") for i in range(100)]
    check(shard_rows(awkward(rows), shards=6, virtual=5, slice_rows=5).collect(), rows, 6)


def test_few_rows_for_many_shards(awkward):
    check(shard_rows(awkward([(1, "a"), (2, "b")])).collect(), [(1, "a"), (2, "b")], 40)


def test_same_answer_twice_and_equal_texts_meet(spark, sample):
    docs = table(spark, sample, "documents")
    first = {r.doc_id: r.shard for r in shard_rows(docs, slack=0.5).collect()}
    again = {r.doc_id: r.shard for r in shard_rows(docs.repartition(5), slack=0.5).collect()}
    assert first == again
    grown = {r.doc_id: r.shard for r in shard_rows(docs, shards=41, slack=0.5).collect()}
    moved = sum(first[i] != grown[i] for i in first)
    assert moved < len(first) / 4
