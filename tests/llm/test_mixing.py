from collections import defaultdict

import pytest

from lexiloom.llm import mixing
from tests.llm.conftest import SCHEMA, worded


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [x for x in sizes if x is None]
    weight = {x: weights[k % len(weights)] for k, x in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(weight[x] for x in open_)
        capped = {x for x in open_ if weight[x] * level >= most * sizes[x]}
        if not capped:
            return target | {x: weight[x] * level for x in open_}
        for x in capped:
            target[x] = most * sizes[x]
            left -= target[x]
        open_ -= capped
    return target


@pytest.mark.parametrize("bits", [12, 2])
def test_every_source_comes_near_its_target(spark, bits, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", bits)
    rows = [(k, worded(k, 1 + k % 60), "en", [None, "z", "a", "é", "hot"][min(4, k % 9)], 0) for k in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size) and r.copies * r.size == r.taken
    assert target == pytest.approx(brute_targets(size))
    assert all(abs(taken[s] - target[s]) <= 60 for s in size)
    assert mixing.repeated(docs).count() == sum(r.copies for r in found)


def test_many_sources_get_their_targets(spark):
    """More sources than any one range of the order holds."""
    rows = [(k, f"s{k}" if k else None, 1 + k * 7919 % 1000) for k in range(3000)]
    found = mixing.targets(spark.createDataFrame(rows, "k int, source string, source_size long").select("source", "source_size").repartition(5)).collect()
    assert {r.source: r.target for r in found} == pytest.approx(brute_targets({s: n for _, s, n in rows}))


@pytest.mark.parametrize("held", [50_000, 0])
def test_joined_and_broadcast_sources_give_the_same(spark, odd, held, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", held)
    found = sorted(mixing.mix(odd).select("doc_id", "source", "size", "target", "taken").collect(), key=str)
    monkeypatch.undo()
    assert found == sorted(mixing.mix(odd).select("doc_id", "source", "size", "target", "taken").collect(), key=str)


def test_odd_rows(odd, none, clashing):
    found = mixing.mix(clashing).collect()
    assert len(found) == odd.count() and all(r.taken <= 2 * r.size for r in found)
    assert all(r.size == 0 for r in found if r.doc_id in (1, 2, 3))
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0
    assert mixing.repeated(odd).columns == odd.columns and mixing.repeated(clashing).columns == clashing.columns
    assert {r._size for r in mixing.repeated(clashing).collect()} == {"taken"}
