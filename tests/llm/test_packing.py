import random

from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import packing as pk


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_item_once(histogram):
    slots, windows, _ = pk.plan(histogram, 64)
    used = {}
    for size, a, b, tier, base, copies, offset in slots:
        for rank in range(a, b):
            w = base + (rank - a) // copies
            assert w < windows[tier]
            used.setdefault((tier, w), []).append((offset + (rank - a) % copies * size, size))
    for (tier, _), items in used.items():
        end = 0
        for at, size in sorted(items):
            assert at >= end
            end = at + size
        assert end <= tier
    for size, n in histogram.items():
        ranks = sorted(r for s, a, b, *_ in slots if s == size for r in range(a, b))
        assert ranks == list(range(n))


def _check(rows, sizes, capacity):
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append((r.doc_offset, r.size))
    for doc, size in sizes.items():
        parts = sorted(seen.pop(doc, []))
        assert sum(s for _, s in parts) == size
        assert len(parts) == max(1, -(-size // capacity)) if size else not parts
    assert not seen
    fill = {}
    for r in rows:
        fill.setdefault(r.container, []).append((r.container_offset, r.size))
    for items in fill.values():
        end = 0
        for at, size in sorted(items):
            assert at >= end
            end = at + size
        assert end <= capacity
    return fill


def test_packing_is_whole_disjoint_and_full(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([1, rng.randint(1, 300), rng.randint(1, 1100), 4096, rng.randint(4097, 20000)]) for i in range(4000)} | {9000: 0}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()] + [(9001, None, "x")], "doc_id long, size long, step string")
    rows = pk.pack(df).collect()
    fill = _check(rows, sizes, 4096)
    assert sum(sizes.values()) / (len(fill) * 4096) > 0.98
    assert sorted(r.doc_id for r in pk.found(pk.pack(df)).collect()) == sorted(k for k, v in sizes.items() if v > 4096)
    report = pk.fill_report(pk.pack(df, step_containers=16)).first()
    assert report.containers == len(fill) and report.largest_step - report.smallest_step <= 2 * 4096


def test_null_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "é" * 3000), (2, None), (3, ""), (4, "ab"), (4, "ab")], "doc_id long, text string")
    rows = pk.pack(pk.sized(docs)).collect()
    assert sorted((r.doc_id, r.piece, r.size) for r in rows) == [(1, 0, 4096), (1, 1, 1904), (4, 0, 2), (4, 0, 2)]
    assert pk.pack(pk.sized(docs.limit(0))).count() == 0
