import random

from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.operators import facets, geometry, layout, metrics, rank, segment, sequence

TOKENS = "record_id long, page_pos int, token_id int, parent int, text string, type string, confidence double, x1 double, y1 double, x2 double, y2 double, pw double, ph double"
BLOCKS = "record_id long, page_pos int, block_id int, type string, x1 double, y1 double, x2 double, y2 double, confidence double"


def test_block_takes_inner_token_and_leaves_the_other(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "t", 40.0, 50.0, 120.0, 200.0, 1.0)], BLOCKS)
    tokens = spark.createDataFrame([(1, 0, 0, 0, "a", None, None, 80.0, 90.0, 100.0, 150.0, 600.0, 800.0), (1, 0, 1, None, "b", None, None, 80.0, 90.0, 100.0, 450.0, 600.0, 800.0)], TOKENS)
    got = {r.token_id: r.block_id for r in geometry.assign(tokens, blocks).collect()}
    assert got == {0: 0, 1: None}
    flat = layout.to_table(blocks, tokens).orderBy(["is_block", "id"], ascending=[False, True]).collect()
    assert [(r.text, r.parent) for r in flat] == [(None, -1), ("a", 0), ("b", None)]
    kinds = {r.text: r.type for r in layout.inherit(blocks, tokens).collect()}
    assert kinds == {"a": "t", "b": None}
    nested = layout.from_table(layout.to_table(blocks, tokens)).first()
    assert [t.text for t in nested.bundles[0].tokens] == ["a"] and [t.text for t in nested.remaining_tokens] == ["b"]


def _capped(rows, per_block, overall):
    """Brute force of the group-capped top-k."""
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[0])):
        seen[r[5]] = seen.get(r[5], 0) + 1
        if overall is not None and len(seen) >= overall:
            break
        if seen[r[5]] <= per_block:
            out.append(r[0])
    return sorted(out)


def test_group_capped_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"p{i % 3}", rng.randint(0, 40), "Result", rng.choice([0.1, 0.5, 0.5, 0.9]), rng.randint(0, 6)) for i in range(240)]
    df = spark.createDataFrame(rows, "pred_id long, paper_id string, pos int, label string, prob double, block_id int")
    for per, overall in ((1, None), (2, None), (1, 3), (2, 4)):
        got = sorted(r.pred_id for r in rank.top_k_group_capped(df, "Result", per, overall).collect())
        want = sorted(x for p in range(3) for x in _capped([r for r in rows if r[1] == f"p{p}"], per, overall))
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300), st.integers(1, 40))
def test_halves_cover_the_sequence(n, most):
    parts = sequence.halves(n, most)
    assert [a for a, _ in parts] == [sum(m for _, m in parts[:k]) for k in range(len(parts))]
    assert sum(m for _, m in parts) == n and all(m <= most for _, m in parts)


def test_halving_is_uneven(spark):
    assert [m for _, m in sequence.halves(21, 10)] == [10, 5, 6]
    df = spark.createDataFrame([(1, list(range(23)))], "id long, a array<int>")
    assert [len(r["items"]) for r in sequence.halve(df, ["id"], "a", 6).orderBy("part").collect()] == [5, 6, 6, 6]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_lcs_equals_recursion(a, b):
    def slow(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + slow(i + 1, j + 1) if a[i] == b[j] else max(slow(i + 1, j), slow(i, j + 1))

    assert metrics.lcs(a, b) == slow(0, 0)


def test_rouge_takes_best_precision_and_recall_apart():
    assert metrics.rouge_l_score("a b c", ["a b c"]) == 1.0
    assert metrics.rouge_l_score("a b", ["x", None]) == 0.0
    p, r = 1.0, 1.0
    assert metrics.rouge_l_score("a b", ["a b c d", "a"]) == (1 + 1.44) * p * r / (r + 1.44 * p)


def test_carry_forward_over_chunks_of_one_large_paper(spark):
    rows = [(i, "p", i, "h" if i == 3 else None) for i in range(1000)] + [(2000, "q", 0, None)]
    df = spark.createDataFrame(rows, "section_id long, paper_id string, pos int, header string")
    got = {r.section_id: r.carried for r in facets.carry_forward(df, "paper_id", ["pos", "section_id"], "header", width=16).collect()}
    assert [got[k] for k in (2, 3, 15, 16, 999, 2000)] == ["", "h", "h", "h", "h", ""]


def test_longest_run_prefers_the_first(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 5, 6, 9)], "k string, n int")
    assert segment.longest_run(df, "k", "n").collect()[0].asDict() == {"k": "a", "start": 1, "length": 2}


def test_results_dont_depend_on_partitions(spark, data):
    from vellumine.sources import canonical

    t, b = canonical.tokens(spark, data), canonical.blocks(spark, data)
    one = sorted(map(tuple, geometry.assign(t.repartition(1), b.repartition(1)).collect()), key=str)
    many = sorted(map(tuple, geometry.assign(t.repartition(7), b.repartition(5)).collect()), key=str)
    assert one == many and len(one) == t.count()
