from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import splitting as sp


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n。!x", max_size=400), st.integers(12, 60), st.integers(0, 9))
def test_round_trip_limits_and_overlap(text, limit, overlap):
    parts = sp.cut(text, limit, overlap)
    if not text:
        assert parts == []
        return
    rebuilt = text[parts[0][0] : parts[0][1]]
    for (_, e, _), (a, b, _) in zip(parts, parts[1:], strict=False):
        assert a == e - overlap
        rebuilt += text[a + overlap : b]
    assert rebuilt == text and all(0 < b - a <= limit for a, b, _ in parts)


def test_natural_cuts_are_taken_where_there_are_any():
    text = " ".join(["One two three four."] * 40)
    parts = sp.cut(text, 120, 0)
    assert {k for _, _, k in parts[:-1]} == {"sentence"}
    assert max(b - a for a, b, _ in parts) - min(b - a for a, b, _ in parts) <= 40
    assert {k for _, _, k in sp.cut("word " * 200, 100, 10)[:-1]} == {"blank"}
    assert "none" in {k for _, _, k in sp.cut("x" * 500, 100, 10)}


def test_dp_equals_brute_force():
    text, limit, overlap = "aa bb. cc dd, ee ff. gg hh ii. jj", 14, 2
    at, cost = sp.boundaries(text)
    n = len(text)
    ideal = (n - overlap) / max(2, -(-(n - overlap) // (limit - overlap))) + overlap
    points = [0, *at.tolist(), n]
    pen = dict(zip(at.tolist(), cost.tolist(), strict=True))

    def best(i):
        if points[i] == n:
            return 0.0
        out = float("inf")
        for j in range(i + 1, len(points)):
            length = points[j] - points[i] + (overlap if i else 0)
            if length <= limit and (i == 0 or points[i] >= overlap):
                out = min(out, ((length - ideal) / ideal) ** 2 + pen.get(points[j], 0.0) + best(j))
        return out

    got = sp.cut(text, limit, overlap)
    assert abs(sum(((b - a - ideal) / ideal) ** 2 + pen.get(b, 0.0) for a, b, _ in got) - best(0)) < 1e-9


def _cost_of_best(text, limit, overlap):
    """Least cost over all segmentations, by plain recursion over every position."""
    n, step = len(text), limit - overlap
    at, cost = sp.boundaries(text, step)
    pen = dict(zip(at.tolist(), cost.tolist(), strict=True))
    edge = [0, *at.tolist(), n]
    for a, b in zip(edge, edge[1:], strict=False):
        if b - a > step:
            pen.update(dict.fromkeys(range(a + 1, b), sp.PENALTY["none"]))
    pen[n] = 0.0
    ideal = (n - overlap) / max(2, -(-(n - overlap) // step)) + overlap
    best = {0: 0.0}
    for j in sorted(pen):
        best[j] = min((best[i] + ((j - i + (overlap if i else 0) - ideal) / ideal) ** 2 + pen[j]
                       for i in best if i < j and j - i + (overlap if i else 0) <= limit and (i == 0 or i >= overlap)), default=float("inf"))
    return best[n], pen, ideal


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["ab ", "c", "defg", ". ", ", ", "\n", "。", "xyzxyzxyzxyzxyz", "  "]), max_size=60).map("".join), st.integers(12, 60), st.integers(0, 9))
def test_least_cost_equals_brute_force(text, limit, overlap):
    if len(text) <= limit:
        return
    want, pen, ideal = _cost_of_best(text, limit, overlap)
    got = sp.cut(text, limit, overlap)
    assert abs(sum(((b - a - ideal) / ideal) ** 2 + pen[b] for a, b, _ in got) - want) < 1e-6
    assert any(k == "none" for _, _, k in got) == (sp.longest_stretch(text) > limit)


def test_far_clauses_against_one_blank():
    ends = [200, 500, 800, 1100, 1400, 1650, 2000, 2300, 2600, 2900, 3200]
    chars = ["x"] * 3480
    for e in ends:
        chars[e - 1 : e + 1] = ", "
    chars[1799] = " "
    text = "".join(chars)
    got = sp.cut(text, 1800, 120)
    want, pen, ideal = _cost_of_best(text, 1800, 120)
    assert len(got) == 2 and abs(sum(((b - a - ideal) / ideal) ** 2 + pen[b] for a, b, _ in got) - want) < 1e-6


def test_endless_stretch_takes_linear_time():
    import time

    began = time.perf_counter()
    parts = sp.cut("ab" * 50_000, 1800, 120)
    assert {k for _, _, k in parts[:-1]} == {"none"} and time.perf_counter() - began < 20
    assert [k for _, _, k in sp.cut("a " * 500 + "y" * 1750 + " b" * 500, 1800, 120)].count("none") == 0


def test_table_kinds(spark):
    long = "x" * 1801
    sec = spark.createDataFrame([(1, "ab " * 700), (2, long), (3, "short"), (4, None), (5, ""), (6, "y" * 1800 + " z")], "section_id long, body string")
    ssc = spark.createDataFrame([(1, [None, "w" * 321, "v " * 200, "s"]), (2, None), (3, [])], "input_id long, sentences array<string>")
    pieces = sp.split_items(sp.items(sec, ssc))
    got = sorted((r.src, r.row_id, r.pos, r.cut) for r in sp.found(pieces).collect())
    assert got == [("sections", 1, -1, "soft"), ("sections", 2, -1, "hard"), ("sections", 6, -1, "soft"), ("ssc_input", 1, 1, "hard"), ("ssc_input", 1, 2, "soft")]
    assert all(len(r.text) <= (1800 if r.src == "sections" else 320) for r in pieces.collect())
    assert sp.split_items(sp.items(sec.limit(0), ssc.limit(0))).count() == 0
