from vellumine.llm import quality as q

COMMON = {"en": frozenset("the of and to in a is that for we".split()), "de": frozenset("der die und in".split()), "zh": frozenset("的 是 在".split())}
PROSE = "We show that the tracker is of use to readers in the lab, and that the layout is kept for a week. It is that which we expected of the study."


def _verdicts(spark, bodies, headers=()):
    rows = [(1000 + i, "body", f"{PROSE} In {i} rounds, the gap is {i * 7 % 90}.{i}% and we go on to the next of {i} readers.") for i in range(120)]
    rows += [(1000 + i, "header", h) for i, h in enumerate(["Introduction", "2 Method", "3.1 Results of Use", "Discussion", "A.2 Setup"] * 24)]
    rows += [(i, "body", b) for i, b in enumerate(bodies)] + [(i, "header", h) for i, h in enumerate(headers)]
    df = spark.createDataFrame(rows, "section_id long, place string, text string")
    got = q.judged(df, COMMON).where("section_id < 1000").collect()
    return {(r.place, r.section_id): r.verdict for r in got}


def test_bodies(spark):
    bodies = ["- one item\n- two items\n- three items", "System | Acc | Rec\nP1 | 0.4 | n/a\nP2 | 3.2 ± 0.1 | -", "x x x x x x x x x x x x", "qz#xr ~fp tj&f ^th% gq~dv v&_ sr^zj tc%r ~x_g wqc",
              "9f" * 200, "", None, "  ", PROSE, PROSE.replace(".", "").replace(",", ""), PROSE + "\n(1) recall\n(2) speed", "low overlay\nword-level marker; 4 items\nprior corpus\nreader v2.1"]
    v = _verdicts(spark, bodies)
    assert [v.get(("body", i)) for i in range(len(bodies))] == ["list", "table", "junk", "junk", "junk", None, None, None, None, None, None, "list"]
    assert ("body", 5) not in v and ("body", 6) not in v and ("body", 7) not in v


def test_headers(spark):
    headers = ["† ‡ § ¶", "Table 7", "(cid:12)(cid:7)", "Evaluation of PinLens v2.0 (N = 19)", "4 Method", "", None, "a r X i v : 5"]
    v = _verdicts(spark, [], headers)
    assert [v.get(("header", i)) for i in range(len(headers))] == ["junk", None, "junk", None, None, None, None, "junk"]


def test_sketches_merge_and_order_dont_matter(spark):
    df = spark.createDataFrame([(i, "body", PROSE + " x" * (i % 9)) for i in range(60)], "section_id long, place string, text string")
    stats = q.statistics(df, COMMON).cache()
    whole = sorted(map(tuple, q.sketches(stats).collect()))
    parts = q.merge(q.sketches(stats.where("section_id < 20")), q.sketches(stats.where("section_id >= 20")))
    assert sorted(map(tuple, parts.collect())) == whole
    words = sorted(r.word_count for r in stats.collect())
    median = q.quantiles(q.sketches(stats)).where("stat = 'word_count'").first()["median"]
    assert abs(median - words[29]) <= 0.02 * words[29] + 0.5
    stats.unpersist()


def test_verdicts_follow_the_distribution_of_their_language(spark):
    """Lines without stops are a tail among prose, but not in a language where most texts have none."""
    bare = "low overlay\nword-level marker; 4 items\nprior corpus\nreader v2.1"
    assert _verdicts(spark, [bare])["body", 0] == "list"
    rows = [(k, "body", f"{bare}\nnotebook v{k}.{k % 7}" if k % 3 else f"{PROSE} In {k} rounds.") for k in range(150)]
    df = spark.createDataFrame(rows, "section_id long, place string, text string")
    assert q.found(q.judged(df, COMMON)).count() == 0


def test_table_labels_head_their_section(spark):
    v = _verdicts(spark, [], ["Table 7", "Figure 12", "Table 3"])
    assert set(v.values()) == {None}


def test_empty(spark):
    df = spark.createDataFrame([], "section_id long, place string, text string")
    assert q.judged(df, COMMON).count() == 0
