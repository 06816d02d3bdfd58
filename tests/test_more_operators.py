import random

from vellumine.operators import geometry, layout, metrics, scorers, segment, sequence

TOKEN = "record_id long, page_pos int, token_id int, parent int, text string, type string, x1 double, y1 double, x2 double, y2 double"


def test_nearest_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(1, p, k, None, "t", rng.choice(["a", "b", None]), x, y, x + 4.0, y + 2.0) for p in range(3) for k in range(40) for x, y in [(rng.uniform(-50, 300), rng.uniform(0, 300))]]
    rows += [(2, 0, 0, None, "t", None, 1.0, 1.0, 2.0, 2.0), (3, 0, 0, None, "t", None, None, None, None, None), (3, 0, 1, None, "t", "a", 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, TOKEN)
    got = {(r.record_id, r.page_pos, r.token_id): r.type for r in geometry.nearest(df.where("type IS NULL"), df.where("type IS NOT NULL"), "type").collect()}
    want = {}
    for a in rows:
        known = [b for b in rows if b[:2] == a[:2] and b[5] is not None]
        if a[5] is None and known:
            d = [(abs(a[6] + a[8] - b[6] - b[8]) / 2 + abs(a[7] + a[9] - b[7] - b[9]) / 2, b[2], b[5]) for b in known] if a[6] is not None else []
            best = min(d, default=(99, 0, ""))
            want[a[:3]] = best[2] if best[0] <= 50 else ""
    assert got == want


def test_words_in_sentences_inside_the_row(spark):
    df = spark.createDataFrame([(1, "One two. Three four!  five"), (2, ""), (3, None), (4, "a.b c"), (5, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.token_id, r.sent_id) for r in segment.tokens_to_sentences(df, "doc_id").collect())
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (4, 0, 0), (4, 1, 1), (5, 0, 0)]
    spans = sorted((r.doc_id, r.start, r.end) for r in segment.char_spans(df, "doc_id").where("doc_id = 1").collect())
    assert spans == [(1, 0, 3), (1, 4, 8), (1, 9, 14), (1, 15, 20), (1, 21, 25)]


def test_sentence_boxes_by_row(spark):
    rows = [(1, 0, k, None, t, None, float(k), float(r), k + 1.0, r + 1.0, r) for k, (t, r) in enumerate([("One", 0), ("two.", 0), ("Three", 0), ("four", 1), (None, 1)])]
    df = spark.createDataFrame(rows, TOKEN + ", row_id int")
    got = sorted(tuple(r) for r in segment.sentence_boxes(df, ["record_id", "page_pos"]).collect())
    assert got == [(1, 0, 0, 0, 0.0, 0.0, 2.0, 1.0), (1, 0, 1, 0, 2.0, 0.0, 3.0, 1.0), (1, 0, 1, 1, 3.0, 1.0, 4.0, 2.0)]


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(5)
    a, b = ({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)} for _ in range(2))

    def edit(x, y):
        if abs(len(x) - len(y)) > 1 or x == y:
            return 2
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y, strict=True))
        x, y = sorted((x, y), key=len)
        return 1 if any(y[:k] + y[k + 1 :] == x for k in range(len(y))) else 2

    got = layout.near_words(*(spark.createDataFrame([(w,) for w in s], "word string") for s in (a, b)))
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for x in a for y in b if edit(x, y) == 1)


def test_caption_labels_are_skipped_and_figures_stay(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "caption"), (1, 0, 1, "figure"), (1, 0, 2, "list"), (1, 0, 3, "caption"), (1, 0, 4, None)], "record_id long, page_pos int, block_id int, type string")
    kinds = {0: ["x", "x", "x", "title", "list"], 1: ["list"], 2: ["title", "list"], 3: ["x", "x"], 4: ["list"]}
    rows = [(1, 0, 10 * p + k, p, "t", t, 0.0, 0.0, 1.0, 1.0) for p, ts in kinds.items() for k, t in enumerate(ts)]
    out, tokens = layout.true_blocks_typed(blocks, spark.createDataFrame(rows, TOKEN))
    assert {r.block_id: r.type for r in out.collect()} == {0: "title", 1: "figure", 2: "title", 3: "caption", 4: "list"}
    assert [r.type for r in tokens.where("parent = 0").orderBy("token_id").collect()] == ["title", "title", "title", "title", "list"]


def test_every_predictor_beside_the_truth(spark):
    gt = spark.createDataFrame([(1, "a"), (2, "b")], "id long, gt string")
    one, two = (spark.createDataFrame(r, "id long, pred string") for r in ([(1, "x")], [(2, None), (3, "z")]))
    got = sorted(tuple(r) for r in metrics.beside_truth(gt, {"one": one, "two": two}, ["id"], "paragraph").collect())
    assert got == [(1, "a", "one", "x"), (1, "a", "two", "paragraph"), (2, "b", "one", "paragraph"), (2, "b", "two", "paragraph")]


def test_a_failing_scorer_leaves_nulls(spark):
    def fails(batches):
        for pdf in batches:
            if (pdf["sentence"] == "bad").any():
                raise ValueError("refused")
            yield from scorers.stub_sentences(iter([pdf]))

    df = spark.createDataFrame([(1, ["ok", "bad", None]), (2, []), (3, ["fine"])], "input_id long, sentences array<string>")
    got = {(r.input_id, r.sentence): r.label for r in scorers.classify_sentences(df, fails).collect()}
    assert got[1, "bad"] is None and got[1, "ok"] and got[3, "fine"] and len(got) == 3


def test_boxed_windows(spark):
    rows = [(1, 0, k, None, "abcdefghi", None, float(k), 0.0, 1.0, 1.0, 5 + k, 100 * k) for k in range(3)]
    df = spark.createDataFrame(rows, TOKEN + ", label int, bx int")
    got = sequence.boxed_windows(df, ["record_id", "page_pos"], "label", ["bx"], size=8).orderBy("win").collect()
    assert [r.labels for r in got] == [[-1, 5, -1, -1, 6, -1, -1, -1], [-1, 7, -1, -1, -1, -1, -1, -1]]
    assert [r.mask for r in got] == [[1] * 8, [1] * 5 + [0] * 3]
    assert [r.bx for r in got] == [[0, 0, 0, 0, 100, 100, 100, 1000], [0, 200, 200, 200, 1000, 0, 0, 0]]
    assert sequence.boxed_windows(df.limit(0), ["record_id", "page_pos"], "label", ["bx"]).count() == 0


def test_lcs_of_long_texts_is_quick():
    a, b = ([str(k * m % 97) for k in range(4000)] for m in (3, 5))
    import time

    began = time.perf_counter()
    assert metrics.lcs(a, b) > 0 and time.perf_counter() - began < 2
