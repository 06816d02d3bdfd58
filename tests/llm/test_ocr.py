import math

import pytest
from pyspark.sql import functions as F

from vellumine.llm import ocr


def test_lines():
    text = "The thres-\np. 344\nQuellard and Quellard\nhold of 8.5 was chosen for a semi-\nautomatic reader. It held in\n(6)\n12 Transactions on Text Entry, Vol. 5, No. 4\nthe study by Roe and\nDoe. Since\n2014. Labels follow the layout of\nKrontveit et al.\n\nNext\n368.\npart."
    events, words = ocr.scan_lines(text)
    kinds = sorted((p, k) for p, k, *_ in events if k != "cut")
    assert kinds == [(1, "page_number"), (2, "running_header"), (6, "running_header"), (13, "page_number")]
    assert [(p, a, b) for p, k, a, b, _ in events if k == "cut"] == [(0, "thres", "hold"), (3, "semi", "automatic")]
    assert dict(words)[3] == ["of", "8.5", "was", "chosen", "for", "a"]


def test_cut_off_headers():
    text = "one segmentation in 19 had to be\nPreprint, dr\ndiscarded by Roe and\nal. The layout of the marker kept\nRuvenholt et\nits form while Roe et\nal. went."
    assert [(p, k) for p, k, *_ in ocr.scan_lines(text)[0]] == [(1, "running_header"), (4, "running_header")]


def test_elements():
    events, _ = ocr.scan_elements([None, "In acces- sible reading. 347", "A. Quellard", "27 dashboards done.", "We were 9 Preprint, under review seen.", "[ 12 ]", "Roe et al. did it in 2014.", "ended comp¬", "leted.", "124 We went."])
    assert sorted((p, k) for p, k, *_ in events) == [(1, "cut"), (1, "page_number"), (2, "running_header"), (4, "running_header"), (5, "page_number"), (7, "cut"), (9, "page_number")]


def test_endless_words():
    for word in ("a1" * 300_000, "ab" * 300_000, "A" * 300_000 + "-"):
        assert len(ocr.scan_elements([word + " x"])[0]) == word.endswith("-")
        assert len(ocr.scan_lines(word + "\n" + "words of the text\n" * 3)[0]) == word.endswith("-")


def test_variants_hold_the_printed_word():
    for wrong, right in (("r0unds", "rounds"), ("betweeri", "between"), ("cornpared", "compared"), ("me@sured", "measured"), ("ge5†ure", "gesture"), ("dassifier", "classifier"), ("difﬁcile", "difficile")):
        assert right in dict(ocr.variants(wrong))


LONG = ["the readers measured every gesture during the second session", "every marker in the second layout was kept during the session", "readers measured the layout and the marker during every session"]


def _tables(spark):
    clean = [(100 + i, "\n".join(LONG), "digital") for i in range(40)]
    noisy = [(1, "the readcrs measured every ges-\nture during the sec-\nond session. The mar-\n\n- 12 -\nker was kept. The well-\nkept layout.", "scanned"), (2, "the readcrs", "digital"), (3, None, "scanned"), (4, "", None), (5, "every rnarker\n7\nof the session", None)]
    sec = spark.createDataFrame([(*r, "x") for r in clean + noisy + [(200 + i, "the well-kept layout of the session", "digital") for i in range(3)]], "section_id long, body string, pdf_kind string, noise string")
    ssc = spark.createDataFrame([(1, ["The lay- out was kept", None, "42"], None), (2, [], "scanned"), (3, None, None), (4, ["42"], "digital")], "input_id long, sentences array<string>, pdf_kind string")
    return sec, ssc


def test_found_and_repaired(spark):
    noise = ocr.Noise(*_tables(spark))
    got = sorted(tuple(r) for r in noise.found().collect())
    assert got == [("sections", 1, 0, "char"), ("sections", 1, 0, "hyphen"), ("sections", 1, 1, "hyphen"), ("sections", 1, 2, "hyphen"), ("sections", 1, 4, "page_number"),
                   ("sections", 5, 0, "char"), ("sections", 5, 1, "page_number"), ("ssc_input", 1, 0, "hyphen"), ("ssc_input", 1, 2, "page_number")]
    texts = {(r.src, r.row_id): r.text for r in noise.repaired().collect()}
    assert texts["sections", 1] == "the readers measured every gesture during the second session. The marker was kept. The well-kept layout."
    assert texts["sections", 5] == "every marker of the session" and texts["ssc_input", 1] == "The layout was kept"


def test_empty(spark):
    sec, ssc = _tables(spark)
    noise = ocr.Noise(sec.limit(0), ssc.limit(0))
    assert noise.found().count() == 0 and noise.repaired().count() == 0


def test_words_without_vectors_are_corrected_to(spark, monkeypatch):
    sec, ssc = _tables(spark)
    want = {("sections", 1, 0), ("sections", 5, 0)}
    for most in (10, 2):  # then some or all words have no vector
        monkeypatch.setattr(ocr, "MOST_VECTORS", most)
        noise = ocr.Noise(sec, ssc)
        assert noise.least > 100
        assert {(r.src, r.row_id, r.pos) for r in noise.found().where("noise = 'char'").collect()} == want


def test_short_lines_are_read():
    kinds = lambda text: [(p, k) for p, k, *_ in ocr.scan_lines(text)[0]]
    assert kinds("手法\n画面\n- 12 -\n手法分類器\n試作") == [(2, "page_number")]
    assert kinds("pen\nink\np. 7\nRoe et al.\nmap") == [(2, "page_number"), (3, "running_header")]
    assert kinds("pen\nsty-\nlus\nmap") == [(1, "cut")]
    assert [w for _, w in ocr.scan_lines("手\n法\n画\n面\n器\n試")[1]] == [["手"], ["法"], ["画"], ["面"], ["器"], ["試"]]
    assert ocr.scan_lines("a r \nX \ni v \n: \n8 8 \n9 9 \n. \n8 1 2 \nv \n4 \n[ \nc s \n. \nC \nL \n] ") == ([], [])


def test_mend_keeps_other_words():
    fixes = [(1, "char", "cat", "car", 0)]
    assert ocr.mend(["the cat sat.", "a cat and catalog"], fixes, True) == "the cat sat. a car and catalog"
    assert ocr.mend(["the cat sat.", "a catalog and cat"], fixes, True) == "the cat sat. a catalog and car"
    assert ocr.mend(["cat cat Cat"], [(0, "char", "cat", "car", 2)], True) == "cat cat Car"
    assert ocr.mend(["a readcrs readc-", "rs in readcrs"], [(0, "cut", "readc", "rs", 0), (0, "char", "readcrs", "readers", -1)], True) == "a readcrs readers in readcrs"


def test_headers_by_place_and_repetition():
    prose = ["the readers measured every gesture during the", "second session and kept every marker of the", "layout. The study was carried out by two of the"]
    for header in ("Human Factors Quarterly 12", "SIGMOD Record, March 2020", "CHI 2019 Paper 44"):
        text = "\n".join([prose[0], header, *prose[1:], header, "readers who knew the layout.", header])
        assert [(p, k) for p, k, *_ in ocr.scan_lines(text)[0]] == [(1, "running_header"), (4, "running_header"), (6, "running_header")]
    listed = "low-cost overlay of the first session\nOrbBoard Reader\ntracker for text entry\nNibTag Marker\nword"
    assert ocr.scan_lines(listed)[0] == []


def test_headers_of_other_texts(spark):
    prose = "the readers measured every gesture during the\n{}\nsecond session and kept every marker of the layout."
    rows = [(k, prose.format("Human Factors Quarterly 12"), "scanned") for k in (1, 2)] + [(3, "It ended here.\nHuman Factors Quarterly 13\nNext comes this.", "scanned"), (4, "It ended here.\nOther Title Words\nNext comes this.", "scanned")]
    sec = spark.createDataFrame(rows, "section_id long, body string, pdf_kind string")
    ssc = spark.createDataFrame([], "input_id long, sentences array<string>, pdf_kind string")
    noise = ocr.Noise(sec, ssc)
    assert sorted((r.row_id, r.pos) for r in noise.found().collect()) == [(1, 1), (2, 1), (3, 1)]
    assert {r.row_id: r.text for r in noise.repaired().collect()}[3] == "It ended here. Next comes this."


def test_context_decides(spark, monkeypatch):
    """A candidate whose vector fits the neighbours is taken, one that points away from them is not."""
    monkeypatch.setattr(ocr, "LEARNED", 0)
    words = sorted({w for line in LONG for w in line.split()})
    for away, want in ((set(), {("sections", 1, 0), ("sections", 5, 0)}), ({"readers"}, {("sections", 5, 0)}), ({"readers", "marker"}, set())):
        made = spark.createDataFrame([(w, [-1.0, 0.1] if w in away else [1.0, 0.1]) for w in words], "word string, vector array<double>")
        monkeypatch.setattr(ocr, "vectors", lambda *a, made=made: made)
        noise = ocr.Noise(*_tables(spark))
        assert {(r.src, r.row_id, r.pos) for r in noise.found().where("noise = 'char'").collect()} == want


def test_vectors_do_not_depend_on_size(spark, monkeypatch):
    """Every frequent word has a vector, and the same one if the input is repeated, spread or joined otherwise."""
    got = []
    monkeypatch.setattr(ocr, "misreadings", lambda scanned, words, vecs: got.append({r.word: list(r.vector) for r in vecs.collect()}))
    sec, ssc = _tables(spark)
    twice = (sec.unionByName(sec.withColumn("section_id", F.col("section_id") + 1000)).repartition(3), ssc.unionByName(ssc.withColumn("input_id", F.col("input_id") + 1000)))
    for most, broadcast, tables in ((2_000_000, 50_000, (sec, ssc)), (10, 50_000, (sec, ssc)), (2, 0, (sec, ssc)), (2_000_000, 50_000, twice)):
        monkeypatch.setattr(ocr, "MOST_VECTORS", most)
        monkeypatch.setattr(ocr, "BROADCAST_VECTORS", broadcast, raising=False)
        ocr.Noise(*tables)
        assert set(got[-1]) == {w for line in LONG for w in line.split()}
    for other in got[1:]:
        for word, vector in other.items():
            assert vector == pytest.approx(got[0][word], abs=1e-6)


def test_vectors_tell_neighbours(spark):
    kinds = [[f"{k}{i}" for i in range(6)] for k in "ab"]
    lines = [[kind[(i * j + s) % 6] for i in range(6)] for kind in kinds for j in (1, 5) for s in range(6)]
    scanned = spark.createDataFrame([("words", line) for line in lines] + [("words", ["alone"])] * 12, "kind string, words array<string>")
    vecs = {r.word: r.vector for r in ocr.vectors(scanned, ocr.vocabulary(scanned), 2).collect()}
    assert sorted(vecs) == sorted(kinds[0] + kinds[1])  # a word that stands near no other has none

    def fit(v, w):
        dot = lambda a, b: sum(x * y for x, y in zip(vecs[a], vecs[b], strict=True))
        return dot(v, w) / math.sqrt(dot(v, v) * dot(w, w))

    assert min(fit("a0", "a1"), fit("b0", "b1")) > 0.5 > 0 > max(fit("a0", "b0"), fit("a1", "b1"))
    only = scanned.where("size(words) = 1")
    assert ocr.vectors(only, ocr.vocabulary(only)).count() == 0
