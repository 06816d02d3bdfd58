import json

import pytest
from pyspark.sql import functions as F

from vellumine.sources import readers, sinks
from vellumine.streaming import facets as stream


def test_layout_json_null_and_blocks(spark, tmp_path):
    page = {"width": 100.0, "height": 200.0, "index": 0, "layout": {"bundles": [{"bbox": [10, 20, 50, 100], "type": "list", "tokens": [{"text": "a"}, {"text": "b"}]}, {"bbox": [0, 0, 1, 1], "type": "paragraph", "tokens": []}], "remaining_tokens": []}}
    (tmp_path / "p1.json").write_text(json.dumps([page]))
    (tmp_path / "p2.json").write_text("null")
    got = readers.layout_json(spark, str(tmp_path))
    assert {r.doc_id: r.pages is None for r in got.collect()} == {"p1": False, "p2": True}
    b = readers.layout_blocks(got, "paragraph", "list").orderBy("type_order").collect()
    assert [(r.type, r.text, r.left, r.top) for r in b] == [("paragraph", "", 0.0, 0.0), ("list", "a b", 0.1, 0.1)]


def test_results_round_trip(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"u-3": [{"sentence": "A.", "label": "Background", "prob": 0.9}, {"sentence": "B.", "label": "Result", "prob": 0.4}]}))
    p = readers.ssc_results(spark, str(tmp_path))
    assert [(r.pos, r.label) for r in p.orderBy("pos").collect()] == [(0, "Background"), (1, "Result")]
    out = sinks.ssc_results(p).first()
    assert json.loads(out.json)["u-3"][1]["sentence"] == "B."


def test_jsonl_and_papers(spark, tmp_path):
    sinks.ssc_jsonl(spark.createDataFrame([("p", ["a", None])], "paper_id string, sentences array<string>"), str(tmp_path / "s"))
    assert readers.ssc_jsonl(spark, str(tmp_path / "s")).first().sentences == ["a", None]
    lines = [{"metadata": {"paper_id": "1", "year": 2016, "arxiv_id": "x"}, "pdf_parse": {"body_text": [{"section": "I", "text": "t"}]}}, {"metadata": {"paper_id": "2", "year": None, "arxiv_id": ""}, "pdf_parse": {"body_text": []}}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = readers.paper_jsonl(spark, str(tmp_path / "d.jsonl"))
    assert rows.count() == 2 and [r.paper_id for r in readers.with_year(rows, 2016).collect()] == ["1"]


def test_paper_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<PAPER><S>Title</S><ABSTRACT><S>x</S></ABSTRACT><SECTION title="One"><S>s1</S><S>s2</S></SECTION><SECTION title="Two"><S>s3</S></SECTION></PAPER>')
    p = readers.paper_xml(spark, str(tmp_path))
    row = p.first()
    assert (row.doc_id, row.title, row.abstract, row.sections[1].title) == ("a", "Title", ["x"], "Two")
    assert readers.paper_xml_sentences(p).first().sentences == ["s1", "s2", "s3"]
    assert json.loads(sinks.paper_json(p).first().json)["body"]["One"] == ["s1", "s2"]


def test_page_xml(spark, tmp_path):
    def box(tag, a, b, c, d):
        return f'<{tag}><Vertex x="{a}" y="{b}"/><Vertex x="{c}" y="{d}"/></{tag}>'

    word = f'<Word>{box("WordCorners", 5, 6, 1, 2)}<Character><GT_Text Value="h"/><Font Type="B"/></Character><Character><GT_Text Value="i"/><Font Type="A"/></Character></Word>'
    (tmp_path / "x.cxml").write_text(f'<Document><Page><Zone>{box("ZoneCorners", 0, 0, 9, 9)}<Classification><Category Value="BODY"/></Classification><Line>{box("LineCorners", 0, 0, 9, 9)}{word}{word}</Line></Zone></Page></Document>')
    got = readers.page_xml(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.line_id, r.text, r.x_1, r.y_2, r.font, r.category) for r in got] == [(0, 0, "hi", 1.0, 6.0, "B", "BODY"), (1, 0, "hi", 1.0, 6.0, "B", "BODY")]


def test_tsv_grouped_csv_fonts(spark, tmp_path):
    (tmp_path / "a.txt").write_text('w"q\t1\t2\t3\t4\t0\t0\t0\tF\tparagraph\n##LTLine##\t1\t2\t3\t4\t0\t0\t0\tF\tx\n')
    (tmp_path / "e.txt").write_text("")
    got = readers.token_tsv(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.id, r.text, r.x_2) for r in got] == [("a", 0, 'w"q', 3)]
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"data": [{"words": ["a"]}, {"words": []}], "labels": {"0": "x"}, "problematic_items": [1]}))
    assert [r.item for r in readers.grouped_json(spark, str(g)).collect()] == [0]
    t = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, "t", "c", None, 0.5, False)], readers.TABLE_V1)
    sinks.token_csv(t, str(tmp_path / "csv"))
    assert readers.token_csv(spark, str(tmp_path / "csv"), 1).first().parent == -1
    (tmp_path / "fonts.txt").write_text("A\nB\n")
    assert {r.font: r.font_id for r in readers.font_vocabulary(spark, str(tmp_path / "fonts.txt")).collect()} == {"A": 5, "B": 6}


def test_coco(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"papers": [], "images": [{"id": 1, "file_name": "doc_3.jpg", "height": 9, "width": 9, "paper_id": 1, "page_number": 3}, {"id": 2, "file_name": "doc_4.jpg"}], "annotations": [{"id": 7, "bbox": [10, 10, 5, 5], "image_id": 1, "category_id": 2, "area": 25}], "categories": [{"id": 2, "name": "Paragraph"}]}))
    rows = {r.image_id: r for r in readers.coco(spark, str(f), pad=2, names={"Paragraph": "paragraph"}).collect()}
    assert (rows[1].x1, rows[1].x2, rows[1].category) == (8.0, 17.0, "paragraph") and rows[2].id is None
    assert readers.coco(spark, str(f), names={}).where("image_id = 1").first().category is None
    images = spark.createDataFrame([(1, "doc_3.jpg", 9, 9)], "id int, file_name string, width int, height int")
    assert tuple(readers.image_info(images).first())[1:3] == ("doc", 3)


def test_words_from_chars(spark):
    rows = [("d", 0, k, c, 10.0 * k, 80.0, 10.0 * k + 8, 90.0, 100.0) for k, c in enumerate("ab c")]
    df = spark.createDataFrame(rows, "doc_id string, page_pos int, k int, text string, x1 double, y1 double, x2 double, y2 double, page_height double")
    got = readers.words_from_chars(df).orderBy("k").collect()
    assert [(r.text, r.x1, r.y1, r.x2, r.y2) for r in got] == [("ab", 0.0, 10.0, 18.0, 20.0), ("c", 30.0, 10.0, 38.0, 20.0)]


def test_extractors_by_name():
    readers.register_extractor("Plain", lambda b: b)
    assert readers.extractor("PLAIN")
    with pytest.raises(NotImplementedError):
        readers.extractor("none")


def test_block_lists_and_dead_letters(spark, data, tmp_path):
    from vellumine.sources import canonical

    out = sinks.block_lists_json(canonical.blocks(spark, data), canonical.pages(spark, data))
    first = json.loads(out.first().json)
    assert {"page", "blocks"} == set(first[0])
    bad = spark.createDataFrame([(1, "a.pdf")], "error_type int, pdf_name string")
    for _ in range(2):
        sinks.dead_letters(bad, str(tmp_path / "err"))
    assert spark.read.csv(str(tmp_path / "err"), header=True).count() == 2


def test_stream_handles_each_file_once(spark, tmp_path):
    schema = "paper_id string, section_id long, header string, body string"
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("p", 1, "Intro", "We show this. However, it fails.")], schema).write.parquet(src)
    for _ in range(2):
        stream.run_available(stream.section_stream(spark, src, spark.read.parquet(src).schema), out, state)
    assert sorted(r.label for r in spark.read.parquet(out).select(F.col("label")).collect()) == ["Author", "Method", "Novelty", "Result"]
    spark.createDataFrame([("q", 2, None, "We conclude.")], schema).write.mode("append").parquet(src)
    stream.run_available(stream.section_stream(spark, src, spark.read.parquet(src).schema), out, state)
    assert spark.read.parquet(out).where("paper_id = 'q'").count() == 3


def test_sizes_samples_and_ordered_sources(spark, tmp_path):
    sizes = spark.createDataFrame([("a", 0, 792.0, 612.0)], "savename string, page_id int, height double, width double")
    sinks.page_sizes_csv(sizes, str(tmp_path / "sizes"))
    assert tuple(readers.page_sizes_csv(spark, str(tmp_path / "sizes")).first()) == ("a", 0, 792.0, 612.0)
    (tmp_path / "s.tsv").write_text("id\tname\n1\tx y\n")
    assert tuple(readers.table_tsv(spark, str(tmp_path / "s.tsv"), "id int, name string").first()) == (1, "x y")
    c = spark.createDataFrame([("k", 1, None), ("k", 2, "b"), ("k", 3, "c"), ("m", 1, None)], "key string, rank int, url string")
    assert {r.key: r.url for r in readers.first_available(c, "key", "rank", "url").collect()} == {"k": "b", "m": None}
