import json

from vellumine.operators import nested
from vellumine.plans import nested_queries

PAGE = {"width": "612.0", "height": 792, "index": 0, "layout": {"bundles": [{"bbox": [1, 2, 3, "4"], "type": "title", "tokens": {"7": {"text": "b"}, "2": {"text": "a"}, "9": None}}], "remaining_tokens": {"text": "r"}}}


def _found(spark, payloads):
    raw = spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string")
    pages = nested.identified(nested.typed_records(raw), "raw_records")
    return sorted(tuple(r)[1:] for r in nested.found(nested.occurrences(pages)).collect())


def test_container_forms_are_one(spark):
    rec = {"paper_sha": "x", "pages": [PAGE]}
    deep = json.loads(json.dumps(rec))
    deep["pages"] = json.dumps([{**PAGE, "layout": json.dumps(PAGE["layout"])}])
    forms = [json.dumps(rec), json.dumps({"data": rec}), json.dumps(json.dumps(rec)), json.dumps({"pages": PAGE}), json.dumps({"pages": {"5": PAGE}}), json.dumps(deep)]
    want = [("bundle", 0, 0, -1), ("page", 0, -1, -1), ("remaining", 0, -1, 0), ("token", 0, 0, 0), ("token", 0, 0, 1)]
    assert _found(spark, forms) == [(k, *w) for k in range(len(forms)) for w in want]


def test_payloads_without_pages_give_nothing(spark):
    bad = [None, "", "{", "null", "[]", "{}", '{"pages": 13}', '{"pages": null}', '{"pages": "x"}', '{"paper_sha": "a"}', '{"pages": [null, 3, "z"]}', '{"pages": []}']
    assert _found(spark, bad) == []


def test_null_entries_keep_their_place(spark):
    payload = json.dumps({"pages": [None, {"layout": {"bundles": [None, {"tokens": [None, {"text": "t"}]}], "remaining_tokens": [None, {}]}}]})
    assert _found(spark, [payload]) == [(0, "bundle", 1, 1, -1), (0, "page", 1, -1, -1), (0, "remaining", 1, -1, 1), (0, "token", 1, 1, 1)]


def test_identities_follow_content(spark):
    same = json.dumps({"pages": [PAGE]})
    other = json.dumps({"pages": [{**PAGE, "height": 800}]})
    raw = spark.createDataFrame([(1, same), (2, same), (3, other)], "record_id long, payload string")
    pages = nested.identified(nested.typed_records(raw), "raw_records")
    occ = nested.occurrences(pages)
    assert nested.pages_table(pages).count() == 2 and nested.bundles_table(pages).count() == 1 and nested.tokens_table(pages).count() == 3
    assert occ.where("lvl = 'page'").select("object_id").distinct().count() == 2
    links = nested.bridge(occ)
    assert links.where("role = 'bundle'").count() == 2 and links.where("role = 'token'").count() == 2
    # every occurrence is found again from the stored identities and the bridge
    assert occ.where("parent_id IS NOT NULL").join(links, ["parent_id", "object_id"], "left_anti").count() == 0


def test_empty_table_and_typed_nulls(spark):
    empty = spark.createDataFrame([], nested.RECORD)
    assert nested.occurrences(nested.identified(empty, "layouts")).count() == 0
    rows = spark.createDataFrame([(1, None, None), (2, "s", []), (3, "s", [None, (1.0, 1.0, 0, None)])], nested.RECORD)
    got = nested.found(nested.occurrences(nested.identified(rows, "layouts"))).collect()
    assert [tuple(r) for r in got] == [("layouts", 3, "page", 1, -1, -1)]


def test_found_comes_from_the_stored_tables(spark, data, monkeypatch):
    want = sorted(tuple(r) for r in nested.found(nested_queries.p6_occurrences(spark, data)).collect())
    assert sorted(tuple(r) for r in nested_queries.p6_found(spark, data).collect()) == want
    make = nested.bridge
    monkeypatch.setattr(nested, "bridge", lambda occ: make(occ).where("role <> 'token'"))
    assert sorted(tuple(r) for r in nested_queries.p6_found(spark, data).collect()) == [r for r in want if r[2] != "token"]


def test_occurrences_are_rebuilt(spark):
    payload = json.dumps({"pages": [None, PAGE, PAGE, {"layout": {"bundles": [None, PAGE["layout"]["bundles"][0], {"tokens": []}], "remaining_tokens": [None, {"text": "a"}]}}]})
    raw = spark.createDataFrame([(1, payload), (2, payload)], "record_id long, payload string")
    pages = nested.identified(nested.typed_records(raw), "raw_records")
    tables = nested.stored(pages)
    assert sorted(map(str, nested.rebuilt(tables["roots"], tables["bridge"]).collect())) == sorted(map(str, nested.occurrences(pages).collect()))
    assert [tables[k].count() for k in ("roots", "pages", "bundles")] == [6, 2, 2]


def test_records_keep_their_paper(spark):
    payloads = [json.dumps({"paper_sha": "ab", "pages": [PAGE, None]}), json.dumps({"data": {"paper_sha": 7, "pages": {}}}), "{", None]
    raw = spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string")
    got = sorted(map(tuple, nested.records_table(nested.typed_records(raw), "raw_records").collect()))
    assert got == [("raw_records", 0, "ab", 1), ("raw_records", 1, "7", 0), ("raw_records", 2, None, 0)]
