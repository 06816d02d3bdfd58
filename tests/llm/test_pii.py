import random

from vellumine.llm import pii

LEX = pii.Lexicon(["Mira", "Will", "Rose"], ["Okonveda", "Quellard", "Virelli-Stohr"])


def found(text):
    return [(k, text[a:b]) for a, b, k in pii.find(text, LEX, pii.trained())]


def test_types():
    assert found("Write to Dr. Mira Quellard <{mira,q}@a.example> or q (at) b.example, tel. +44 (0)161 496 0675.") == [
        ("name", "Mira Quellard"), ("email", "{mira,q}@a.example"), ("email", "q (at) b.example"), ("phone", "+44 (0)161 496 0675")]
    assert found("Passport QQ 30 10 61 A; from 208B Hollowmere Road, Flat 1, Norwick to Quarryweg 12a, Norwick.") == [
        ("id_number", "QQ 30 10 61 A"), ("address", "208B Hollowmere Road, Flat 1, Norwick"), ("address", "Quarryweg 12a, Norwick")]
    assert found("Quellard, Rose; W. Virelli-Stohr; WILL OKONVEDA") == [("name", "Quellard, Rose"), ("name", "W. Virelli-Stohr"), ("name", "WILL OKONVEDA")]


def test_what_isnt_personal():
    for text in ("Quellard et al. (Okonveda, 2007) at precision @ 5, user@item.", "ISBN 978-0-000-37456-7, DOI 10.9999/a.2001.38, host 192.0.2.5.", "Grant No. HI-20-7946-47 on 2031-04-23 09:14:00.",
                 "The Saltmarsh Road corpus; Will you? May we; Rose grew.", "in the U.S. Quellard et al. said", "M. Quellard a relu tout.", "Prof. Okonveda and St. Quellard", ""):
        assert found(text) == [], text


def test_redaction_changes_nothing_else():
    text = "電話番号は+44 (0)161 496 0675です。\nMira Quellard: no."
    assert pii.redact(text, pii.find(text, LEX)) == "電話番号は[PHONE]です。\n[NAME]: no."


def test_decoding_equals_exhaustive_search():
    rng = random.Random(2)
    for _ in range(60):
        spans = []
        for _ in range(rng.randint(0, 9)):
            a = rng.randint(0, 30)
            spans.append((a, a + rng.randint(1, 9), "name", {"v": rng.uniform(-1, 2)}))
        best = 0.0
        for mask in range(1 << len(spans)):
            pick = sorted(spans[k] for k in range(len(spans)) if mask >> k & 1) if False else sorted((spans[k] for k in range(len(spans)) if mask >> k & 1), key=lambda s: s[:2])
            if all(x[1] <= y[0] for x, y in zip(pick, pick[1:], strict=False)):
                best = max(best, sum(s[3]["v"] for s in pick))
        got = pii.decode(spans, {"v": 1.0})
        assert abs(sum(s[3]["v"] for s in got) - best) < 1e-9


def test_training_generalises():
    rows = pii.training_rows(900, seed=8)
    lex = pii.Lexicon(pii._TRAIN_GIVEN, pii._TRAIN_FAMILY)
    weights = pii.fit(rows[:600], lex, {})
    hits = sum({(s, e, k) for s, e, k in pii.find(t, lex, weights)} == set(gold) for t, gold in rows[600:])
    assert hits / 300 > 0.9


def test_table(spark):
    docs = spark.createDataFrame([(1, "By Mira Okonveda and Zed Okonveda.", "x"), (2, "By Rose Okonveda; Zed Quellard", "x"), (3, "Will Quellard, Rose Quellard, Zed Arkwell, Mira Arkwell, Rose Arkwell", "x"), (4, None, "x"), (5, "", "x")], "doc_id long, text string, pii string")
    given = spark.createDataFrame([("Mira",), ("Rose",), ("Will",), (None,)], "given_name string")
    lex = pii.name_lexicon(docs, given)
    assert "zed" in lex.given and {"okonveda", "quellard", "arkwell"} <= lex.family
    got = {(r.doc_id, r.start_pos) for r in pii.details(docs, lex).where("pii = 'name'").collect()}
    assert {(1, 3), (1, 21), (2, 18)} <= got
    assert {r.doc_id: r.text for r in pii.redacted(docs, lex).collect()}[4] is None
    assert pii.details(docs.limit(0), lex).count() == 0


def test_a_repeated_pair_counts_once(spark):
    hot = [(k, "Typeset by Arvid Dunmarrow.") for k in range(100, 400)]
    rest = [(1, "We asked Mira Dunmarrow and Rose Dunmarrow."), (2, "We asked Arvid Okonveda, Arvid Quellard."), (3, "We asked Mira Okonveda, Rose Okonveda, Mira Quellard and Will Quellard.")]
    docs = spark.createDataFrame(hot + rest, "doc_id long, text string")
    lex = pii.name_lexicon(docs, spark.createDataFrame([("Mira",), ("Rose",), ("Will",)], "given_name string"))
    assert "dunmarrow" in lex.family and "arvid" in lex.given
    got = {(r.doc_id, r.start_pos) for r in pii.details(docs, lex).where("pii = 'name'").collect()}
    assert {(k, 11) for k, _ in hot} | {(1, 9), (1, 28), (2, 9), (2, 25)} <= got


def test_family_names_that_were_not_learned():
    assert found("Later on Mira Dunmarrow wrote to Rose Tarn-Hollow again.") == [("name", "Mira Dunmarrow"), ("name", "Rose Tarn-Hollow")]
    for text in ("Will Dunmarrow stay?", "It ended. Rose Garden was next.", "in the May Workshop", "As of May This year", "SEE WILL OTHERS"):
        assert found(text) == [], text


def test_marginals_equal_enumeration():
    import math

    rng = random.Random(4)
    for _ in range(40):
        spans = [(a, a + rng.randint(1, 8), "name", {}) for a in (rng.randint(0, 20) for _ in range(rng.randint(1, 7)))]
        scores = [rng.uniform(-2, 2) for _ in spans]
        total, mass = 0.0, [0.0] * len(spans)
        for mask in range(1 << len(spans)):
            pick = sorted((k for k in range(len(spans)) if mask >> k & 1), key=lambda k: spans[k][:2])
            if all(spans[x][1] <= spans[y][0] for x, y in zip(pick, pick[1:], strict=False)):
                weight = math.exp(sum(scores[k] for k in pick))
                total += weight
                for k in pick:
                    mass[k] += weight
        got, z = pii.marginals(spans, scores)
        assert abs(z - math.log(total)) < 1e-9 and all(abs(g - m / total) < 1e-9 for g, m in zip(got, mass, strict=True))


def test_training_moves_weights_and_generalises_to_other_templates(monkeypatch):
    weights = pii.trained()
    assert sum(abs(weights[k] - v) > 0.3 for k, v in pii.PRIORS.items()) > 15
    lex, every = pii.Lexicon(pii._TRAIN_GIVEN, pii._TRAIN_FAMILY), pii._TRAIN
    monkeypatch.setattr(pii, "_TRAIN", every[::2])
    half = pii.fit(pii.training_rows(480, seed=3), lex, pii.PRIORS)
    monkeypatch.setattr(pii, "_TRAIN", every[1::2])
    hits = wrong = missed = 0
    for text, gold in pii.training_rows(480, seed=4):
        got, gold = set(pii.find(text, lex, half)), set(gold)
        hits, wrong, missed = hits + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert 2 * hits / (2 * hits + wrong + missed) >= 0.95


def test_several_ends_of_one_start():
    assert found("By Mira Quellard Okonveda today.") == [("name", "Mira Quellard Okonveda")]
    assert found("By Mira Quellard Although it rained.") == [("name", "Mira Quellard")]


def test_more_names_than_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "By Mira Okonveda and Zed Okonveda."), (2, "By Rose Okonveda; Zed Quellard"), (3, "Will Quellard, Rose Quellard, Zed Arkwell, Mira Arkwell, Rose Arkwell; ZED ARKWELL; Zed Tam-Arkwell"), (4, None), (5, "")], "doc_id long, text string")
    given = spark.createDataFrame([("Mira",), ("Rose",), ("Will",)], "given_name string")
    lex = pii.name_lexicon(docs, given)
    monkeypatch.setattr(pii, "LEXICON_LIMIT", 2)
    table = pii.name_lexicon(docs, given)
    assert isinstance(lex, pii.Lexicon) and not isinstance(table, pii.Lexicon)
    for f in (pii.details, pii.redacted):
        assert sorted(map(str, f(docs, table).collect())) == sorted(map(str, f(docs, lex).collect()))
