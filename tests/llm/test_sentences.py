import random

from vellumine.llm import sentences as s


def units(text):
    return [text[a:b] for a, b in s.units(text)]


def test_abbreviations_numbers_and_openers():
    text = 'Dr. Ruvenholt moved to the U.S. It took 3.5 h, e.g. at 5 p.m. Then we met W. Quellard et al. in vol. 12 of it. iOS failed. x-axis is fine.'
    assert units(text) == ["Dr. Ruvenholt moved to the U.S.", "It took 3.5 h, e.g. at 5 p.m.", "Then we met W. Quellard et al. in vol. 12 of it.", "iOS failed.", "x-axis is fine."]


def test_quotations_stay_whole():
    assert units('P3 said, "It froze. I gave up," and left. "Is this it?" asked one. She wrote: "Where?" We went.') == [
        'P3 said, "It froze. I gave up," and left.', '"Is this it?" asked one.', 'She wrote: "Where?"', "We went."]
    assert units("„Ich sah nichts. Gar nichts“, sagte P6. Am 3. Mai ging es.") == ["„Ich sah nichts. Gar nichts“, sagte P6.", "Am 3. Mai ging es."]
    assert units("参加者は「何も。本当に。」と述べた。次だ。") == ["参加者は「何も。本当に。」と述べた。", "次だ。"]
    assert units("他说：“没有。真的。”我们走。") == ["他说：“没有。真的。”", "我们走。"]


def test_scripts():
    assert units("क्या है? यह है। डॉ. Roe ने कहा।") == ["क्या है?", "यह है।", "डॉ. Roe ने कहा।"]
    assert units("ผลดีขึ้น 3 คน เราเสนอระบบ") == ["ผลดีขึ้น 3 คน เราเสนอระบบ".rsplit(" ", 1)[0], "เราเสนอระบบ"]
    assert units("Γιατί; Το είδαμε π.χ. εδώ.") == ["Γιατί;", "Το είδαμε π.χ. εδώ."]
    assert units("هل نجح؟ قال د. Roe نعم. تم.") == ["هل نجح؟", "قال د. Roe نعم.", "تم."]


def test_lines_marks_and_missing_blanks():
    assert units("[1] A. Roe and B. Doe. Title here. In Proc. X, 2001.\n(1) One. Two.\nTable 1: A. b.\n\n  p1 | 2. A | 3") == [
        "[1] A. Roe and B. Doe. Title here. In Proc. X, 2001.", "(1) One.", "Two.", "Table 1: A. b.", "p1 | 2. A | 3"]
    assert units("We did it.[3] Next one.As said.") == ["We did it.[3]", "Next one.", "As said."]
    assert units("Fine.Dr. Roe went.Im 2. Durchgang war es.No. 5 of it. In the U.S. It is.") == ["Fine.", "Dr. Roe went.", "Im 2. Durchgang war es.", "No. 5 of it.", "In the U.S.", "It is."]
    assert units("Small (p < .05). Fine (p = .01)! Go to https://a.example/v1.Two/x.html now.") == ["Small (p < .05).", "Fine (p = .01)!", "Go to https://a.example/v1.Two/x.html now."]


def test_empty_blank_and_odd():
    assert units("") == units("  \n \t") == []
    assert units("...") == ["..."] and units('"') == ['"'] and units(". . .") != []


def test_dp_equals_exhaustive_search():
    rng = random.Random(1)
    bits = ["We saw it. ", 'He said "no. Never" twice. ', "Dr. Roe ", "etc. ", 'so" ', "In 3. Mai ", "Why? ", "vol. 3 ", "U.S. "]

    def slow(line):
        lead, stop = len(line) - len(line.lstrip()), len(line.rstrip())
        places = s._candidates(line, lead)
        starts, ends = [lead, *[a for _, a, _ in places]], [*[e for e, _, _ in places], stop]
        points = [*[p for _, _, p in places], 0.0]
        state = [(0, 0), *s._quotes(line, ends)]
        best = None
        for mask in range(1 << (len(ends) - 1)):
            cuts = [k for k in range(len(ends) - 1) if mask >> k & 1] + [len(ends) - 1]
            v, i = 0.0, 0
            for j in cuts:
                v += s._length(ends[j] - starts[i]) + points[j] - 6.0 * (state[i] != state[j + 1])
                i = j + 1
            if best is None or v > best[0] + 1e-9:
                best = (v, cuts)
        i, out = 0, []
        for j in best[1]:
            out.append((starts[i], ends[j]))
            i = j + 1
        return best[0], out

    def value(line, spans):
        places = s._candidates(line, len(line) - len(line.lstrip()))
        points = {e: p for e, _, p in places}
        before = {a: st for a, st in zip([a for _, a, _ in places], s._quotes(line, [e for e, _, _ in places]), strict=True)}
        at = dict(zip([e for _, e in spans], s._quotes(line, [e for _, e in spans]), strict=True))
        return sum(s._length(b - a) + points.get(b, 0.0) - 6.0 * (before.get(a, (0, 0)) != at[b]) for a, b in spans)

    for _ in range(120):
        line = "".join(rng.choice(bits) for _ in range(rng.randint(1, 7))).strip()
        got = s.cut_line(line)
        assert abs(value(line, got) - slow(line)[0]) < 1e-6, line


def test_long_line_isnt_capped(monkeypatch):
    text = 'A "' + "Go. " * 400 + 'end" is. Then.'
    assert units(text)[-1] == "Then." and len(units("Go on. " * 3000)) == 3000


def test_table(spark):
    sec = spark.createDataFrame([(1, "All did. Can go.", "digital", "x"), (2, None, "digital", "x"), (3, " ", None, "x"), (1, "All did. Can go.", "digital", "x")], "section_id long, body string, pdf_kind string, unit string")
    ssc = spark.createDataFrame([(9, ["El Dr.", None, "Roe fue.", "Bien."], "digital"), (8, [], "digital"), (7, None, None), (6, [None], None)], "input_id long, sentences array<string>, pdf_kind string")
    rows = s.sentence_units(s.texts(sec, ssc)).collect()
    assert sorted((r.src, r.row_id, r.start_pos, r.text) for r in rows) == sorted([("sections", 1, 0, "All did."), ("sections", 1, 9, "Can go.")] * 2 + [("ssc_input", 9, 0, "El Dr. Roe fue."), ("ssc_input", 9, 16, "Bien.")])
    assert s.sentence_units(s.texts(sec.limit(0), ssc.limit(0))).count() == 0


def test_prose_with_an_ampersand_is_cut():
    assert units("Smith & Jones (2010) did it. We repeat it here. A | B holds too.") == ["Smith & Jones (2010) did it.", "We repeat it here.", "A | B holds too."]
    for row in ("P1 & I liked it. It froze. & 4 \\\\", "P2\tNo. Never.\tn/a\t3", "A & B & 2. C", "P1 | I liked it. It froze. | yes"):
        assert units(row) == [row], row


def test_long_quotations_stay_whole():
    inner = "One came. Two came. Three came. Four came. Five came. Six came. Seven came."
    for a, b in ("“”", '""', "„“", "«»", "»«"):
        assert units(f"We said {a}{inner}{b} and left. Then it ended.") == [f"We said {a}{inner}{b} and left.", "Then it ended."], a
    assert units(f'It is 5" wide. {inner} It is 6" long.')[:3] == ['It is 5" wide.', "One came.", "Two came."]
    assert units("Er sagte »nein« und ging. Wir auch. Sie sagte »ja« dann. Gut.") == ["Er sagte »nein« und ging.", "Wir auch.", "Sie sagte »ja« dann.", "Gut."]


def test_rows_and_captions_by_element(spark):
    ssc = spark.createDataFrame([(1, ["Table 1: A. B.", "We saw it. It", "held.", None, "P1 | 2. A | 3", "By", "Smith & Jones", "it is. Done."], "digital")], "input_id long, sentences array<string>, pdf_kind string")
    sec = spark.createDataFrame([], "section_id long, body string, pdf_kind string")
    got = sorted(s.sentence_units(s.texts(sec, ssc)).collect(), key=lambda r: r.unit)
    assert [r.text for r in got] == ["Table 1: A. B.", "We saw it.", "It held.", "P1 | 2. A | 3", "By Smith & Jones it is.", "Done."]
    joined = "Table 1: A. B. We saw it. It held. P1 | 2. A | 3 By Smith & Jones it is. Done."
    assert all(joined[r.start_pos : r.end_pos] == r.text for r in got)


def test_unspaced_text_takes_time_in_proportion():
    import time

    for text in ("ab.Cd" * 200_000, "字a.B" * 100_000, "1. A " * 100_000, "x" * 500_000 + ".Y" * 1000):
        began = time.perf_counter()
        spans = s.units(text)
        assert time.perf_counter() - began < 20 and spans[0][0] == 0 and spans[-1][1] == len(text.rstrip())


def test_openers_are_learned_from_line_starts(spark):
    rows = [(k, "Zebras run far. They stop.\nZebras and men met Quellard there.\nQuellard saw it.") for k in range(20)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    got = s.openers(df)
    assert "zebras" in got and "quellard" not in got and "the" in got
    assert s.openers(df.limit(0)) == s.OPENERS
    line = "All of the images of the second session were shown again to group B. Zebras run as far as they can in a day."
    assert len(s.units(line, True, got)) == 2 and len(s.units(line)) == 1
