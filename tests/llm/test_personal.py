import pytest

from quern.llm import personal
from quern.llm.personal import Potentials, find, infer, spans_of_form


@pytest.fixture(scope="module")
def potentials():
    texts = [f"Reported by {g} {f}, reachable at {g.lower()}@x.example. The Event Loop is slow.\nThanks, {g}\nGrace Period and Hash Join are explained.\nPlease ask {g} {f} before changing it." for g in ("Runa", "Ivo", "Esteban", "Wanda") for f in ("Tarrowby", "Kalvenda", "Draycombe")]
    return Potentials(["Runa", "Ivo", "Wanda"], ["Tarrowby", "Draycombe"]).fit(texts)


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("mail a.b+c@x-y.example now", "email", "a.b+c@x-y.example"), ("at runa78 [at] post [dot] borealis [dot] test.", "email", "runa78 [at] post [dot] borealis [dot] test"), ("anouk90 at pebble dot example.", "email", "anouk90 at pebble dot example"),
        ("(+33 1 99 00 67 45)", "phone", "+33 1 99 00 67 45"), ("Call (884) 555-0125 now", "phone", "(884) 555-0125"), ("0049 (0)30 23125771.", "phone", "0049 (0)30 23125771"), ("030/23125-372", "phone", "030/23125-372"), ("01.99.00.05.83", "phone", "01.99.00.05.83"),
        ("SSN 927 14 2635", "id_number", "927 14 2635"), ("NIF 99869622B.", "id_number", "99869622B"), ("QQ 34 73 84 C", "id_number", "QQ 34 73 84 C"), ("00 743 867 902.", "id_number", "00 743 867 902"),
        ("to 166 Kiln Avenue, Dunmore Hollow.", "address", "166 Kiln Avenue, Dunmore Hollow"), ("an Gerberstraße 81, 98765 Oberwalden.", "address", "Gerberstraße 81, 98765 Oberwalden"), ("au 240 bis, boulevard Vauclair.", "address", "240 bis, boulevard Vauclair"), ("a C/ Tejedores 158, 2º B.", "address", "C/ Tejedores 158, 2º B"),
    ],
)
def test_forms(text, kind, span):
    assert kind in personal.possible(text)
    assert [(k, text[s:e]) for s, e, k in spans_of_form(text)] == [(kind, span)]


@pytest.mark.parametrize("text", ["git@code:a/b.git", "tool@2.64.1 and @quill/x@7.1.0", "key 123-45-678941", "192.0.2.17", "035.01.2026 to 35.12.2026", "wrote 450505050 bytes", "932bb34-932bb34", "2026-08-18 18:48", "Error code 555-88", "Main Street is a name", "Lane 19 of the cache"])
def test_what_only_looks_like_it(text):
    assert spans_of_form(text) == []


def test_names(potentials):
    assert potentials.role.get("esteban") == "given" and potentials.role.get("kalvenda") == "family"
    spans = lambda t: [t[s:e] for s, e, k in find(t, False, potentials) if k == "name"]
    assert spans("Reported by Tarrowby, Runa, reachable at r@x.example.") == ["Tarrowby, Runa"]
    assert spans("Please ask E. Kalvenda before changing it.") == ["E. Kalvenda"]
    assert spans("Reported by esteban kalvenda, reachable at x.") == ["esteban kalvenda"]
    assert spans("Thanks, WANDA") == ["WANDA"] and spans("Grace Period and Hash Join are explained.") == []
    assert find("", False, potentials) == [] and find("x" * 100_000, True, potentials) == []
    code = "int ivo = 1;\n// ask Ivo Tarrowby before touching\n"
    assert [code[s:e] for s, e, _ in find(code, True, potentials)] == ["Ivo Tarrowby"]


def test_belief_propagation_equals_enumeration_on_a_tree():
    import itertools
    import math

    unary, edges = [0.3, -1.0, 0.5, -0.2], [(0, 1, 2.0, True), (1, 2, 1.2, False), (1, 3, 0.7, True)]
    weight = [0.0] * 4
    none = [0.0] * 4
    for y in itertools.product((0, 1), repeat=4):
        e = sum(u for u, v in zip(unary, y) if v) + sum((w if y[i] and y[j] else 0.0) if both else (w if y[i] == y[j] else 0.0) for i, j, w, both in edges)
        for i in range(4):
            (weight if y[i] else none)[i] += math.exp(e)
    got = infer(unary, edges, 50)
    assert got == pytest.approx([math.log(a / b) for a, b in zip(weight, none)], abs=1e-3)


def test_redaction_and_offsets(spark):
    docs = spark.createDataFrame([(1, "comment", "\U0001f389 mail a@b.example, Call (884) 555-0125"), (2, "source", "x = 1\n# hotline +49 30 23125 582\n"), (3, "page", None), (4, "page", ""), (5, "page", "Thanks, Runa")], "doc_id long, kind string, text string")
    names = spark.createDataFrame([("Runa", "given"), ("Tarrowby", "family"), (None, "given")], "person_name string, name_role string")
    got = {(r.doc_id, r.kind, r.start_char) for r in personal.personal_information(docs, names).collect()}
    assert {(1, "email", 7), (1, "phone", 25), (2, "phone", 16)} <= got and all(d in (1, 2, 5) for d, _, _ in got)
    text = {r.doc_id: r.text for r in personal.redacted(docs, names).collect()}
    assert text[1] == "\U0001f389 mail [EMAIL], Call [PHONE]" and text[2] == "x = 1\n# hotline [PHONE]\n" and text[3] is None and text[4] == ""
    assert personal.personal_information(docs.limit(0), names.limit(0)).count() == 0


def test_source_texts_are_searched_whole(potentials):
    code = 'def f():\n    """Sends a note.\n\n    Tell Ivo Tarrowby at 030/23125-372.\n    """\n    return "NIF 99869622B", "anouk90 [at] pebble [dot] example"\n/* opened\n Please ask E. Kalvenda, 166 Kiln Avenue, Dunmore Hollow.\n*/\nx = "Wanda Draycombe"\n'
    got = [(k, code[s:e]) for s, e, k in find(code, True, potentials)]
    assert got == [("name", "Ivo Tarrowby"), ("phone", "030/23125-372"), ("id_number", "99869622B"), ("email", "anouk90 [at] pebble [dot] example"), ("name", "E. Kalvenda"), ("address", "166 Kiln Avenue, Dunmore Hollow"), ("name", "Wanda Draycombe")]
    plain = "# mail anouk90 (a) pebble.example or go to Calle Mayor, 12\n"
    assert [plain[s:e] for s, e, _ in find(plain, True, potentials)] == ["anouk90 (a) pebble.example", "Calle Mayor, 12"]


def test_probes_in_source():
    p = Potentials(["Anna"], ["Schmidt"])
    for text, kind, value in (('PHONE = "+49 30 1234567"', "phone", "+49 30 1234567"), ('TEL = "+44 20 7946 0958"  # x', "phone", "+44 20 7946 0958"), ('ssn = "123-45-6789"', "id_number", "123-45-6789"), ('addr = "12 Baker Street, London"', "address", "12 Baker Street, London"), ('owner = "Anna Schmidt"', "name", "Anna Schmidt")):
        assert [(k, text[s:e]) for s, e, k in find(text, True, p)] == [(kind, value)]


def test_what_only_may_be_a_mention_is_decided_by_its_neighbours_and_its_like():
    given, family = ["Anna", "Hugo", "Mara", "Otto"], ["Schmidt", "Keller", "Brandt", "Vogel"]
    texts = [f"Please call {g} {f} on +49 30 12345{i}{j}.\nRange 0{i}.0{j}.2026 to 9.12.2026 in segment 087272{i}-087272{j}.\nThe tray of Widget {i} is full, ask {g} {f} first.\n" for i, g in enumerate(given) for j, f in enumerate(family)] * 4
    p = Potentials(given, family).fit(texts)
    assert p.form["phone"][0] != 0 and p.loose["phone"] < 0 and len(p.word) == 10 and p.word[1] > 0
    assert [k for *_, k in find("Range 02.04.2026 to 2.12.2026.", False, p)] == []
    # a number of no known form stays out by itself, but not beside the words that announce numbers and its like elsewhere
    assert ("phone", "0301234567") in [(k, t[s:e]) for t in ["Please call Anna Schmidt on 0301234567 today."] for s, e, k in find(t, False, p)]


def test_similar_words_share_an_edge():
    from quern.llm.personal import stem_of, value_of

    assert stem_of("lindqvale") == stem_of("lindqvales") and stem_of("anna's") == stem_of("anna") and stem_of("widget") != stem_of("window")
    assert value_of("phone", "+49 (0)30 1234-567") == value_of("phone", "0301234567")


def test_logistic_weights():
    import numpy as np

    from quern.llm.personal import logistic

    rng = np.random.default_rng(2)
    x = np.c_[np.ones(4000), rng.normal(size=(4000, 2))]
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [-1.0, 2.0, 0.0])))).astype(float)
    assert np.allclose(logistic(x, y), [-1.0, 2.0, 0.0], atol=0.2)


def test_potentials_are_of_all_texts(spark):
    known, learnt = ["Runa", "Ivo", "Wanda"], [("Esteban", "Tarrowby"), ("Ilvara", "Tarrowby"), ("Runa", "Kalvenda"), ("Runa", "Hastwick")]
    line = lambda g, f: f"Reported by {g} {f}, reachable at {g.lower()}@x.example. The Event Loop is slow.\nThanks, {g}\nGrace Period and Hash Join are explained.\nPlease ask {g} {f} before changing it on +49 30 1234567.\n____\n"
    texts = [line(g, f) for g in known for f in ("Tarrowby", "Draycombe")] * 3
    # names met in one long text only, and words met in one long source only
    texts.append("nothing to tell.\n" * 1500 + "".join(line(g, f) for g, f in learnt for _ in range(2)))
    sources = ["x = 1\n" * 5000 + "# the vessel, a vessel and vessel; Vessel\n"]
    docs = spark.createDataFrame([(i, "source" if t in sources else "page", t) for i, t in enumerate([*texts, *sources])], "doc_id long, kind string, text string")
    names = spark.createDataFrame([*((g, "given") for g in known), ("Tarrowby", "family"), ("Draycombe", "family")], "person_name string, name_role string")
    got = personal.fit_potentials(docs.repartition(3), names)
    assert got.role.get("esteban") == "given" and got.role.get("hastwick") == "family" and "vessel" in got.ordinary
    assert got.state() == Potentials(known, ["Tarrowby", "Draycombe"]).fit(texts, sources).state()


def test_lines_that_may_hold_forms_are_found_as_line_by_line():
    texts = ["n.º 5, Calle Mayor n.º 12\n@Override\n return 0\nf(a@b.example)\n", "٣٣٣ ٣٣٣ ٣٣\nLine٣ Rue", "no\n12 Baker Street, London\n\n x1, 2\r\n240 bis, boulevard Vauclair", "a\n+49 30\n1234567\n(884) 555-0125", "B, 7\nWeg 7\nanouk at pebble dot example", "\U0001f389 Weg 7\n\x1f3 Rue x\nfoo @bar.baz ＠x", ""]
    for text in texts:
        at, alone = 0, []
        for line in text.split("\n"):
            alone += [(at + s, at + e, k, sure) for s, e, k, sure in personal.candidates(line)]
            may = personal.possible(line)
            assert not may or (at, at + len(line)) in personal.lines_with_forms(text), (line, may)
            at += len(line) + 1
        assert personal.parts_of(text, False)[0] == alone


def test_lines_of_numbers_are_no_candidates_and_wide_gaps_are_seen():
    assert personal.lines_with_forms("1.56853, 6.56896, 3.47104,\nlead240 = get_value(state198, 683)\nWorker 5\nat 22 ms before 7 rows\n@bar\n8, 251, 59, 185, 139\n") == [(62, 70)]
    wide = "call\n+4930 ...... 1234\n"
    assert personal.possible(wide) >= {"phone"} and [(wide[s:e], k) for s, e, k, _ in personal.parts_of(wide, False)[0]] == [("+4930 ...... 1234", "phone")]


def test_texts_taken_together_have_the_parts_of_each_alone():
    texts = ["", "a\n+49 30 1234567", "", "\n\n", "mail a@b.example", "\U0001f389 Weg 7\n12b, Rue Haute 5\n", "12 bis, boulevard Vauclair\n\nQQ 34 73 84 C\n", "at at pebble dot example x at at pebble dot example", "٠٣٠١٢٣٤٥٦٧٨ 030/23125-372", "NIF 99869622B", "to\tAT pebble\tdot example", "Calle Mayor n.º 12, 3.º B"]
    alone = [[(s + a, s + b, k, sure) for s, e in [(m.start(), m.end()) for m in personal.re.finditer(r"[^\n]+", t)] for a, b, k, sure in personal.candidates(t[s:e])] for t in texts]
    assert sum(map(len, alone)) >= 8
    for piece in (1, 10, 1 << 20):
        assert personal.forms_of(texts, piece) == alone
    assert [p for *_, p in personal.all_parts([(t, False) for t in texts], 20)] == [personal.parts_of(t, False) for t in texts]


def test_no_candidate_is_lost_by_looking_for_lines_first():
    import random

    some = ["@", "＠", " at ", "(at)", "[at]", " dot ", ".", "anouk", "Baker", "Street", "rue ", "allée ", "Calle ", "n.º ", " bis", "b", ", ", ",", " ", "  ", "\t", "\n", "-", "/", "(0)", "+", "00", "03", "1", "12", "123", "12345", "٣٤", "é", "Œ", "AB", "Z", "_", "\U0001f389", "Rue"]
    rng = random.Random(4)
    texts = ["".join(rng.choice(some) for _ in range(40)) for _ in range(2000)]
    every = []
    for text in texts:
        every.append([])
        for line in personal.re.finditer(r"[^\n]+", text):
            taken = []
            for sure, forms in ((True, personal._FORMS), (False, personal._LOOSE)):
                for kind, rx in forms:
                    for m in rx.finditer(line.group()):
                        if (kind != "phone" or 8 <= sum(c.isdigit() for c in m.group()) <= 15) and all(m.end() <= s or m.start() >= e for s, e, _, _ in taken):
                            taken.append((m.start(), m.end(), kind, sure))
            every[-1] += [(line.start() + s, line.start() + e, kind, sure) for s, e, kind, sure in sorted(taken)]
    assert sum(map(len, every)) > 50 and personal.forms_of(texts) == every
