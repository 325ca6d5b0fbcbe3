import time

import pytest

from stratapoint.llm import sentences as S

CASES = [
    "In 1408, it was made by Garrin.¦ 1783 saw the end!¦ What?!¦ After that it stood at St. Rin for 8 years.",
    "It was sold (approx. 8.59 km) e.g. Fenmer etc.¦ In the U.S.¦ This is version 2.0.1 of tileset.json!¦ Many in the U.S. stood.",
    'He said “Go. Now.” to the man.¦ “All of it stood in them.”¦ "Here too!"¦ (And here, too.)¦ The end',
    "It is and then... the end.¦ It went on...¦ In 1201, it was.¦ In c. 1860 it was no. 77.",
    "Am 27. Oktober kam er z. B. nach Halle u. a.¦ Im 14. Jahrhundert, d. h. später, war Nr. 24.¦ Dr. Mün ging.",
    "Elle va avec M. Sau et J.-P. Tou (p. ex. Vaux) !¦ Après « Quoi ? Rien ! » elle dort etc.¦ En 1301, fin.",
    "Ella va a EE. UU.¦ ¿Qué hace el Sr. Mogar en EE. UU. hoy?¦ Tras él (v. pág. 4) nada.",
    "Там стала около 84 рожная, т. е. карта, при Д. В. Ник и др.¦ В 1802 г. у реки.¦Эта шахта «Стой! Кто?» была.",
    "这座长约52.9公里，（见No. 77）并中村了建！¦他说：“走吧。快！”于是。¦后来东门……测谷了。",
    "毎年903人の測町が「行こう。早く！」と言い白した｡¦この橋は長い。",
    "ทุกตลาดระหว่างกาล¦ ต่อมากาลต่าง ๆ วิล¦ ในพ.ศ. 1775 ดาน(Ver. 2.2)¦ มีทะเล",
    "हर काल डॉ. पुर (98.5 कि.मी.) को किया।¦ बाद में “रुको! कौन?” हो गई?¦ वर्ष 1903 में।।",
    "Εκεί νικησε περίπου 713; Η λευική π.χ. Μορ κ.λπ. Το «Πού; Εδώ!»!".replace("; Η", ";¦ Η").replace("κ.λπ. Το", "κ.λπ.¦ Το"),
    "توجد نحو 438 و دان (ص. 71).. ثم فيل د. وان هذه؟ كل دان.".replace(").. ", ")..¦ ").replace("؟ ", "؟¦ "),
    'A big cat.<ref name="a.b" />¦ 1831 saw it {{lang|xx|Kaslor. Kastar!}} there.{{cn|date=May 2029}}¦ [http://a.b/c.d?e=1.2 Vil. La] x<sup>[3]</sup>.<sup>[3]</sup>¦ End.',]


@pytest.mark.parametrize("case", CASES)
def test_lines(case):
    parts = case.split("¦")
    line = "".join(parts)
    want, at = [], 0
    for p in parts:
        at += len(p)
        want.append(at)
    got = S.line_ends(line)
    assert got == want, [line[a:b] for a, b in zip([0, *got[:-1]], got, strict=True)]


def test_running_lines():
    text = "== Head. ==\r\nOne. Two.  \r\n\r\n* item. x\n | cell. y\n三。四\n<!-- a. b -->\n"
    assert [text[:e].splitlines()[-1] for e in S.ends_of(text, {})] == ["One.", "One. Two.", "三。", "三。四"]


def test_capitals():
    line = "AND SAID “GO. NOW.” TO THE I.E. THE END. THIS WAS IT."
    assert S.line_ends(line) == [line.index("END.") + 4, len(line)]


def test_table(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "One. Two"), (5, "x" * 100_000 + ". Y. " * 2000 + "End. Of it.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, end_pos string")
    got = S.sentence_ends(df).collect()
    assert {(r.doc_id, r.end_pos) for r in got if r.doc_id < 5} == {(4, 4), (4, 8)} and sum(r.doc_id == 5 for r in got) >= 2
    units = {(r.number, r.sentence) for r in S.sentences(df).collect() if r.doc_id == 4}
    assert units == {(1, "One."), (2, "Two")}
    assert S.sentence_ends(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def greedy(line, monkeypatch):
    """Every stop taken or left by its own score, without a look at spans."""
    with monkeypatch.context() as m:
        m.setattr(S, "_best_path", lambda ends: [e for e, _, score, pair in ends if (score > 0 and (pair is None or e > pair[1])) or e == ends[-1][0]])
        return S.line_ends(line)


@pytest.mark.parametrize("line", [
    "The plan was made at once. In no. The end of it came late.",  # too short for a doubtful end
    "They read about modern art. The gallery in the old town was closed. He went on.",
    'He told her “It was. It is.” He went on. “All of it. All.” He left.',  # only the second quotation is a whole span
    "Sie kam im Dez. Die Stadt am Fluss war leer. Am Abend ging sie fort.",
])
def test_spans_against_single_ends(line, monkeypatch):
    want = {
        "The plan": ["once.", "In no. The end of it came late."], "They read": ["art.", "closed.", "on."], "He told": ["He went on.", "All.”", "left."], "Sie kam": ["Dez.", "leer.", "fort."],
    }[" ".join(line.split()[:2])]
    ends = S.line_ends(line)
    got = [line[a:b].strip() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert len(got) == len(want) and all(g.endswith(w) for g, w in zip(got, want, strict=True))
    if line.startswith(("The plan", "He told")):
        assert greedy(line, monkeypatch) != ends


def test_initials_are_no_abbreviations():
    for case in ("В 1635 году карта при К. Г. Лесбор была стала.¦ Это было в 1976 г.¦ Конец.", "It was built with A. M. Kastar at 5 p. m.¦ The end.", "U. A. Berg kam nach Halle u. a.¦ Die Stadt.", "AND THEN... THE END.¦ IT WAS."):
        parts = case.split("¦")
        assert [sum(map(len, parts[: k + 1])) for k in range(len(parts))] == S.line_ends("".join(parts))


LONG = [
    "x. " * 100_000, "a." * 100_000, "(" + "X. " * 100_000 + ")", "“" * 60_000 + "A. " * 60_000, "(" * 60_000 + "] " * 60_000 + "x.", "<ref>a. " * 60_000, "{{a. " * 60_000, "<!-- a. " * 60_000, '"A. ' * 60_000,
    "ก " * 100_000, "。" * 100_000, ". , " * 60_000, "[[a. " * 60_000, "<a. " * 60_000, "http://a.b.c " * 30_000, "A.) " * 60_000, "...)" * 60_000, "etc. (" * 60_000,
]


@pytest.mark.parametrize("line", LONG, ids=[x[:8] for x in LONG])
def test_long_lines_take_linear_time(line):
    line = line.rstrip()
    began = time.time()
    ends = S.line_ends(line)
    assert time.time() - began < 6 and ends[-1] == len(line) and ends == sorted(set(ends))
