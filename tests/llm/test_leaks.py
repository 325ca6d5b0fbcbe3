import itertools
import random

import regex

from stratapoint.llm import leaks

WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")


def brute(docs, items):
    out = set()
    for i, lang, t in items:
        if t is None:
            continue
        chars = lang in leaks.CHAR_LANGS
        a = WORD.findall(leaks.shown(t))
        a, n = (list("".join(a)), 30) if chars else (a, 13)
        grams = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
        for d, text in docs:
            w = WORD.findall(leaks.shown(text or ""))
            w = list("".join(w)) if chars else w
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, lang string, text string")
    return {tuple(r) for r in leaks.leaked(d, i, **kw).collect()}


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
THAI = "".join(chr(0xE01 + k % 40) for k in range(60))


def test_shown():
    assert leaks.shown("A [[b|C]] [[d]]s [http://x.y/z?q=1 E f] '''G''' <i>h</i><!-- i --> &amp; J&shy;k") == "a c ds  e f g h i  & jk"
    assert leaks.shown("[[File:a.svg|thumb|Cap [[x|tion]]]]") == "cap tion"
    assert leaks.shown("Straße " + chr(0x65) + chr(0x301)) == "strasse " + chr(0xE9)


def test_forms(spark):
    w = PASSAGE.split()
    items = [(1, "en", PASSAGE), (2, "th", THAI), (3, "en", "too short to be held"), (4, None, None), (5, "zh", "短")]
    docs = [
        (1, "before " + PASSAGE.upper() + " after"), (2, "x " + " ".join(w[:12]) + " y"), (3, "| " + " || ".join(w[2:15]) + "\n|-"), (4, "* [[a|" + w[0] + "]] <b>" + "</b>, ".join(w[1:14])),
        (5, " ".join(w[:6] + ["other"] + w[7:])), (6, None), (7, ""), (8, "ก" + " ".join(THAI[5:36])), (9, THAI[:29] + "x" + THAI[30:40]), (10, "{{Quote|text=" + "&nbsp;".join(w[3:]) + "}}"),
        (11, PASSAGE * 200), (12, " ".join(w[:7]) + chr(0x200B) + " " + w[7][:2] + chr(0xAD) + w[7][2:] + " " + " ".join(w[8:])),
    ]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and {d for d, i in got if i == 1} == {1, 3, 4, 10, 11, 12} and (8, 2) in got and (9, 2) not in got
    altered = run(spark, docs, items, substitutions=1)
    assert got <= altered and (5, 1) in altered


def test_many_items_and_a_full_filter(spark, monkeypatch):
    items = [(k, "en", PASSAGE.replace("one", f"w{k}")) for k in range(8)]
    docs = [(1, "w3 " + " ".join(PASSAGE.split()[1:])), (2, "nothing")]
    want = brute(docs, items)
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 10)
    assert run(spark, docs, items) == want
    monkeypatch.setattr(leaks, "FILTER_BITS", 1 << 7)
    assert run(spark, docs, items) == want


def test_a_word_over_and_over(spark):
    import time

    text = "ha " * 10_000
    began = time.time()
    assert run(spark, [(1, text), (2, "x " + "ha " * 12)], [(1, "en", text), (2, "th", "ก" * 10_000)]) == {(1, 1)}
    assert time.time() - began < 20


def test_least_number_of_altered_places(spark):
    w = PASSAGE.split()
    docs = spark.createDataFrame([(1, " ".join(w[:13])), (2, " ".join(["x"] + w[1:13]) + ". " + " ".join(w[:5] + ["x", "y"] + w[7:13])), (3, " ".join(w[:5] + ["x", "y"] + w[7:12] + ["z"]))], "doc_id long, text string")
    got = leaks.passages(docs, spark.createDataFrame([(7, "en", " ".join(w[:13]))], "item_id long, lang string, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 7, 0), (2, 7, 1)}


def test_empty(spark):
    assert run(spark, [], []) == set() and run(spark, [(1, PASSAGE)], []) == set()


def test_altered_places_anywhere(spark):
    w = PASSAGE.split()[:13]
    items = [(1, "en", " ".join(w)), (2, "th", THAI[:30])]
    docs, want = [], set()
    for item, places, blank in ((1, w, " "), (2, list(THAI[:30]), "")):
        for k in (1, 2, 3):
            for at in itertools.combinations(range(len(places)), k):
                docs.append((len(docs), blank.join("ฮ" if p in at else c for p, c in enumerate(places))))
                if k <= 2:
                    want.add((docs[-1][0], item))
    assert run(spark, docs, items, substitutions=2) == want


def test_covering_masks():
    for span in (leaks.WORDS, leaks.CHARS):
        for k in (1, 2, 3):
            masks = leaks.covering_masks(span, k)
            assert all(len(m) == span and m.count("1") >= 4 for m in masks)
            assert all(any(all(m[p] == "0" for p in at) for m in masks) for at in itertools.combinations(range(span), k))


def test_altered_places_may_be_the_only_ones_of_the_script(spark):
    text = "abcdefghijklmnopqrstuvwxyzabc" + THAI[0]
    assert run(spark, [(1, text.replace(THAI[0], "x"))], [(1, "th", text)], substitutions=1) == {(1, 1)}


def test_isolated_windows_with_altered_words(spark):
    rng = random.Random(3)
    for size in (13, 16, 20):
        words = [f"word{k}" for k in range(size)]
        docs = [(k, " ".join("zzz" if p in set(rng.sample(range(size), 1 + k % 2)) else w for p, w in enumerate(words))) for k in range(60)]
        want = {(d, 1) for d, t in docs if any(sum(a != b for a, b in zip(t.split()[s : s + 13], words[q : q + 13], strict=True)) <= 2 for s in range(size - 12) for q in range(size - 12))}
        assert run(spark, docs, [(1, "en", " ".join(words))], substitutions=2) == want
