"""Sentences of running text in many scripts, as a best path of whole sentence spans.

Every stop of a line (in Thai, every blank) is a possible end. A segmentation of the line is a sequence of spans, and its score the
sum of theirs. A span is scored as a whole: by its closing (the mark, the word before it, what is attached), by its opening (case,
script and usual first words), by its length (short spans count against it), and by whether quotation marks and brackets are balanced
in it. None of these decides alone: an abbreviation that hardly ever ends a sentence closes a span if what follows
opens like a sentence and both sides are long enough. The spans of greatest total are chosen by semi-Markov dynamic programming.
As the length counts up to a bound only, each end looks back over that many characters and takes the best of all before by a running
maximum, so the work is in proportion to the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Signs that begin a line which is no running text.
NOT_RUNNING = "=*#:;|!{}[<_&"

# Abbreviations that never end a sentence unless the line ends with them.
NEVER = frozenset(
    """
    mr mrs ms dr prof st mt ft gen col lt capt sgt rev hon sr sra srta messrs vs e.g i.e cf viz approx ca c al fig figs no nos nr vol vols p pp ch sec ed eds ver v art
    jan feb apr jun jul aug sep sept oct nov dec z b d h s bd bzw vgl evtl ggf inkl sog hl str mio mrd
    m mm mme mlle p.ex ex env t n núm aprox pág págs ee ej sres
    т е т.е им проф ок см стр рис акад ул тов св напр
    π.χ π κ κα περ δηλ σελ βλ αρ
    डॉ पृ श्री सं प्रो
    د ص أ م هـ
    ดร พ พ.ศ ค.ศ
    """.split()
)
# Abbreviations that may be the last word of a sentence.
MAY_END = frozenset(
    """
    etc inc ltd co corp jr u.s u.k u.n p.m a.m b.c a.d d.c u.a usw o.ä uu ee.uu
    т.д т.п др г гг н.э κ.λπ κλπ χλμ χιλ км कि.मी км/ч
    """.split()
)
# The letters before the last one of spaced abbreviations, by the last.
SPACED = {"a": ("u",), "ä": ("o",), "д": ("т",), "п": ("т",), "э": ("н",), "s": ("u",), "m": ("p", "a")}
# Of these, those written in capitals.
SPACED_CAPITALS = "s"
# Words that follow ordinal numbers.
AFTER_ORDINALS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jh jahrtausend mal tag auflage".split()
)
# Words after which an ellipsis goes on, where capitals hide how the next word begins.
GOES_ON = frozenset("and then but or und dann aber oder et puis mais ou y luego pero o и потом но или και μετά αλλά ή".split())
# Usual first words.
OPENERS = frozenset(
    """
    the a an in on after during this that these many it he she they there when while although im nach die der das sie eine ein es er
    en après elle il la le les une un tras ella el los los una во в после там эта этот каждая позже то το η ο μετά εκεί κάθε
    """.split()
)

_START = re.compile(r"<|\{\{|\[|(?:https?|ftp)://|&", re.I)
_SPAN = re.compile(
    r"""(?P<behind><ref\b[^<>]*/>|<sup>\s*\[[^<]*</sup>|</?[A-Za-z][^<>]*>)
    |(?P<link>\[\[[^\[\]]*\]\]|\[(?:https?:|ftp:)?//[^\[\]]*\])
    |(?P<url>(?:https?|ftp)://[^\s<>\[\]{}|"”»]*[^\s<>\[\]{}|"”».,;:!?)])
    |(?P<blank>&nbsp;|&\#160;|&emsp;|&ensp;|&thinsp;)
    |(?P<entity>&\#?\w{1,12};)""",
    re.I | re.X,
)
_REF = re.compile(r"<ref\b[^<>]*[^<>/]>|<ref>", re.I)
_REF_END = re.compile(r"</ref\s*>", re.I)
_BRACES = re.compile(r"\{\{|\}\}")
_HINT = re.compile(r"[<{&]|\[\[|//")
_IN_LINK = re.compile(r"[^\w\s]|(?<=\[)https?[^\s\]]*|(?<=\[)//\S*")
BEHIND, WORD = chr(0xE000), chr(0xE001)
MARKS = ".!?…。．！？｡؟۔।॥‼⁇⁈⁉"
_CLOSERS = ")\\]}”“\"»›’'」』》〉】）］" + BEHIND
_END = re.compile(f"[{MARKS}]+(?:[{_CLOSERS}]+[{MARKS}]+)*")
_END_GREEK = re.compile(f"[{MARKS};{chr(0x37E)}]+(?:[{_CLOSERS}]+[{MARKS};{chr(0x37E)}]+)*")
_PAIRS = re.compile("[()（）\\[\\]［］{}「」『』《》«»“”„\"]")
_OPEN = {"(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "「": "」", "『": "』", "《": "》", "«": "»", "„": "“”", "“": "”"}
_OPENED_BY = {c: "".join(o for o, ends in _OPEN.items() if c in ends) for ends in _OPEN.values() for c in ends} | {'"': '"'}
_NUMBERED = re.compile(r"\[[0-9]{1,3}\]")
_BEFORE = re.compile(r"[^\s()（\[“”«„\"" + BEHIND + WORD + r"、，。：:,;]*\Z")
_NEXT = re.compile(r"[\w" + chr(0x900) + "-" + chr(0x97F) + chr(0xE00) + "-" + chr(0xE7F) + r"]+")
_BLANKS = re.compile(r"\s+")
_CJK = re.compile("[" + chr(0x3041) + "-" + chr(0x30FF) + chr(0x3400) + "-" + chr(0x9FFF) + "]")
_THAI = re.compile("[" + chr(0xE00) + "-" + chr(0xE7F) + "]")
_GREEK = re.compile("[" + chr(0x370) + "-" + chr(0x3FF) + chr(0x1F00) + "-" + chr(0x1FFF) + "]")
_LATIN = re.compile(r"[A-Za-z]")
_LOWER_CASE = re.compile(r"[a-zà-öø-ÿа-яё" + "α-ω]")
_UPPER_CASE = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]")

NARROW = chr(0xA0) + chr(0x202F)
# Scores of spans. A boundary's closing and opening add up; below 0 it is no end unless the rest of the spans is worth it.
SURE = 6.0
LIKELY = 3.0
POSSIBLE = 2.0
DOUBTFUL = -1.0
UNLIKELY = -2.0
UNBALANCED = -20.0
#: What a beginning in small letters, or with a usual first word after a doubtful closing, adds.
SMALL = -8.0
OPENER = 2.5
#: Spans below ``TINY`` characters hardly are sentences; from ``SHORT`` on the length doesn't matter.
TINY, SHORT = 3, 24
#: Longer than any abbreviation listed, so what stands further before a stop can't change which one it is.
LOOK_BACK = 24


def _length(size: int) -> float:
    """How well a span of this many characters is a sentence, from -3 to 0."""
    return -3.0 if size < TINY else min(size / SHORT - 1.0, 0.0)


def _templates(line: str) -> dict[int, int]:
    """Ends of the templates that are closed in the line, by their begins, to any depth."""
    stack: list[int] = []
    out: dict[int, int] = {}
    for m in _BRACES.finditer(line):
        if m[0] == "{{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def _masked(line: str) -> str:
    """The line with what can't hold an end made harmless, every character in its place. Each closing mark is searched once."""
    parts: list[str] = []
    at = pos = 0
    templates = _templates(line) if "{{" in line else {}
    ref_end = comment_end = -1  # of the next closing mark; len(line) + 1: there is none
    none = len(line) + 1
    while m := _START.search(line, pos):
        k = m.start()
        end, kind = 0, "behind"
        if line.startswith("{{", k):
            end = templates.get(k, 0)
        elif line.startswith("<!--", k):
            if comment_end < k + 7:
                comment_end = line.find("-->", k + 4) + 3 or none
                comment_end = none if comment_end == 2 else comment_end
            end = comment_end if comment_end < none else 0
        elif line[k] == "<" and (r := _REF.match(line, k)):
            if ref_end < r.end():
                found = _REF_END.search(line, r.end())
                ref_end = found.end() if found else none
            end = ref_end if ref_end < none else r.end()
        if not end and (x := _SPAN.match(line, k)):
            end, kind = x.end(), x.lastgroup
        if not end:
            pos = k + (2 if line.startswith("{{", k) and not line.startswith("{{{", k) else 1)
            continue
        parts.append(line[at:k])
        size = end - k
        if kind == "behind":
            parts.append(BEHIND * size)
        elif kind == "link":
            parts.append(_IN_LINK.sub(lambda x: WORD * (x.end() - x.start()), line[k:end]))
        else:
            parts.append((chr(0xA0) if kind == "blank" else WORD) * size)
        at = pos = end
    parts.append(line[at:])
    return "".join(parts)


def _pairs(line: str) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets. How many of each sign are open is kept, so nothing is searched in vain."""
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    found: list[tuple[int, int]] = []
    for m in _PAIRS.finditer(line):
        c, at = m[0], m.start()
        if c == '"':
            close = open_.get(c, 0) > 0
        elif c == "“":
            close = open_.get("„", 0) > 0
        else:
            close = c not in _OPEN
        if not close:
            stack.append((c, at))
            open_[c] = open_.get(c, 0) + 1
            continue
        if not any(open_.get(o, 0) for o in _OPENED_BY.get(c, ())):
            continue
        while stack:
            sign, begin = stack.pop()
            open_[sign] -= 1
            if sign in _OPENED_BY[c]:
                found.append((begin, at))
                break
    if len(found) < 2:
        return found
    outer: list[tuple[int, int]] = []
    for o, c in sorted(found):
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    return outer


class _Words:
    """The first word at or after a place, for places in rising order."""

    def __init__(self, text: str) -> None:
        self.text, self.found, self.none = text, None, False

    def after(self, place: int) -> tuple[str, bool]:
        """The word, and whether a full stop follows it at once; both empty without one."""
        if not self.none and (self.found is None or self.found.start() < place):
            self.found = _NEXT.search(self.text, place)
            self.none = self.found is None
        if self.none:
            return "", False
        return self.found[0], self.text[self.found.end() : self.found.end() + 1] == "."


def _boundary(text: str, at: int, mark: str, end: int, follow: int, upcoming: str, stopped: bool, capitals: bool, cjk: bool) -> float:
    """Closing of the span with the mark at ``at`` and what is attached up to ``end``, and opening of the next at ``follow``."""
    n = len(text)
    last = mark[-1]
    if follow >= n:
        return SURE
    gap = follow > end
    if not gap and text[end] in ",:-–—/%°)]}、，：":
        return UNBALANCED
    first = upcoming[:1]
    if not first:
        return POSSIBLE if gap else DOUBTFUL
    small, big = first.islower() and not capitals, first.isupper()
    usual = upcoming.lower() in OPENERS and not small and not stopped
    opening = SMALL if small else 0.0
    if mark.strip(".…") == "" and mark != ".":
        if cjk:
            return UNBALANCED
        last_word = _BEFORE.search(text, max(0, at - LOOK_BACK), at) if capitals else None
        goes_on = last_word is not None and last_word[0].lower() in GOES_ON
        return (LIKELY if gap or big else -5.0) + opening + (SMALL if goes_on else 0.0)
    if last != ".":
        if last in "。！？｡．।॥؟۔":
            if last == "．" and at and text[at - 1].isdigit() and first.isdigit() and not gap:
                return UNLIKELY
            return SURE
        return (SURE if gap else LIKELY) + opening
    before = _BEFORE.search(text, max(0, at - LOOK_BACK), at)
    word_before = before[0].lower().lstrip("'’-–.¿¡") if before else ""
    tail = word_before.rpartition(".")[2].rpartition("-")[2]
    # a lone capital is an initial, not the abbreviation that is written with the small letter
    initial = len(tail) == 1 and not capitals and text[at - 1].isupper() and "." not in word_before
    if not gap:
        if not tail:
            return UNLIKELY
        if first.isdigit():
            return POSSIBLE if len(upcoming) >= 4 and upcoming[:4].isdigit() and tail.isalpha() and len(tail) > 2 else UNLIKELY
        if len(tail) < 2 or word_before in NEVER or tail in NEVER or word_before in MAY_END or "." in word_before:
            return UNLIKELY
        if not big and not cjk and (0x0900 <= ord(first) <= 0x097F):
            return UNLIKELY
        return POSSIBLE + opening
    if (word_before in MAY_END and not initial) or (len(tail) == 1 and _spaced(text, at, tail) and (not initial or tail in SPACED_CAPITALS)):
        # in capitals the case of what follows tells nothing, so it has to be a usual first word or a number
        return (DOUBTFUL + (LIKELY if upcoming.lower() in OPENERS or first.isdigit() else 0.0) if capitals else POSSIBLE) + opening
    if word_before in NEVER or tail in NEVER:
        # letters and what is abbreviated in several parts go on with any word
        return UNLIKELY + (OPENER if usual and not capitals and len(tail) > 1 and "." not in word_before else 0.0) + opening
    if len(tail) == 1 and tail.isalpha() and not (0x3040 <= ord(tail) <= 0x9FFF):
        return UNLIKELY + opening
    if tail.isdigit() and upcoming.lower() in AFTER_ORDINALS:
        return UNLIKELY + opening
    return SURE + opening


def _spaced(text: str, at: int, tail: str) -> bool:
    firsts = SPACED.get(tail)
    if not firsts:
        return False
    k = at - 2
    while k > 0 and text[k].isspace():
        k -= 1
    return k > 0 and text[k] == "." and text[k - 1].lower() in firsts and (k < 2 or not text[k - 2].isalpha())


def line_ends(line: str) -> list[int]:
    """Ends of the sentences of one line of running text; the line has no blanks behind it."""
    n = len(line)
    text = _masked(line) if _HINT.search(line) else line
    plain = text.isascii()
    thai = greek = cjk = False
    if not plain:
        if _THAI.search(text):
            thai = len(_THAI.findall(text)) > len(_LATIN.findall(text))
        elif _CJK.search(text):
            cjk = True
        elif _GREEK.search(text):
            greek = len(_GREEK.findall(text)) > len(_LATIN.findall(text))
    capitals = _LOWER_CASE.search(text) is None and _UPPER_CASE.search(text) is not None
    pairs = _pairs(text) if _PAIRS.search(text) else []
    opened = {o for o, _ in pairs}
    words = _Words(text)
    # possible ends: (end, start of what follows, score of the boundary, enclosing pair or None)
    ends: list[tuple[int, int, float, tuple[int, int] | None]] = []
    p = 0
    if thai:
        for m in _BLANKS.finditer(text):
            a, b = text[m.start() - 1], text[m.end()]
            if any(c in ".ๆ" or c.isdigit() or c.isascii() and c.isalpha() for c in (a, b)):
                continue
            while p < len(pairs) and pairs[p][1] < m.start():
                p += 1
            inside = pairs[p] if p < len(pairs) and pairs[p][0] < m.start() else None
            ends.append((m.start(), m.end(), SURE, inside))
    else:
        for m in (_END_GREEK if greek else _END).finditer(text):
            end = m.end()
            mark_at = end
            while mark_at > m.start() and (text[mark_at - 1] in MARKS or (greek and text[mark_at - 1] in ";" + chr(0x37E))):
                mark_at -= 1
            mark = text[mark_at:end]
            if mark[-1] in ";" + chr(0x37E):
                mark = "?"
            while end < n:
                c = text[end]
                if c == "[" and (x := _NUMBERED.match(text, end)):
                    end = x.end()
                elif c in _CLOSERS and end not in opened and c != "\\":
                    end += 1
                elif c in NARROW and text[end + 1 : end + 2] in ("»", "›"):
                    end += 2
                else:
                    break
            start = end
            while start < n and text[start].isspace():
                start += 1
            upcoming, stopped = words.after(start)
            score = _boundary(text, mark_at, mark, end, start, upcoming, stopped, capitals, cjk)
            while p < len(pairs) and pairs[p][1] < mark_at:
                p += 1
            inside = pairs[p] if p < len(pairs) and pairs[p][0] < mark_at else None
            ends.append((end, start, score, inside))
    if not ends:
        return [n]
    if ends[-1][0] < n:
        ends.append((n, n, SURE, None))
    else:
        ends[-1] = (n, n, SURE, None)
    return _best_path(ends)


def _best_path(ends: list[tuple[int, int, float, tuple[int, int] | None]]) -> list[int]:
    """The ends of the spans of greatest total score, the last end always among them."""
    best, back, starts = [0.0], [-1], [0]  # of place k, behind the k-th end: the best total of spans up to there
    by_start = {0: 0}
    far, far_who, passed = -1e18, 0, 0  # best of the places so far back that the length doesn't matter
    for j, (end, start, boundary, pair) in enumerate(ends, 1):
        while passed < j and end - starts[passed] >= SHORT:
            if best[passed] > far:
                far, far_who = best[passed], passed
            passed += 1
        top, who = far, far_who
        for i in range(passed, j):
            value = best[i] + (_length(end - starts[i]) if i else 0.0)
            if value > top:
                top, who = value, i
        if pair is not None:
            top += UNBALANCED
            i = by_start.get(pair[0])  # the whole span stands in the pair
            if i is not None and end > pair[1]:
                value = best[i] + (_length(end - starts[i]) if i else 0.0)
                if value > top:
                    top, who = value, i
        top += boundary
        # what begins within a pair that this span leaves open is out of balance too
        best.append(top + UNBALANCED if pair is not None and end <= pair[1] else top)
        back.append(who)
        starts.append(start)
        by_start.setdefault(start, j)
    out = []
    j = len(ends)
    while j > 0:
        out.append(ends[j - 1][0])
        j = back[j]
    return out[::-1]


def ends_of(text: str, known: dict[str, list[int]]) -> list[int]:
    """End positions of all sentences of a text. ``known`` keeps the ends of lines met before."""
    out: list[int] = []
    begin = 0
    for line in text.split("\n"):
        if line:
            c = line[0]
            if c not in NOT_RUNNING and not c.isspace():
                bare = line.rstrip()
                if bare:
                    found = known.get(bare)
                    if found is None:
                        found = known[bare] = line_ends(bare)
                    out += [begin + e for e in found] if begin else found
        begin += len(line) + 1
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[int]] = {}
    size = 0
    for batch in batches:
        sizes, ends = [], []
        for text in batch.column("text").to_pylist():
            found = ends_of(text, known)
            sizes.append(len(found))
            ends += found
            size += len(text)
            if size > 30_000_000:  # bounds the memory of lines met before
                known.clear()
                size = 0
        docs = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), np.array(sizes, np.int64)) if sizes else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "end_pos"])


def sentence_ends(documents: DataFrame) -> DataFrame:
    """documents: doc_id (unique), text. One row per sentence: doc_id, end_pos (code points up to and with its last one).

    Null, empty and blank texts have none. The work is done text by text where the rows are; nothing is shuffled.
    """
    texts = documents.where("doc_id is not null and text is not null and text != ''").select("doc_id", "text")
    return texts.mapInArrow(_cut, "doc_id long, end_pos long")


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, number (from 1), begin, end, sentence: the sentences themselves. ``begin`` skips blanks and lines between."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                last, number = 0, 0
                for end in ends_of(text, {}):
                    number += 1
                    line = text.rfind("\n", 0, end) + 1
                    begin = max(last, line)
                    while text[begin].isspace():
                        begin += 1
                    rows.append((doc, number, begin, end, text[begin:end]))
                    last = end
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "number", "begin", "end", "sentence"])

    texts = documents.where("doc_id is not null and text is not null and text != ''").select("doc_id", "text")
    return texts.mapInArrow(cut, "doc_id long, number long, begin long, end long, sentence string")
