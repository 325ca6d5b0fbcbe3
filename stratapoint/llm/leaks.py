"""Evaluation passages that stand in documents, whole, in part or altered, by spaced-seed hashing.

Texts become arrays of word hashes (or of characters, for scripts without blanks). A seed is a mask over a window that
leaves some positions out; a family of masks is chosen so that, wherever up to k places of a window are altered, one of them
ignores all of these. Seeds of items and of documents are joined; the two windows of each hit are compared place by place,
and what differs in at most k places is a passage found.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.session import BROADCAST_ROWS, cut_counted

WORDS, CHARS = 13, 30
CHAR_LANGS = ("zh", "ja", "th")

#: Altered places that the search allows for at least; what is asked for is decided on the windows found.
TOLERATED = 2
BLOCK_CHARS = 1_000_000
#: Bits of the filter by which documents look for seeds of items: ``FILTER_ROOM`` a seed, ``FILTER_BITS`` (64 MB) at most. A
#: filter that is full lets more windows through to the join, and loses none.
FILTER_ROOM, FILTER_BITS = 64, 1 << 29
#: Parts into which the hits of one seed are split where items are too many to be broadcast.
SALTS = 16

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_BREAK = re.compile(r"<\s*/?\s*br\s*/?\s*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_OUTSIDE = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]*([^\[\]]*)\]")
_QUOTES = re.compile("'{2,}")
# First and last code points of invisible characters.
HIDDEN = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)
_HIDDEN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in HIDDEN) + "]")
_PICTURE = re.compile(r"\s*(?:file|image|datei|fichier|archivo|файл|चित्र|ملف|αρχείο|文件|ファイル|ไฟล์)\s*:", re.I)


def _label(m: re.Match) -> str:
    target, bar, label = m[1].partition("|")
    if not bar:
        return target
    return label.rpartition("|")[2] if _PICTURE.match(target) else label


def shown(text: str) -> str:
    """The text a reader sees, in NFC without case; templates, tables and comments keep their text."""
    if "<" in text:
        if "<!--" in text or "-->" in text:
            text = text.replace("<!--", "").replace("-->", "")
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "[" in text:
        while "[[" in text:
            text, n = _LINK.subn(_label, text)
            if not n:
                break
        text = _OUTSIDE.sub(r"\1", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
        return text
    return text.lower()


@functools.cache
def _counts() -> np.ndarray:
    """Whether a code point is a letter, mark or digit."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" or unicodedata.category(chr(c)) == "Nd" for c in range(0x110000)])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, base, np.uint64)
        if n:
            p[0] = 1
        return np.cumprod(p, dtype=np.uint64)


@functools.cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_B, n), _powers(_B_INVERSE, n)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def units(texts: list[str], chars: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (or characters) of all texts in a row, and the index of the first of each text (and the end)."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    counts = _counts()[code]
    if chars:
        at = np.nonzero(counts)[0]
        return _mix(code[at].astype(np.uint64) + np.uint64(1)), np.searchsorted(at, begins)
    edge = np.diff(counts.astype(np.int8), prepend=0)
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    room = 1 << max(20, len(code).bit_length())
    power, inverse = _tables(room)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)], dtype=np.uint64)])
        words = (prefix[end] - prefix[start]) * inverse[start]
    return _mix(words ^ (end - start).astype(np.uint64)), np.searchsorted(start, begins)


def covering_masks(span: int, altered: int) -> tuple[str, ...]:
    """Masks of which at least one ignores all altered places, wherever these are.

    The window is cut into two blocks more than there are altered places, so that two blocks at least are left untouched;
    there is a mask for every two blocks.
    """
    blocks = altered + 2
    if not 0 <= altered <= span - 2:
        raise ValueError(f"{altered} altered places in a window of {span}")
    of = [k * blocks // span for k in range(span)]
    return tuple("".join("1" if b in pair else "0" for b in of) for pair in itertools.combinations(range(blocks), 2))


class Seeds:
    """Seeds of all windows of ``span`` units, a hash for each mask of :func:`covering_masks`.

    A mask is two blocks of the window, so its hash is made of the hashes of runs as long as these, which all masks share.
    """

    def __init__(self, span: int, altered: int) -> None:
        self.span = span
        of = [k * (altered + 2) // span for k in range(span)]
        self.blocks = [(of.index(k), of.count(k)) for k in range(altered + 2)]
        self.pairs = list(itertools.combinations(range(altered + 2), 2))
        kinds = np.arange(1, 2 * len(self.pairs) + 1, dtype=np.uint64) + np.uint64(1000 * span)
        self.factors = (_mix(kinds) | np.uint64(1)).reshape(-1, 2)

    def __call__(self, u: np.ndarray) -> np.ndarray:
        """One row a mask, one column a window."""
        n = max(len(u) - self.span + 1, 0)
        runs: dict[int, np.ndarray] = {}
        out = np.empty((len(self.pairs), n), np.uint64)
        with np.errstate(over="ignore"):
            for size in {size for _, size in self.blocks} if n else ():
                h = u[: len(u) - size + 1].copy()
                for k in range(1, size):
                    h *= _B
                    h += u[k : len(u) - size + 1 + k]
                runs[size] = h
            for row, pair, factors in zip(out, self.pairs, self.factors, strict=True):
                if n:
                    (a, sa), (b, sb) = (self.blocks[k] for k in pair)
                    np.multiply(runs[sa][a : a + n], factors[0], out=row)
                    row += runs[sb][b : b + n] * factors[1]
        return out


def _bits(seeds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each seed in a filter of 2^size bits."""
    with np.errstate(over="ignore"):
        return seeds >> np.uint64(64 - size), (seeds * _B) >> np.uint64(64 - size)


def _holds(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


WINDOWS = "seeds array<long>, units array<long>"


def _windows(u: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, hit: np.ndarray | None, span: int) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """(text, seeds, units) of the different windows of each text; ``hit``: which seeds of which windows count (None: all)."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = seeds.shape[1]
    at = np.nonzero(owner[:n] == owner[span - 1 : span - 1 + n])[0] if hit is None else np.nonzero(hit.any(axis=0))[0]
    at = at[owner[at] == owner[at + span - 1]]
    window = u[at[:, None] + np.arange(span)]
    with np.errstate(over="ignore"):  # a text may hold a window very often: once is enough
        whole = _mix((window * _powers(_B, span)).sum(axis=1, dtype=np.uint64) + owner[at].astype(np.uint64) * _B)
    once = np.unique(whole, return_index=True)[1]
    at, window = at[once], window[once]
    mine = np.ones((len(seeds), len(at)), bool) if hit is None else hit[:, at]
    sizes = mine.sum(axis=0)
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    plain = lambda a: pa.array(a.reshape(-1).view(np.int64), pa.int64())
    return owner[at], pa.ListArray.from_arrays(ends(sizes), plain(np.ascontiguousarray(seeds[:, at].T[mine.T]))), pa.ListArray.from_arrays(ends(np.full(len(at), span)), plain(np.ascontiguousarray(window)))


def _of_items(altered: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, texts = (batch.column(c).to_pylist() for c in ("item_id", "lang", "text"))
            for chars in (False, True):
                mine = [k for k, lang in enumerate(langs) if ((lang or "").lower()[:2] in CHAR_LANGS) == chars]
                if not mine:
                    continue
                span = CHARS if chars else WORDS
                plain = [shown(texts[k]) for k in mine]
                u, bounds = units(plain, chars)
                text, seeds, windows = _windows(u, bounds, Seeds(span, altered)(u), None, span)
                counted = [np.array([ord(c) >= WIDE for c in t if _counts()[ord(c)]], bool) for t in plain] if chars else []
                # the least number of wide characters in a window of the item
                wide = [int(np.convolve(c, np.ones(span, int), "valid").min()) if len(c) >= span else span for c in counted] or [span] * len(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[mine[k]] for k in text], pa.int64()), pa.array([chars] * len(text), pa.bool_()), pa.array([wide[k] for k in text], pa.int32()), seeds, windows],
                    ["item_id", "chars", "wide", "seeds", "units"],
                )

    return run


#: Characters from here on are wide: a text without any can hold no window that has more of them than places are altered.
WIDE = 0xE00
_WIDE = re.compile(f"[{chr(WIDE)}-{chr(0x10FFFF)}]")


def _of_documents(filters, altered: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(chars, words, only_wide, Seeds(CHARS if chars else WORDS, altered)) for chars, words, only_wide in filters.value]
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            begin = 0
            while begin < len(ids):
                end, size = begin, 0
                while end < len(ids) and (end == begin or size + len(texts[end]) <= BLOCK_CHARS):
                    size += len(texts[end])
                    end += 1
                plain = [shown(t) for t in texts[begin:end]]
                for chars, words, only_wide, make in kinds:
                    rows = [k for k, t in enumerate(plain) if not only_wide or (not t.isascii() and _WIDE.search(t))]
                    if not rows:
                        continue
                    u, bounds = units([plain[k] for k in rows], chars)
                    seeds = make(u)
                    hit = np.zeros(seeds.shape, bool)
                    for h, got in zip(seeds, hit, strict=True):
                        first, second = _bits(h, (len(words) * 64).bit_length() - 1)
                        at = np.nonzero(_holds(words, first))[0]
                        got[at[_holds(words, second[at])]] = True
                    if not hit.any():
                        continue
                    text, found, windows = _windows(u, bounds, seeds, hit, make.span)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[begin + rows[k]] for k in text], pa.int64()), found, windows], ["doc_id", "seeds", "units"])
                begin = end

    return run


def _filter(seeds: DataFrame, n: int) -> np.ndarray:
    """A bit filter of the seeds, put together by tasks; what comes here is bounded by ``FILTER_BITS``."""
    size = min(max(n * FILTER_ROOM, 1 << 16), FILTER_BITS).bit_length() - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), size))
            words, where = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = seeds.select("seed").mapInArrow(place, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros((1 << size) // 64, np.uint64)
    table = rows.toArrow()
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def passages(documents: DataFrame, items: DataFrame, altered: int = TOLERATED) -> DataFrame:
    """documents: doc_id, text. items: item_id, lang, text. doc_id, item_id, altered: each document with each item of which it
    holds a window of 13 words (30 characters for items in zh, ja and th) with at most that many places altered, wherever
    these are; altered is the least number over all windows.

    Null texts hold nothing and items without so many words can't be held. A window counts once a text, however often it stands
    there. Documents aren't shuffled; only their windows that pass the filter of the items' seeds meet the items: by a
    broadcast of the seeds up to a counted number, else shuffled on seed and salt.
    """
    spark = documents.sparkSession
    asked = items.where("item_id is not null and text is not null").select("item_id", "lang", "text")
    made = asked.mapInArrow(_of_items(altered), f"item_id long, chars boolean, wide int, {WINDOWS}")
    windows, _ = cut_counted(made.distinct(), "true")
    seeds, (n_words, n_chars) = cut_counted(windows.select("item_id", "chars", "wide", F.explode("seeds").alias("seed"), "units"), "not chars", "chars")
    filters = []
    for chars, n in ((False, n_words), (True, n_chars)):
        if n:
            mine = seeds.where("chars" if chars else "not chars")
            only_wide = chars and mine.agg(F.min("wide")).first()[0] > altered
            filters.append((chars, _filter(mine, n), only_wide))
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    hits = texts.mapInArrow(_of_documents(spark.sparkContext.broadcast(filters), altered), f"doc_id long, {WINDOWS}").select("doc_id", F.explode("seeds").alias("seed"), "units")
    known = seeds.select("item_id", "seed", F.col("units").alias("i_units"))
    if n_words + n_chars <= BROADCAST_ROWS:
        met = hits.join(F.broadcast(known), "seed")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    differing = F.size(F.filter(F.zip_with("units", "i_units", lambda a, b: a != b), lambda x: x))
    compared = met.where(F.size("units") == F.size("i_units")).select("doc_id", "item_id", differing.alias("altered")).where(F.col("altered") <= altered)
    return compared.groupBy("doc_id", "item_id").agg(F.min("altered").alias("altered"))


def leaked(documents: DataFrame, items: DataFrame, substitutions: int = 0) -> DataFrame:
    """Pairs (doc_id, item_id), each once for a unique doc_id, of :func:`passages` with at most so many places altered.

    Altered passages are searched for in any case, up to ``TOLERATED`` places or as many as are asked for; with no
    substitutions a check for unaltered windows follows: the document holds at least 13 consecutive words (30 characters) of
    the item.
    """
    found = passages(documents, items, max(substitutions, TOLERATED))
    return found.where(F.col("altered") <= substitutions).select("doc_id", "item_id")
