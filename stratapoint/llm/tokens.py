"""Encoding of whole texts by a public byte-level BPE, chunk by chunk.

Texts are cut where a rolling hash of the last 32 bytes says so, so equal passages of different documents give equal chunks.
A chunk is encoded once for all documents that hold it. Encoding chunks apart may go wrong at the joins; every join is
checked, and the tokens around a bad one are encoded anew from one certain boundary to the next, until they meet the
tokens already there.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.session import spread

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Positions no pre-token reaches across, whatever stands around: behind a letter or digit run, before blanks, before digits.
BOUNDARY = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])")

CHUNK_BITS = 9  # a cut every 2**9 bytes on average
SPREAD = 64  # occurrences of one chunk in a task that go to one place; more go to another and are encoded there again
REPAIR = 12  # tokens looked at first on either side of a join

PIECES = "h1 long, h2 long, salt int, doc_id long, seq int, text binary"
CODES = "doc_id long, seq int, ids binary"


@functools.lru_cache(maxsize=2)
def encoder(path: str):  # noqa: ANN201
    """The tokenizer, and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    words = [b""] * (max(ranks.values()) + 1)
    for word, i in ranks.items():
        words[i] = word
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), words


@functools.cache
def _gear() -> np.ndarray:
    return np.random.default_rng(32).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions (0 < p < len) at which the bytes of UTF-8 text are cut, each decided by the bytes near it.

    A cut moves on to the next blank behind a non-blank within 48 bytes, where joins are never bad; without one it stands at
    the start of a character.
    """
    n = len(data)
    if n < 64:
        return np.empty(0, np.int64)
    h = _gear()[data]
    width = 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    fired = np.nonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0)[0] + 1
    fired = fired[(fired >= 32) & (fired < n)]
    if not len(fired):
        return fired
    space = (data == 32) | (data == 10)
    calm = np.nonzero(space[1:] & ~space[:-1] & (data[:-1] > 32) & (data[:-1] < 127))[0] + 1
    start = np.nonzero((data & 0xC0) != 0x80)[0]
    calm = np.append(calm, n + 1000)
    start = np.append(start, n)
    near = calm[np.searchsorted(calm, fired)]
    plain = start[np.searchsorted(start, fired)]
    out = np.unique(np.where(near - fired <= 48, near, plain))
    return out[out < n]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, int] = {}
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list[tuple] = []
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if not text:
                rows.append((0, 0, doc_id & 0x3FF, doc_id, 0, None))
                continue
            ends = [*cuts(np.frombuffer(text, np.uint8)).tolist(), len(text)]
            begin = 0
            for seq, end in enumerate(ends):
                piece = text[begin:end]
                begin = end
                digest = xxhash.xxh3_128_digest(piece)
                times = seen.get(digest, 0)
                seen[digest] = times + 1
                rows.append((
                    int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), times // SPREAD,
                    doc_id, seq, None if times % SPREAD else piece,
                ))
            if len(rows) >= 20_000:
                yield flush(rows)
                rows = []
    if rows:
        yield flush(rows)


def _encode(path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)[0].encode_ordinary
        key, ids = None, b""
        for batch in batches:
            out = []
            h1, h2, salt, text = (batch.column(c).to_pylist() for c in ("h1", "h2", "salt", "text"))
            for now, piece in zip(zip(h1, h2, salt, strict=True), text, strict=True):
                if now != key:
                    key = now
                    ids = np.array(encode(piece.decode()), np.uint16).tobytes() if piece else b""
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq"), pa.array(out, pa.binary())], ["doc_id", "seq", "ids"])

    return run


def join_codes(left: list[int], right: list[int], encode, words: list[bytes]) -> None:  # noqa: ANN001
    """Appends to ``left``, the ids of a text, those of its next piece (cut at a character), mending the join."""
    if not left or not right:
        left += right
        return
    a, b = words[left[-1]][-1], words[right[0]][0]
    if (b == 32 or b == 10) and 32 < a < 127:
        left += right
        return
    take = REPAIR
    while True:  # from the last certain boundary on the left ...
        whole = take >= len(left)
        tail = b"".join([words[i] for i in left[-take:]])
        skip = 0
        while skip < len(tail) and tail[skip] & 0xC0 == 0x80:
            skip += 1
        text = tail[skip:].decode()
        # the first place found in a window that begins inside the text may be one of its own making: its left neighbour is in it
        at = [m.start() for m in BOUNDARY.finditer(text)]
        if at or whole:
            from_left = text[at[-1] :] if at else text
            break
        take *= 4
    drop, size = 0, len(from_left.encode())
    while size > 0:
        drop += 1
        size -= len(words[left[-drop]])
    if size:  # no token ends there, so this place was no boundary to the encoder either: take the whole piece
        from_left, drop = b"".join([words[i] for i in left]).decode(), len(left)
    take = REPAIR
    while True:  # ... to the first certain boundary on the right at which a token begins
        whole = take >= len(right)
        head = b"".join([words[i] for i in right[:take]]).decode(errors="ignore")
        both = from_left + head
        for m in BOUNDARY.finditer(both, pos=len(from_left)):
            if m.start() == len(both) and not whole:
                continue
            size, k = len(both[len(from_left) : m.start()].encode()), 0
            while size > 0:
                size -= len(words[right[k]])
                k += 1
            if size == 0:
                del left[len(left) - drop :]
                left += encode(both[: m.start()])
                left += right[k:]
                return
        if whole:
            del left[len(left) - drop :]
            left += encode(from_left + b"".join([words[i] for i in right]).decode())
            return
        take *= 4


def _join(path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, words = encoder(path)[0].encode_ordinary, encoder(path)[1]
        doc, parts = None, []

        def finished() -> np.ndarray:
            if len(parts) == 1:
                return parts[0].astype(np.int32)
            whole: list[int] = []
            for p in parts:
                join_codes(whole, p.tolist(), encode, words)
            return np.array(whole, np.int32)

        for batch in batches:
            out_doc, out_ids = [], []
            for now, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if now != doc:
                    if parts:
                        out_doc.append(doc)
                        out_ids.append(finished())
                    doc, parts = now, []
                parts.append(np.frombuffer(ids, np.uint16))
            yield _arrays(out_doc, out_ids)
        if parts:
            yield _arrays([doc], [finished()])

    return run


def _arrays(docs: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)], ["doc_id", "ids"])


def encode_corpus(documents: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """documents: doc_id (unique), text. One row per document: doc_id, ids, equal to encoding its whole text at once.

    Null and empty texts have the empty list; rows without a doc_id are dropped. The vocabulary has fewer than 2**16 ids, so
    pieces travel as two bytes an id. Pieces of one hash (128 bits) meet in one place, at most ``SPREAD`` from each task, so
    a passage that stands in a third of all documents is spread too.
    """
    texts = documents.where("doc_id is not null").select("doc_id", "text")
    pieces = texts.mapInArrow(_pieces, PIECES)
    together = spread(pieces, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.col("text").desc_nulls_last())
    codes = together.mapInArrow(_encode(ranks_path), CODES)
    return spread(codes, "doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(_join(ranks_path), "doc_id long, ids array<int>")
