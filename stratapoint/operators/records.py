"""Raw delimited records to typed points, or to the reason why a record can't be read.

The tokenizer is a finite-state machine over the bytes of a whole batch of records. The bytes are cut into chunks of equal
length regardless of records; each chunk's transition function (state at its start to state at its end) is computed for all
chunks at once, the functions are composed by a parallel prefix, and a second pass labels every byte with its state.
A record's end resets the machine, so records of any length cost the same a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.session import join_dimension

START, BARE, QUOTED, CLOSED, AFTER, BROKEN, GAP = range(7)
OTHER, SEPARATOR, SPACE, QUOTE, END, SPACE_SEPARATOR = range(6)

# Row: class of a byte; column: state before it. GAP is the run of blanks behind a field where the blank is the separator.
NEXT = np.array(
    [
        # START  BARE    QUOTED  CLOSED  AFTER   BROKEN  GAP
        [BARE, BARE, QUOTED, BROKEN, BROKEN, BROKEN, BARE],
        [START, START, QUOTED, START, START, BROKEN, START],
        [START, BARE, QUOTED, AFTER, AFTER, BROKEN, GAP],
        [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN, BROKEN, QUOTED],
        [START] * 7,
        [START, GAP, QUOTED, GAP, GAP, BROKEN, GAP],
    ],
    dtype=np.uint8,
)
CHUNK = 128

FIELDS = ("x", "y", "z", "I", "R", "G", "B", "class")
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WHOLE = r"^\+?[0-9]+$"
SCHEMA = (
    "line_id long, file_id long, line_no int, reason string, field string, at long, x double, y double, z double, "
    "intensity double, red int, green int, blue int, classification long"
)


def run_machine(classes: np.ndarray) -> np.ndarray:
    """State after each byte, from START, by composing the transition functions of chunks."""
    n = len(classes)
    chunks = max(1, -(-n // CHUNK))
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(7, dtype=np.uint8), (chunks, 1))
    for row in steps:
        maps = NEXT[row[:, None], maps]
    ahead = 1
    while ahead < chunks:  # maps[i] becomes the composition of all chunks up to i
        maps[ahead:] = np.take_along_axis(maps[ahead:], maps[:-ahead].copy(), axis=1)
        ahead *= 2
    state = np.empty(chunks, np.uint8)
    state[0] = START
    state[1:] = maps[:-1, START]
    states = np.empty((CHUNK, chunks), np.uint8)
    for k, row in enumerate(steps):
        state = NEXT[row, state]
        states[k] = state
    return states.T.reshape(-1)[:n]


def tokenize(lines: pa.Array, separators: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """lines: strings without nulls. Gives per line the number of fields, the byte offset of a quoting error (-1: none) and
    the index of its first field, and all fields (unquoted, without the blanks around them) as one array."""
    lines = pa.array(lines, pa.large_string()) if not pa.types.is_large_string(lines.type) else lines
    n = len(lines)
    _, offsets, data = lines.buffers()
    offsets = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    sizes = np.diff(offsets)
    ends = np.cumsum(sizes + 1) - 1
    of_line = np.repeat(np.arange(n), sizes + 1)
    text = np.zeros(len(of_line), np.uint8)
    inside = np.ones(len(of_line), bool)
    inside[ends] = False
    text[inside] = raw
    seps = np.array([ord(s) if s and len(s) == 1 and ord(s) < 128 else 0 for s in separators], np.uint8)
    sep = seps[of_line]
    classes = np.zeros(len(text), np.uint8)
    classes[text == 32] = SPACE
    classes[text == 34] = QUOTE
    classes[text == sep] = SEPARATOR
    classes[(text == 32) & (sep == 32)] = SPACE_SEPARATOR
    classes[ends] = END
    after = run_machine(classes)
    before = np.empty_like(after)
    before[:1] = START
    before[1:] = after[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = START
    starts = np.concatenate([[0], ends[:-1] + 1])

    broken = (after == BROKEN) & (before != BROKEN)
    broken[ends] |= (before[ends] == QUOTED)
    error_at = np.full(n, -1, np.int64)
    where = np.nonzero(broken)[0]
    rows, first = np.unique(of_line[where], return_index=True)
    error_at[rows] = where[first] - starts[rows]

    blank = seps == 32
    split = (classes == SEPARATOR) & (before != QUOTED) & (before != BROKEN)
    opened = ((before == START) | (before == GAP)) & ((after == BARE) | (after == QUOTED))
    begins = np.where(blank[of_line], opened, split)
    begins[starts[~blank]] |= False
    count = np.add.reduceat(begins.astype(np.int64), starts) if n else np.empty(0, np.int64)
    count += ~blank

    # blanks behind an unquoted field: the next byte that is no blank ends the field
    index = np.where(classes != SPACE, np.arange(len(classes)), len(classes) - 1)
    following = np.minimum.accumulate(index[::-1])[::-1]
    behind = (classes == SPACE) & (after == BARE) & ((classes[following] == SEPARATOR) | (classes[following] == END))
    keep = ((after == BARE) & ~behind) | (after == QUOTED) & ~((before != QUOTED) & (before != CLOSED))
    # every field begins at a mark: the line's start or the byte behind a separator, or the field's first byte
    marks = np.where(blank[of_line], opened, False)
    after_split = np.nonzero(split)[0] + 1
    marks[after_split] = True
    marks[starts[~blank]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    at = np.nonzero(marks)[0]
    bounds = np.concatenate([kept[at], kept[-1:]])
    fields = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(text[keep].tobytes())])
    first_field = np.concatenate([[0], np.cumsum(count)[:-1]]) if n else np.empty(0, np.int64)
    return count, error_at, first_field, fields


def _decimals(texts: pa.Array) -> np.ndarray:
    """Decimal numbers as doubles; those beyond are infinite."""
    plain = pc.replace_substring_regex(texts, r"^\+", "")
    try:
        return pc.cast(plain, pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # some number is too large for the fast way
        return np.array([float(t) for t in plain.to_pylist()], np.float64)


def _wholes(texts: pa.Array) -> np.ndarray:
    """Whole numbers; one of more than ten digits is only told to be too large."""
    digits = pc.replace_substring_regex(texts, r"^\+?0*([0-9])", r"\1")
    large = pc.greater(pc.binary_length(digits), 10)
    return pc.cast(pc.if_else(large, pa.scalar(str(2**62), digits.type), digits), pa.int64()).to_numpy(zero_copy_only=False)


def _read_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    col = {k: batch.column(k) for k in batch.schema.names}
    count, error_at, first, fields = tokenize(col["line"], col["separator"].to_pylist())
    expected = col["n_columns"].to_numpy(zero_copy_only=False)
    reason = np.full(n, "", object)
    field = np.full(n, "", object)
    reason[count != expected] = "columns"
    reason[error_at >= 0] = "quoting"
    at = error_at.copy()
    good = np.nonzero(reason == "")[0]
    values = {k: np.full(n, np.nan) for k in FIELDS[:4]} | {k: np.zeros(n, np.int64) for k in FIELDS[4:]}
    bad = np.zeros(len(good), bool)
    for k, name in enumerate(FIELDS):
        have = expected[good] > k
        part = fields.take(pa.array(np.where(have, first[good] + k, 0))) if len(good) else pa.array([], pa.large_binary())
        # bytes that are no valid text can't match either; fields of records come from valid strings
        part = part.cast(pa.large_string())
        ok = pc.match_substring_regex(part, DECIMAL if k < 4 else WHOLE).to_numpy(zero_copy_only=False) & have
        parsed = np.zeros(len(good), np.float64 if k < 4 else np.int64)
        parsed[ok] = (_decimals if k < 4 else _wholes)(part.filter(pa.array(ok)))
        if k < 4:
            ok &= np.isfinite(parsed)
        else:
            ok &= parsed <= (255 if k < 7 else 4294967295)
        wrong = ~ok & ~bad & have
        field[good[wrong]] = name
        bad |= wrong
        parsed[~ok] = 0
        values[name][good] = parsed
    reason[good[bad]] = "value"
    fine = reason == ""
    nulls = ~fine
    out = [
        col["line_id"], col["file_id"], col["line_no"],
        pa.array(np.where(fine, None, reason), pa.string()), pa.array(np.where(fine, None, field), pa.string()),
        pa.array(at, pa.int64(), mask=fine | (at < 0)),
        *[pa.array(values[k], pa.float64(), mask=nulls | (expected <= i)) for i, k in enumerate(FIELDS[:4])],
        *[pa.array(values[k].astype(np.int32), pa.int32(), mask=nulls | (expected <= i)) for i, k in enumerate(FIELDS[4:7], 4)],
        pa.array(values["class"].astype(np.int64), pa.int64(), mask=nulls | (expected <= 7)),
    ]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(out, names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _read_batch(batch)


def read_records(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """lines: line_id, file_id, line_no, line. layouts: file_id, separator, n_columns, has_header (others are ignored).

    One row per record: its ids, reason and field (null if it was read), at (byte offset of a quoting error, else null) and
    the typed point. No records are: null lines, lines of blanks, tabs and carriage returns only, line 1 of a file with a
    header, and lines of a file without layout (a layout needs a separator and a column count). Repeated rows come out
    repeated. A layout of fewer than eight columns has null for the missing ones.
    """
    known = layouts.where("file_id is not null and separator is not null and n_columns is not null").groupBy("file_id").agg(
        F.max(F.struct("separator", "n_columns", F.coalesce("has_header", F.lit(False)).alias("has_header"))).alias("l")
    ).select("file_id", "l.*")
    some = lines.select("line_id", "file_id", "line_no", "line").where(r"line is not null and not line rlike '^[ \\t\\r]*\\z'")
    records = join_dimension(some, known, "file_id").where("not (has_header and line_no <=> 1)")
    bare = records.select("line_id", "file_id", "line_no", F.regexp_replace("line", r"\r+\z", "").alias("line"), "separator", "n_columns")
    return bare.mapInArrow(_read, SCHEMA)
