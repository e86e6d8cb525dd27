"""Sequence expressions. Offsets are 0-based and half-open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar import schema
from pairgrammar.functions.keys import _c


def centered_window(start, end, length: int) -> tuple[Column, Column]:
    """Fixed-width window around a region, clamped at 0."""
    left = F.greatest(F.floor((_c(start) + _c(end)) / 2) - length // 2, F.lit(0)).cast("long")
    return left, left + F.lit(length)


def pad_or_crop(seq, length: int = schema.WINDOW) -> Column:
    """Centre crop, or N padding with the odd base on the right."""
    s = F.upper(_c(seq))
    n = F.length(s)
    left = F.floor((F.lit(length) - n) / 2).cast("int")
    crop = F.substring(s, (F.floor((n - length) / 2) + 1).cast("int"), F.lit(length))
    pad = F.concat(F.repeat(F.lit("N"), left), s, F.repeat(F.lit("N"), F.lit(length) - n - left))
    return F.when(n >= length, crop).otherwise(pad)


def right_pad(seq, length: int) -> Column:
    """N padding on the right only."""
    return F.rpad(_c(seq), length, "N")


def clean_sequence(seq, length: int = schema.WINDOW) -> Column:
    """Invalid characters to N, window centred on the span of upper-case bases."""
    s = F.regexp_replace(F.trim(F.coalesce(_c(seq), F.lit(""))), "[^ACGTNacgtn]", "N")
    n = F.length(s)
    first = F.regexp_instr(s, F.lit("[ACGTN]"))
    last = n - F.regexp_instr(F.reverse(s), F.lit("[ACGTN]")) + 1
    centre = F.floor((first - 1 + last) / 2)
    start = F.when(first > 0, F.greatest(F.lit(0), centre - length // 2)).otherwise(F.greatest(F.lit(0), F.floor((n - length) / 2)))
    start = F.when(start + length > n, F.greatest(F.lit(0), n - length)).otherwise(start)
    return pad_or_crop(F.substring(s, (start + 1).cast("int"), F.lit(length)), length)


def reverse_complement(seq) -> Column:
    """B14."""
    return F.reverse(F.translate(_c(seq), "ACGTNacgtn", "TGCANtgcan"))


def gc_content(seq) -> Column:
    """B15."""
    n = F.length(_c(seq))
    return (n - F.length(F.translate(_c(seq), "GC", ""))) / F.greatest(n, F.lit(1))


def offset_slice(seq, center, width: int) -> Column:
    """``width`` bases around ``center``, N outside the sequence."""
    fill = F.repeat(F.lit("N"), F.lit(width))
    padded = F.concat(fill, _c(seq), fill)
    left = (_c(center) - width // 2 + width).cast("int")
    inside = (left >= 0) & (left <= F.length(_c(seq)) + width)
    return F.when(inside, F.substring(padded, left + 1, F.lit(width))).otherwise(fill)


def offset_windows(df: DataFrame, start: str, end: str, offsets=schema.OFFSETS, width: int = schema.ANCHOR_WINDOW) -> DataFrame:
    """One row per shift around an anchor."""
    out = df.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    center = F.floor((F.col(start) + F.col(end)) / 2) + F.col("offset")
    return out.withColumn("offset_window", offset_slice("sequence", center, width))


def embed(seq, insert, start) -> Column:
    """Overwrite a sub-sequence; out of bounds is an error."""
    s, ins, at = _c(seq), _c(insert), _c(start)
    ok = (at >= 0) & (at + F.length(ins) <= F.length(s))
    placed = F.overlay(s, ins, (at + 1).cast("int"))
    return F.when(ok, placed).otherwise(F.raise_error(F.lit("insert out of bounds")).cast("string"))


def let(value: Column, body) -> Column:
    """Bind a value once per row: a lambda evaluates outer expressions again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hot(letters: Column) -> Column:
    """5 x L array over the letters ACGTN; any other letter is 0 in all five."""
    return let(F.array_remove(F.split(letters, ""), ""), lambda cs: F.array(*[
        F.transform(cs, lambda c: F.when(c == base, 1.0).otherwise(0.0)) for base in schema.BASES]))


def one_hot(seq) -> Column:
    """5 x L array over ACGTN, unknown characters count as N."""
    return _hot(F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "N"))


def _blank(letters: Column, start: Column, end: Column) -> Column:
    """``letters`` with a dash at the places from ``start`` up to ``end``."""
    a, b = F.greatest(start, F.lit(0)).cast("int"), F.least(end, F.length(letters)).cast("int")
    some = start.isNotNull() & end.isNotNull() & (b > a)
    return F.when(some, F.concat(F.substring(letters, F.lit(1), a), F.repeat(F.lit("-"), b - a), F.substring(letters, b + 1, F.length(letters)))).otherwise(letters)


def interface_bounds(ls, le, rs, re, flank: int = schema.FLANK) -> tuple[Column, Column]:
    """Flanked overlap when the anchors overlap, else the flanked gap."""
    ls, le, rs, re = map(_c, (ls, le, rs, re))
    lo, hi = F.greatest(ls, rs), F.least(le, re)
    overlaps = hi > lo
    start = F.greatest(F.when(overlaps, lo).otherwise(F.least(le, rs)) - flank, F.lit(0))
    end = F.when(overlaps, hi).otherwise(F.greatest(le, rs)) + flank
    return start, end


def _mask(start: Column, end: Column, length: int) -> Column:
    """1 from ``start`` up to ``end``, else 0, over ``length`` places: three runs of a value."""
    a, b = F.greatest(start, F.lit(0)).cast("int"), F.least(end, F.lit(length)).cast("int")
    some = start.isNotNull() & end.isNotNull() & (b > a)
    run = lambda x, n: F.array_repeat(F.lit(x), n)
    return F.when(some, F.concat(run(0.0, a), run(1.0, b - a), run(0.0, F.lit(length) - b))).otherwise(run(0.0, F.lit(length)))


def region_masks(ls, le, rs, re, length: int = schema.WINDOW, flank: int = schema.FLANK) -> Column:
    """Overlap, gap, left inner and right inner masks as a 4 x L array."""
    ls, le, rs, re = map(_c, (ls, le, rs, re))
    spans = [
        (F.greatest(ls, rs), F.least(le, re)),
        (F.least(le, re), F.greatest(ls, rs)),
        (F.greatest(le - flank, ls), le),
        (rs, F.least(rs + flank, re)),
    ]
    return F.array(*[_mask(a, b, length) for a, b in spans])


TRACK_ROWS = 1024  # sequences computed as one matrix
_CODE = np.full(256, 4, dtype=np.int8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i
_ROLL = np.zeros((5, 5))
for _pair, _value in schema.ROLL.items():
    _ROLL["ACGT".index(_pair[0]), "ACGT".index(_pair[1])] = _value
_STEP = np.zeros((5, 5))
for _x, _y in ((1, 0), (1, 2), (3, 0), (3, 2)):  # pyrimidine then purine, and the reverse
    _STEP[_x, _y], _STEP[_y, _x] = 1.0, -1.0


def _tracks(codes: np.ndarray, radius: int) -> np.ndarray:
    """Four z-scored tracks for equally long sequences: (n, 4, length)."""
    n, length = codes.shape
    lo = np.maximum(np.arange(length) - radius, 0)
    hi = np.minimum(np.arange(length) + radius + 1, length)

    def around(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((n, 1)), np.cumsum(mask, axis=1)], axis=1)
        return total[:, hi] - total[:, lo]

    known = np.maximum(around(codes < 4), 1.0)
    at = around((codes == 0) | (codes == 3)) / known
    gc = around((codes == 1) | (codes == 2)) / known
    roll, step = np.zeros((n, length)), np.zeros((n, length))
    if length > 1:
        roll[:, :-1], step[:, :-1] = _ROLL[codes[:, :-1], codes[:, 1:]], _STEP[codes[:, :-1], codes[:, 1:]]
        roll[:, -1], step[:, -1] = roll[:, -2], step[:, -2]
    out = np.stack([at, roll, step, gc], axis=1)
    spread = np.maximum(out.std(axis=2, keepdims=True), 1e-6)
    return (out - out.mean(axis=2, keepdims=True)) / spread


def track_lists(seqs: pa.Array, radius: int) -> pa.Array:
    """Four tracks for each sequence as nested lists over one flat array.

    Sequences of one length are computed together, ``TRACK_ROWS`` at a time.
    """
    raw = [(s or "").encode("ascii", "replace") for s in seqs.to_pylist()]
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(np.repeat(lengths, 4))])
    values = np.empty(int(ends[-1]))
    for size in np.unique(lengths[lengths > 0]):
        alike = np.flatnonzero(lengths == size)
        for rows in np.split(alike, np.arange(TRACK_ROWS, len(alike), TRACK_ROWS)):
            codes = _CODE[np.frombuffer(b"".join(raw[i] for i in rows), dtype=np.uint8)].reshape(len(rows), size)
            values[ends[4 * rows][:, None] + np.arange(4 * size)] = _tracks(codes, radius).reshape(len(rows), -1)
    tracks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(raw) + 1, 4), pa.int32()), tracks)


def shape_tracks(seq, window: int = 5) -> Column:
    """AT share, roll, purine/pyrimidine step and GC share, each z-scored (4 x L).

    Arrow-batched and written as Arrow lists: Python objects for a batch's numbers would take many times
    its memory. Interpreted array lambdas took about 20 times as long on the same rows.
    """
    radius = max(window // 2, 1)

    @F.arrow_udf("array<array<double>>")
    def kernel(seqs: pa.Array) -> pa.Array:
        return track_lists(seqs, radius)

    return kernel(_c(seq))


def interface_tensor(seq, ls, le, rs, re, mask_core: bool = True, length: int = schema.WINDOW) -> Column:
    """One-hot with exclusive cores zeroed, shape tracks and region masks (13 x L)."""
    ls, le, rs, re = map(_c, (ls, le, rs, re))
    letters = F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "N")
    if mask_core:
        apart = rs >= le
        first, second = (ls, F.when(apart, le).otherwise(F.greatest(ls, rs))), (F.when(apart, rs).otherwise(F.least(le, re)), re)
        letters = let(letters, lambda s: let(_blank(s, *first), lambda t: _blank(t, *second)))
    hot = _hot(letters)
    return F.concat(hot, shape_tracks(seq), region_masks(ls, le, rs, re, length))
