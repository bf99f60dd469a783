"""Exact quantiles of many columns by radix selection: a few scans that count digits.

Every value has a whole-number key of 128 bits that sorts as the value does: whole numbers and decimals
their unscaled digits, doubles and floats their bits with the negative ones turned round. A scan counts,
for every column and every rank that is asked for, the values by the next digit of their key among those
that share the digits found so far, and the next digit is where the rank falls. Keys count from a
column's least one, so a column with a narrow range takes one scan, and none more than ``128 / BITS``.
What leaves a task is bounded by columns, ranks and digits, never by the values; nothing is sorted,
sampled or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a digit; a scan returns no more than two to this power of counts for a column, rank and task.
BITS = 16

_FLOATS = (T.DoubleType, T.FloatType)
_WORD = 1 << 64


def _is_float(kind: T.DataType) -> bool:
    return isinstance(kind, _FLOATS)


def key_of(value: object, kind: T.DataType) -> int:
    """The key of one value; equal values have equal keys, and smaller ones smaller keys."""
    if _is_float(kind):
        bits = int(np.float64(value + 0.0).view(np.int64))
        return bits if bits >= 0 else -(bits & (1 << 63) - 1)
    if isinstance(kind, T.DecimalType):
        with localcontext(prec=80):
            return int(Decimal(value).scaleb(kind.scale))
    return int(value)


def value_of(key: int, kind: T.DataType) -> float | Decimal | int:
    """The value that a key stands for."""
    if _is_float(kind):
        return float(np.int64(key).view(np.float64)) if key >= 0 else -float(np.int64(-key).view(np.float64))
    if isinstance(kind, T.DecimalType):
        with localcontext(prec=80):
            return Decimal(key).scaleb(-kind.scale)
    return key


def _words(column: pa.Array, kind: T.DataType) -> tuple[np.ndarray, np.ndarray]:
    """The high (signed) and low (unsigned) 64 bits of the keys of a column without nulls."""
    if _is_float(kind):
        bits = (pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)  # no negative zero
        low = np.where(bits >= 0, bits, -(bits & np.int64(2**63 - 1)))
    elif isinstance(kind, T.DecimalType):
        # an Arrow decimal is its unscaled digits as 128 bits, low word first
        column = pa.concat_arrays([pc.cast(column, pa.decimal128(38, kind.scale))])
        both = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset : 2 * (column.offset + len(column))].reshape(-1, 2)
        return both[:, 1], both[:, 0].view(np.uint64)
    else:
        low = pc.cast(column, pa.int64()).to_numpy(zero_copy_only=False)
    return low >> np.int64(63), low.view(np.uint64)


def _above(high: np.ndarray, low: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What keys have over the least one, as two unsigned words."""
    with np.errstate(over="ignore"):
        rest = low - np.uint64(least % _WORD)
        borrowed = low < np.uint64(least % _WORD)
        return high.view(np.uint64) - np.uint64((least >> 64) % _WORD) - borrowed.astype(np.uint64), rest


def _shifted(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned keys without their last ``bits`` bits."""
    if bits == 0:
        return high, low
    nothing = np.zeros_like(high)
    if bits >= 64:
        return nothing, high >> np.uint64(bits - 64) if bits < 128 else nothing
    return high >> np.uint64(bits), (low >> np.uint64(bits)) | (high << np.uint64(64 - bits))


@dataclass
class _Search:
    """One rank of one column: its key over the least one, as far as its digits are found, and how many bits are open."""

    name: str
    kind: T.DataType
    rank: int
    least: int
    open: int
    prefix: int = 0
    below: int = 0
    counts: dict[int, int] = field(default_factory=dict)

    def next_width(self) -> int:
        return min(BITS, self.open)


def _scan(df: DataFrame, searches: list[_Search]) -> None:
    """Count the next digit of every open search in one scan."""
    plan = [(s.name, s.kind, s.least, s.prefix, s.open, s.next_width()) for s in searches]
    names = sorted({s.name for s in searches})
    place = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << width, np.int64) for *_, width in plan]
        for batch in batches:
            words = {}
            for at, (name, kind, least, prefix, open_, width) in enumerate(plan):
                if name not in words:
                    column = pc.drop_null(batch.column(place[name]))
                    if _is_float(kind):
                        column = column.filter(pc.invert(pc.is_nan(column)))
                    words[name] = _above(*_words(column, kind), least)
                high, low = words[name]
                top_high, top_low = _shifted(high, low, open_)
                same = (top_high == np.uint64(prefix >> 64)) & (top_low == np.uint64(prefix % _WORD))
                _, digits = _shifted(high[same], low[same], open_ - width)
                totals[at] += np.bincount((digits & np.uint64((1 << width) - 1)).astype(np.int64), minlength=1 << width)
        for at, counts in enumerate(totals):
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), at, np.int32)), pa.array(seen), pa.array(counts[seen])], names=["at", "digit", "n"])

    rows = df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).mapInArrow(run, "at int, digit bigint, n bigint")
    for s in searches:
        s.counts = {}
    for r in rows.groupBy("at", "digit").agg(F.sum("n").alias("n")).collect():  # digits of each search
        searches[r["at"]].counts[r["digit"]] = r["n"]
    for s in searches:
        width = s.next_width()
        for digit in sorted(s.counts):
            if s.below + s.counts[digit] > s.rank:
                s.prefix, s.open = s.prefix << width | digit, s.open - width
                break
            s.below += s.counts[digit]


def values_at_ranks(df: DataFrame, ranks: dict[str, Sequence[int]], extremes: dict[str, tuple[object, object]]) -> dict[str, list]:
    """The values of each column at some ranks (from 0, among its values that are neither null nor NaN).

    ``extremes`` has each column's least and largest value.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found: dict[tuple[str, int], _Search] = {}
    for name, wanted in ranks.items():
        least, most = (key_of(v, kinds[name]) for v in extremes[name])
        for rank in wanted:
            found[name, rank] = _Search(name, kinds[name], rank, least, (most - least).bit_length())
    while todo := [s for s in found.values() if s.open]:
        by_state: dict[tuple, _Search] = {}
        for s in todo:  # ranks that share their digits so far are counted once
            by_state.setdefault((s.name, s.prefix, s.open), s)
        leaders = list(by_state.values())
        before = [(s, s.name, s.prefix, s.open, s.below) for s in todo]
        _scan(df, leaders)
        for s, name, prefix, open_, below in before:
            leader = by_state[name, prefix, open_]
            if s is leader:
                continue
            s.counts, s.below = leader.counts, below
            width = min(BITS, open_)
            for digit in sorted(s.counts):
                if s.below + s.counts[digit] > s.rank:
                    s.prefix, s.open = prefix << width | digit, open_ - width
                    break
                s.below += s.counts[digit]
    return {name: [value_of(found[name, r].least + found[name, r].prefix, kinds[name]) for r in wanted] for name, wanted in ranks.items()}


def _between(values: list, share: Fraction, kind: T.DataType) -> float | Decimal | None:
    """The value at a place between two neighbouring ones; exact for whole numbers and decimals."""
    low, high = values[0], values[-1]
    if _is_float(kind):
        if low == high or share == 0:
            return low
        return low + (high - low) * float(share) if np.isfinite(high - low) else low * float(1 - share) + high * float(share)
    low, high = Fraction(Decimal(low)), Fraction(Decimal(high))
    exact = low + (high - low) * share
    with localcontext(prec=80):
        return Decimal(exact.numerator) / Decimal(exact.denominator)


def exact_quantiles(df: DataFrame, shares: Sequence[float | Fraction | str]) -> dict[str, list]:
    """Every numeric column's quantiles, with linear interpolation between neighbours, as the median has it.

    Nulls and NaN are missing values; infinities count as values. A column without values has None.
    """
    wanted = [Fraction(s) for s in shares]
    if any(not 0 <= s <= 1 for s in wanted):
        raise ValueError("quantiles lie between 0 and 1")
    fields = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    facts: list[Column] = []
    for i, f in enumerate(fields):
        v = F.col(f"`{f.name}`")
        v = F.when(~F.isnan(v), v) if _is_float(f.dataType) else v
        facts += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}")]
    row = df.agg(*facts).first() if fields else None
    ranks: dict[str, list[int]] = {}
    extremes, places = {}, {}
    for i, f in enumerate(fields):
        if not row[f"n{i}"]:
            continue
        at = [s * (row[f"n{i}"] - 1) for s in wanted]
        places[f.name] = at
        extremes[f.name] = (row[f"a{i}"], row[f"z{i}"])
        ranks[f.name] = sorted({r for p in at for r in (int(p), -int(-p // 1))})
    found = values_at_ranks(df.select(*[f"`{n}`" for n in ranks]), ranks, extremes) if ranks else {}
    out = {}
    for f in fields:
        known = dict(zip(ranks.get(f.name, []), found.get(f.name, []), strict=True))
        out[f.name] = [_between([known[int(p)], known[-int(-p // 1)]], p - int(p), f.dataType) for p in places[f.name]] if known else [None] * len(wanted)
    return out
