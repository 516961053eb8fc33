"""Column expressions for summaries and distances; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import SENTINEL, TINY, breakpoints

def filled(v: Column) -> Column:
    """A sentinel counts as 0."""
    return F.when(v == SENTINEL, 0.0).otherwise(v)

def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

def deviation(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a))), F.lit(0.0), lambda s, x: s + x) / F.size(a))

def znorm(a: Column, mu: Column, sd: Column) -> Column:
    """z-normalised array; null if it is constant."""
    return F.when(sd > TINY, F.transform(a, lambda x: (x - mu) / sd))

def cc_to_ed(corr: Column, m: int) -> Column:
    return F.lit(2.0 * m) * (1 - corr)

def ed_to_cc(ed: Column, m: int) -> Column:
    return 1 - ed / F.lit(2.0 * m)

def paa(a: Column, m: int, segments: int) -> Column:
    width = m // segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: mean(F.slice(a, k * width + 1, width)))

def sax_symbol(value: Column) -> Column:
    """The number of breakpoints under a value."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in breakpoints()]), lambda b: b < value))

def symbol_middle(symbol: Column, bits: int = 8) -> Column:
    """The PAA value that stands for a symbol of so many bits: the middle of its interval, half the way on to the median's distance for the outer ones."""
    cuts = [float(b) for b in breakpoints(1 << bits)]
    last, half = len(cuts) - 1, cuts[len(cuts) // 2]
    outer = lambda c: c + (c - half) / 2
    middles = [outer(cuts[0]), *((x + y) / 2 for x, y in zip(cuts, cuts[1:], strict=False)), outer(cuts[last])]
    return F.element_at(F.array(*map(F.lit, middles)), symbol.cast("int") + 1)

def lb_keogh(upper: Column, lower: Column, value: Column) -> Column:
    """One sample's share of the squared distance to a warping envelope."""
    gap = F.greatest(value - upper, lower - value, F.lit(0.0))
    return gap * gap

def sigmoid_basis(x: Column, low: float, high: float, steep: float, centre: float, shift: float = 0.0) -> Column:
    """Predicted work as a function of the best distance so far."""
    return low + (high - low) / (1 + F.exp(-steep * (x - centre))) + shift

def packed_length(n: Column, multiple: int = 8) -> Column:
    """Rounded down to a multiple."""
    return n - F.pmod(n, F.lit(multiple))

def clean_code(code: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit(default))

def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
