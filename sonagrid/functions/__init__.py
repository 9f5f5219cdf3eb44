"""Column functions of signal analysis: decibels, frequency scales, phases."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest normal double: the floor of logarithms.
TINY = 2.2250738585072014e-308


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def to_db(x, amplitude: bool = True, floor: float = TINY) -> Column:
    """Decibels of an amplitude (or a power), never below the floor's."""
    return (20.0 if amplitude else 10.0) * F.log10(F.greatest(F.abs(_col(x)), F.lit(floor)))


def from_db(x, amplitude: bool = True) -> Column:
    return F.pow(F.lit(10.0), _col(x) / (20.0 if amplitude else 10.0))


def hz_to_mel(f) -> Column:
    return 2595.0 * F.log10(1.0 + _col(f) / 700.0)


def mel_to_hz(m) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), _col(m) / 2595.0) - 1.0)


def hz_to_erb_rate(f) -> Column:
    """Number of equivalent rectangular bandwidths below f (Glasberg and Moore)."""
    return 9.2645 * F.signum(_col(f)) * F.log(1.0 + F.abs(_col(f)) * 0.00437)


def erb_rate_to_hz(e) -> Column:
    return (F.exp(_col(e) / 9.2645) - 1.0) / 0.00437


def hz_to_midi(f, a4: float = 440.0) -> Column:
    return 69.0 + 12.0 * F.log(_col(f) / a4) / log(2.0)


def midi_to_hz(m, a4: float = 440.0) -> Column:
    return a4 * F.pow(F.lit(2.0), (_col(m) - 69.0) / 12.0)


def magnitude(re="re", im="im") -> Column:
    return F.sqrt(_col(re) * _col(re) + _col(im) * _col(im))


def wrap_phase(p) -> Column:
    """To (-pi, pi]."""
    return _col(p) - 2 * pi * F.ceil((_col(p) - pi) / (2 * pi))


def stable(x, digits: int = 6) -> Column:
    """Rounded for comparison across engines: moved off ties first, without a negative zero."""
    return F.round(_col(x) + 3.14159e-8, digits) + F.lit(0.0)
