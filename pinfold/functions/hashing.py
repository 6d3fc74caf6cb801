"""A portable hash to [0, 1) and the jitter made of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_32 = 0xFFFFFFFF


def _wrap_mul(h: Column, k: int) -> Column:
    """32-bit product that wraps, by halves so that nothing overflows."""
    low, high = h.bitwiseAND(F.lit(0xFFFF)), F.shiftright(h, 16)
    return (low * F.lit(k) + F.shiftleft((high * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_32))


def hash01(text: Column, i: Column) -> Column:
    """FNV-1a of ``text`` (basic-plane characters) mixed with ``i``, as a share of one."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: _wrap_mul(a.bitwiseXOR(c), 16777619))
    h = h.bitwiseXOR((i.cast("long") + F.lit(0x9E3779B9)).bitwiseAND(F.lit(_32)))
    h = _wrap_mul(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
    h = _wrap_mul(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16)) / F.lit(4294967296.0)


def jitter(lat: Column, lon: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """A point 0.01 to 0.055 degrees away, in a direction given by ``u``."""
    angle, far = u * F.lit(3.141592653589793) * 2, F.lit(0.01) + v * 0.045
    squeeze = F.greatest(F.lit(0.2), F.cos(lat * F.lit(3.141592653589793) / 180))
    return lat + F.sin(angle) * far, lon + F.cos(angle) * far / squeeze
