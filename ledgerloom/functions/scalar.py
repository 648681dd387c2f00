"""Column expressions: robust parsing, vectors in arrays, hashes and formatting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column, default: float = 0.0) -> Column:
    """A string as a finite double: yes/no words are 1/0; blank, unparsable and non-finite give the default."""
    low = F.lower(F.trim(text))
    value = F.trim(text).try_cast("double")
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    return F.when(low.isin("true", "yes", "y"), 1.0).when(low.isin("false", "no", "n"), 0.0).otherwise(F.coalesce(finite, F.lit(float(default))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def weighted(columns: list[Column], weights: list[float], bias: float) -> Column:
    """A linear score that stays in generated code: no arrays."""
    return reduce(lambda acc, cw: acc + cw[0] * F.lit(cw[1]), zip(columns, weights, strict=True), F.lit(bias))


def sigmoid(z: Column) -> Column:
    """Logistic function with the logit clipped to 30."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def clip_norm(v: Column, bound: float) -> Column:
    """The vector scaled down to norm ``bound`` where it is longer."""
    if bound <= 0:
        raise ValueError("the norm bound must be positive")
    scale = F.least(F.lit(1.0), F.lit(bound) / F.greatest(norm(v), F.lit(1e-300)))
    return F.transform(v, lambda x: x * scale)


def is_valid_vector(v: Column, dim: int) -> Column:
    """Exactly ``dim`` finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & fine, F.lit(False))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def multiply32(a: Column, b: int) -> Column:
    """The low 32 bits of a product of 32-bit unsigned integers held in bigints, without overflow."""
    low, high = b & 0xFFFF, b >> 16
    upper = F.shiftleft((a * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * F.lit(low) + upper).bitwiseAND(F.lit(0xFFFFFFFF))


def seeded_unit(index: Column, salt: int) -> Column:
    """A number in [0, 1] by 32-bit mixing of an index and a salt."""
    # fixed values: offset, multipliers and shifts of the mixer
    x = multiply32((index.cast("bigint") + F.lit(0x9E3779B9)).bitwiseAND(F.lit(0xFFFFFFFF)), 0x85EBCA6B).bitwiseXOR(F.lit(salt))
    x = x.bitwiseXOR(F.shiftright(x, 13))
    x = multiply32(x, 0xC2B2AE35)
    x = x.bitwiseXOR(F.shiftright(x, 16))
    return x / F.lit(float(0xFFFFFFFF))


def stable_hash(token: Column) -> Column:
    """First eight bytes of the MD5 as an unsigned integer."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_halves(token: Column) -> tuple[Column, Column]:
    """The two halves of that integer, its first and its last 32 bits."""
    digest = F.md5(token.cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))


def half_up(x: Column) -> Column:
    """Rounding to an integer as browsers do: floor(x + 0.5)."""
    return F.floor(x + 0.5)
