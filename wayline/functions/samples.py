"""Scalar and array functions of labels, noise levels, losses and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def uniform(*key: Column) -> Column:
    """A seeded number in [0, 1), the same for the same key everywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def shuffled_place(i: Column, n: Column, *key: Column, rounds: int = 40) -> Column:
    """The place of row ``i`` of ``n`` in the permutation of [0, n) that ``key`` names: no sort, no state, one to one for every ``n``.

    Swap or not: a round draws a number c for all rows, pairs i with (c - i) mod n and lets both change places or neither, by a
    draw that the larger of the two names. About 6 log2(n) rounds mix well.
    """

    def turn(at: Column, number: Column) -> Column:
        other = (F.floor(uniform(*key, number) * n).cast("long") + n - at) % n
        return F.when(uniform(*key, number, F.greatest(at, other)) < 0.5, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i.cast("long"), turn)


def length(de: Column, dn: Column, eps: float = 0.0) -> Column:
    return F.sqrt(de * de + dn * dn + eps) if eps else F.sqrt(de * de + dn * dn)


def huber(e: Column, delta: Column) -> Column:
    """Huber loss of a magnitude; the boundary is quadratic."""
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def position_weight(j: Column, k: int, ramp: int = 8) -> Column:
    """Loss weight of position ``j`` of ``k``: 0 at the start, a quadratic ramp, 1, and a slight fall over the last ones."""
    last = ramp - 1
    return (
        F.when(j < ramp, (j / last) * (j / last))
        .when(j >= k - ramp, 1 - 0.2 * (j - (k - ramp)) / last).otherwise(1.0)
    )


def noise_embedding(t: Column, dim: int) -> Column:
    """Sines, then cosines, of a noise level at dim / 2 falling frequencies."""
    half = dim // 2
    i = F.sequence(F.lit(0), F.lit(half - 1))
    freq = lambda x: F.exp(-x * F.log(F.lit(10000.0)) / (half - 1))
    return F.concat(F.transform(i, lambda x: F.sin(t * freq(x))), F.transform(i, lambda x: F.cos(t * freq(x))))


def fingerprint(points: Column, *fields: str) -> Column:
    """SHA-1 over the single-precision values of an array of structs, as text."""
    return F.sha1(F.array_join(F.transform(points, lambda p: F.concat_ws(",", *[p[f].cast("float").cast("string") for f in fields])), ";"))


def step_of(name: Column) -> Column:
    """Step in a checkpoint name, -1 where there is none."""
    digits = F.regexp_extract(name, r"_s(\d+)", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("long")), F.lit(-1).cast("long"))


def weights_file(name: Column) -> Column:
    return F.replace(name, F.lit(".safetensors"), F.lit("_full.pt"))


def tensors_file(name: Column) -> Column:
    return F.replace(name, F.lit("_full.pt"), F.lit(".safetensors"))
