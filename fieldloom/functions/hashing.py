"""Deterministic unsigned 32-bit hashes in 64-bit arithmetic, and identities from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multipliers of the two cell coordinates, and the finishing multiplier.
CELL_X, CELL_Z, FINISH = 374761393, 668265263, 1274126177
_U32 = 0xFFFFFFFF


def multiply_u32(a: Column, factor: int) -> Column:
    """Low 32 bits of a product, free of overflow: the halves of `a` are multiplied one by one."""
    low, high = a.bitwiseAND(F.lit(65535)), F.shiftright(a, 16).bitwiseAND(F.lit(65535))
    return (low * F.lit(factor) + F.shiftleft((high * F.lit(factor)).bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(_U32))


def cell_hash(x: Column, z: Column, seed: int = 0) -> Column:
    """A hash of a grid cell, 0 to 2**32 - 1."""
    h = (multiply_u32(x.cast("bigint"), CELL_X) + multiply_u32(z.cast("bigint"), CELL_Z) + F.lit(seed)).bitwiseAND(F.lit(_U32))
    h = multiply_u32(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), FINISH)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def weighted_pick(hash_u32: Column, choices: list[tuple[str, int]]) -> Column:
    """The choice in whose share of the total weight the hash falls."""
    at = F.pmod(hash_u32, F.lit(sum(w for _, w in choices)))
    out, upto = None, 0
    for name, weight in choices:
        upto += weight
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return out


def identity(*parts: Column, size: int = 64) -> Column:
    """Leading hex digits of the SHA-256 of parts joined by a zero byte."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, size)
