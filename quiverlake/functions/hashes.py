"""String hashes that shard routing depends on, without overflow under ANSI arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seed and factor of DJB2; the low halves of the FNV-1a basis and prime.
DJB2_SEED, DJB2_FACTOR = 5381, 33
FNV_BASIS_LOW, FNV_PRIME_LOW = 2216829733, 435


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes as numbers."""
    code = F.hex(F.encode(text, "utf-8"))
    n = F.octet_length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def djb2(text: Column) -> Column:
    """The unsigned 64-bit hash, as decimal(38,0)."""
    wrap = F.lit("18446744073709551616").cast("decimal(20,0)")
    step = lambda h, b: F.pmod(h * F.lit(DJB2_FACTOR).cast("decimal(2,0)") + b.cast("decimal(3,0)"), wrap).cast("decimal(38,0)")
    return F.aggregate(_bytes(text), F.lit(DJB2_SEED).cast("decimal(38,0)"), step)


def fnv1a_low(text: Column) -> Column:
    """The low 32 bits of the 64-bit FNV-1a hash, as bigint."""
    step = lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME_LOW).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(_bytes(text), F.lit(FNV_BASIS_LOW).cast("bigint"), step)


def vector_hash(vector: str | Column) -> Column:
    """DJB2 of a vector's components as little-endian 32-bit floats, as an unsigned number in text. Bits of floats are out
    of reach of expressions, so this is an Arrow function."""

    @F.arrow_udf("string")
    def of(values: pa.Array) -> pa.Array:
        out = np.full(len(values), None, object)
        there = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
        lengths = np.array(values.value_lengths().to_pylist(), object)
        for dim in set(lengths[there].tolist()):  # vectors of one length at once: a byte of all of them is one step
            own = there[lengths[there] == dim]
            x = np.array(values.take(pa.array(own)).to_pylist(), "<f4").reshape(len(own), dim)
            h = np.full(len(own), DJB2_SEED, np.uint64)
            for column in x.view(np.uint8).reshape(len(own), 4 * dim).T:
                h = h * np.uint64(DJB2_FACTOR) + column
            out[own] = h.astype(str)
        return pa.array(out, pa.string())

    return of(F.col(vector) if isinstance(vector, str) else vector)
