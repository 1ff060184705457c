"""Hash, salts, capacities and buckets."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 32-bit finalizer's multipliers, the salts' factors, the limits of the part count.
MIX_A, MIX_B = 0x7FEB352D, 0x846CA68B
ROLE_LEVEL, ROLE_ROUND, ROLE_BASE = 0x9E3779B9, 0x85EBCA6B, 0x27D4EB2D
TIE_LEVEL, TIE_ROUND, TIE_BASE = 0xC2B2AE35, 0x165667B1, 0xD3A2646C
MIN_PARTS, MAX_PARTS = 2, 32
MASK = 0xFFFFFFFF


def mix32(x: int) -> int:
    x &= MASK
    x ^= x >> 16
    x = x * MIX_A & MASK
    x ^= x >> 15
    x = x * MIX_B & MASK
    return x ^ x >> 16


def _mul(x: Column, c: int) -> Column:
    """x * c modulo 2^32; halves keep the product within a BIGINT."""
    low, high = x.bitwiseAND(65535), F.shiftright(x, 16)
    return (low * c + F.shiftleft((high * c).bitwiseAND(65535), 16)).bitwiseAND(MASK)


def with_mix32(df: DataFrame, x: Column, out: str) -> DataFrame:
    """Adds mix32 of ``x``; one projection a step, as each uses its input twice."""
    t = "__mix"
    df = df.withColumn(t, x.cast("bigint").bitwiseAND(MASK))
    df = df.withColumn(t, F.col(t).bitwiseXOR(F.shiftright(t, 16)))
    df = df.withColumn(t, _mul(F.col(t), MIX_A))
    df = df.withColumn(t, F.col(t).bitwiseXOR(F.shiftright(t, 15)))
    df = df.withColumn(t, _mul(F.col(t), MIX_B))
    return df.withColumn(out, F.col(t).bitwiseXOR(F.shiftright(t, 16))).drop(t)


def salts(seed: int, level: int, round_no: int) -> tuple[int, int]:
    """Role and tie salt of a round; ``seed`` already holds the level once."""
    role = seed ^ (level * ROLE_LEVEL & MASK) ^ (round_no * ROLE_ROUND & MASK) ^ ROLE_BASE
    tie = seed ^ (level * TIE_LEVEL & MASK) ^ (round_no * TIE_ROUND & MASK) ^ TIE_BASE
    return role & MASK, tie & MASK


def mover_threshold(clusters: int, vertices: int) -> int:
    """Hashes below this make a cluster a mover."""
    share = min(0.5, max(0, clusters - -(-vertices // 2)) / clusters) if clusters else 0.0
    return int(share * 2**32)


def cluster_capacity(total: int, max_vw: int, factor: int, parts: int) -> int:
    return max(max_vw, -(-total // (factor * parts)))


def partition_capacity(total: int, parts: int, ratio: float) -> int:
    """Most weight of a part: floor(total * ratio / parts), exact in the double ``ratio``."""
    if not MIN_PARTS <= parts <= MAX_PARTS:
        raise ValueError(f"the number of parts must be from {MIN_PARTS} to {MAX_PARTS}")
    if not math.isfinite(ratio) or ratio < 1:
        raise ValueError("the imbalance ratio must be finite and 1 or more")
    cap = math.floor(Fraction(ratio) * total / parts)
    if cap >= 2**64:
        raise OverflowError("the capacity is beyond 64 bits")
    if cap < -(-total // parts):
        raise ValueError("the parts cannot hold the total weight")
    return cap


def production_factor(parts: int) -> int:
    return max(64, -(-512 // parts))


def coarsest_cutoff(factor: int, parts: int) -> int:
    return max(32, factor * parts)


def gain_bucket(gain: Column) -> Column:
    """0 for a gain, 1 for none, from 2 on for losses by factors of 1.5."""
    loss = F.lit(25) + F.ceil(F.log(-gain.cast("double")) / F.log(F.lit(1.5)))
    return F.when(gain > 0, 0).when(gain == 0, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(49), loss))).cast("int")


def pseudo_label(c: Column) -> Column:
    """Labels that checks of contractions use."""
    return F.pmod(c * 2654435761 + 17, F.lit(23))


def record_pack(source: int, target: int, weight: int, vertex_bits: int) -> int:
    """Source, target and weight in 64 bits; the all-ones word stays free."""
    weight_bits = 64 - 2 * vertex_bits
    if weight_bits < 1 or max(source, target) >= 1 << vertex_bits or weight >= 1 << weight_bits:
        raise ValueError("the record does not fit 64 bits")
    word = (source << vertex_bits | target) << weight_bits | weight
    if word == 2**64 - 1:
        raise ValueError("the record is the sentinel")
    return word


def record_unpack(word: int, vertex_bits: int) -> tuple[int, int, int]:
    weight_bits, mask = 64 - 2 * vertex_bits, (1 << vertex_bits) - 1
    key = word >> weight_bits
    return key >> vertex_bits, key & mask, word & ((1 << weight_bits) - 1)
