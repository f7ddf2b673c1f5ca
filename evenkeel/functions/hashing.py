"""Seeded FNV-1a, 64 bits, as a Spark expression and in Python, and the generators' rolling hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: FNV-1a's constants (fixed values).
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
_LOW = 0xFFFFFFFF


def fnv1a64(data: bytes | str, seed: int = 0, state: int | None = None) -> int:
    """Hash of the bytes; `state` goes on from an earlier hash."""
    h = (OFFSET ^ seed) if state is None else state
    for b in data.encode() if isinstance(data, str) else data:
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def partition_id(key: str, seed: int, partitions: int) -> int:
    return fnv1a64(key, seed) % partitions


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes as an array; null stays null."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))  # one pass, whatever the length
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))


def fnv1a64_limbs(text: Column, seed: int = 0) -> Column:
    """struct(hi, lo): the hash in two 32-bit halves, since 64-bit products would overflow.

    The prime is 2**40 + 435, so a step is two small products and a shift.
    """
    start = OFFSET ^ seed
    first = F.struct(F.lit(start >> 32).cast("long").alias("hi"), F.lit(start & _LOW).cast("long").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        p = lo * 435
        hi = (h["hi"] * 435 + F.shiftright(p, 32) + lo * 256).bitwiseAND(F.lit(_LOW))
        return F.struct(hi.alias("hi"), p.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return F.aggregate(_bytes(text), first, step)


def fnv1a64_column(text: Column, seed: int = 0) -> Column:
    """The hash as an unsigned decimal(20,0)."""
    h = fnv1a64_limbs(text, seed)
    return (h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + h["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")


def partition_id_column(text: Column, seed: int, partitions: int) -> Column:
    """The hash modulo partitions, as an int; null texts give null."""
    h = fnv1a64_limbs(text, seed)
    return ((h["hi"] % partitions * ((1 << 32) % partitions) + h["lo"] % partitions) % partitions).cast("int")


def stable_value(text: Column, row: Column, seed: int) -> Column:
    """31-bit rolling hash of a key, started from the row number: v = (v * 131) ^ byte."""
    mask = F.lit(0x7FFFFFFF)
    start = F.lit(seed).cast("long").bitwiseXOR(row.cast("long")).bitwiseAND(mask)
    return F.aggregate(_bytes(text), start, lambda v, b: (v * 131).bitwiseXOR(b).bitwiseAND(mask))


def stable_value_python(text: str, row: int, seed: int) -> int:
    v = (seed ^ row) & 0x7FFFFFFF
    for b in text.encode():
        v = (v * 131 ^ b) & 0x7FFFFFFF
    return v


def stable_payload_value(text: Column, row: Column, seed: int, index: int) -> Column:
    """A payload column's value: the rolling hash under a shifted seed, mixed with row and column number."""
    mixed = (row.cast("long") % (1 << 22)) * 1099511627
    return stable_value(text, row, seed + 7919 * (index + 1)).bitwiseXOR(mixed.bitwiseAND(F.lit(0x7FFFFFFF))).bitwiseXOR(F.lit(index * 2654435).cast("long")).bitwiseAND(F.lit(0x7FFFFFFF))
