"""Fingerprints of rows as a multiset, and the dimensions of a run's fingerprint.

The digest of a table is the sum of its rows' SHA-256 hashes modulo 2**256, held as eight sums of 32-bit limbs: partial
sums merge in any order, so it does not depend on partitions or on the order of rows, and nothing is gathered. A row that
is changed, doubled or left out changes it. Adding only new rows' digests gives the digest of the grown table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LIMBS = 8


def row_text(*columns: str | Column) -> Column:
    """One text for the columns' values, in which NULL differs from every text and ends of values are marked."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in cols])


def limbs(text: Column) -> list[Column]:
    """The hash of a text as eight numbers of 32 bits, the least first."""
    h = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(h, 57 - 8 * i, 8), 16, 10).cast("bigint") for i in range(LIMBS)]


def combined(sums: list[Column]) -> Column:
    """64 hexadecimal digits of the sums, carries taken upwards, modulo 2**256; sums of up to 2**31 rows of a group fit a
    bigint, decimals hold more."""
    out, carry = [], F.lit(0).cast("decimal(38,0)")
    base = F.lit(1 << 32).cast("decimal(38,0)")
    for s in sums:
        total = F.coalesce(s.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) + carry
        low = (total % base).cast("bigint")
        carry = ((total - low.cast("decimal(38,0)")) / base).cast("decimal(38,0)")
        out.append(F.lpad(F.lower(F.hex(low)), 8, "0"))
    return F.concat(*reversed(out))


def digest(rows: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, digest) of the rows as a multiset. A table without rows has n 0 and a digest of zeros."""
    numbered = rows.select(*by, *[x.cast("decimal(20,0)").alias(f"__l{i}") for i, x in enumerate(limbs(row_text(*columns)))])
    sums = numbered.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(f"__l{i}").alias(f"__l{i}") for i in range(LIMBS)])
    return sums.select(*by, "n", combined([F.col(f"__l{i}") for i in range(LIMBS)]).alias("digest"))


def dimensions(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(dimension, n, digest) of a run's fingerprint: by dimension, its rows and the columns that identify them."""
    out = None
    for name, (rows, columns) in parts.items():
        one = digest(rows, columns).select(F.lit(name).alias("dimension"), "n", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def run_fingerprint(found: DataFrame) -> DataFrame:
    """One digest of all dimensions: (digest)."""
    return digest(found, ["dimension", "digest"]).select("digest")
