"""Fingerprints: perceptual hash bits, hex, Hamming distance, content fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.functions.numeric import once


def signed(x: int) -> int:
    """A 64-bit pattern as the bigint that has it."""
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(rows: DataFrame, coefs: str, name: str = "bits") -> DataFrame:
    """``rows`` with 64 bits as a bigint, most significant first: 1 where a coefficient is above the median of all but the
    first of the 64 in the column ``coefs``; the first gets a bit too."""
    median = F.get(F.sort_array(F.slice(F.col(coefs), 2, 63)), F.lit(31))
    held = rows.withColumn("_median", once(median))
    bit = lambda i: F.when(F.get(F.col(coefs), F.lit(i)) > F.col("_median"), F.lit(signed(1 << (63 - i)))).otherwise(F.lit(0))
    return held.withColumn(name, reduce(Column.bitwiseOR, [bit(i).cast("long") for i in range(64)])).drop("_median")


def hex64(bits: Column) -> Column:
    """A bigint's bits as 16 hex digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def words_of_hex(digits: Column, n: int) -> Column:
    """The bits of 16 n hex digits as an array of n bigints."""
    return F.array(*[F.conv(F.substring(digits, 16 * k + 1, 16), 16, -10).cast("long") for k in range(n)])


def hamming_hex(a: Column, b: Column) -> Column:
    """Number of differing bits of two hex strings of one length, 8 digits at a time (16 would overflow); null if the
    lengths differ, a string is empty or not hex."""
    good = (F.length(a) == F.length(b)) & (F.length(a) > 0) & a.rlike("^[0-9a-fA-F]+$") & b.rlike("^[0-9a-fA-F]+$")
    part = lambda s, k: F.conv(F.substr(s, k * 8 + 1, F.lit(8)), 16, 10).cast("long")
    total = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.length(a) - 1) / 8).cast("int")), F.lit(0), lambda acc, k: acc + F.bit_count(part(a, k).bitwiseXOR(part(b, k)))
    )
    return F.when(good, total)


def sentence_fingerprint(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 of the parts with NUL between; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def _cosines(size: int = 32, kept: int = 8) -> np.ndarray:
    n = np.arange(size)
    return np.cos(np.pi * (2 * n[None, :] + 1) * np.arange(kept)[:, None] / (2 * size))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def dct_low(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The 8 by 8 lowest coefficients, row by row, of the unnormalised 2-D DCT-II of a 32 by 32 gray frame (1024
    values); null for another size."""
    c = _cosines()
    for batch in frames:
        yield batch.map(lambda g: (c @ np.asarray(g, float).reshape(32, 32) @ c.T).ravel() if g is not None and len(g) == 1024 else None)
