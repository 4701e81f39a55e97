"""Maps of 64-bit codes as bits, of a limited number, to send to the executors whatever the size of a table.

A map tells surely that a code is not in the table. Two codes may share a bit; what that lets
through has to be held against the table itself. A map that is full lets everything through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# at most: 16 MB; and for each row of a table of known size
BITS, BITS_EACH = 1 << 27, 64
# bytes that Spark makes of one bucket's bits
BUCKET = 4096


def sent_map(df: DataFrame, code: Column, rows: int | None = None):
    """The codes of the table's rows, well-mixed longs, as a broadcast map; `rows`: their number, as a small table has a small map."""
    size = BITS if rows is None else min(BITS, 1 << (max(8 * BUCKET, BITS_EACH * rows) - 1).bit_length())
    at = code.bitwiseAND(F.lit(size - 1)) + 1
    parts = df.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = bytearray(size // 8)
    for r in parts:
        out[(r["bucket"] - 1) * BUCKET : r["bucket"] * BUCKET] = r["bits"]
    return df.sparkSession.sparkContext.broadcast(bytes(out))


def in_map(sent, codes: np.ndarray) -> np.ndarray:
    """Whether codes may be in the map."""
    bits = np.frombuffer(sent.value, dtype=np.uint8)
    at = codes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def may_be_in(sent, code: Column) -> Column:
    """`in_map` of a column; only the codes travel to Python."""

    @F.pandas_udf("boolean")
    def look(codes: pd.Series) -> pd.Series:
        return pd.Series(in_map(sent, codes.to_numpy().view(np.uint64)))

    return look(code)
