"""A bitmap over 64-bit hashes that occur twice or more: what lets a second pass drop the rest before a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import release, stage

#: Bits for each repeated hash, and bounds of the bitmap's size as powers of two: 64 MB at most, whatever the corpus.
#: A fuller bitmap lets more through; it never drops a repeated hash.
BITS_EACH, LEAST, MOST = 16, 16, 29
#: Leading bits of a hash that are counted: what is shuffled. Enough for 10**13 hashes; hashes that share them count as one.
COUNTED_BITS = 48
COUNTED = "hash long, n int"


def counted(hashes: np.ndarray) -> pa.RecordBatch:
    """(hash, n) of a batch of uint64 hashes; n is 1 or 2, for two or more."""
    found, n = np.unique(hashes >> np.uint64(64 - COUNTED_BITS), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["hash", "n"])


def repeated(counts: DataFrame) -> np.ndarray:
    """The bitmap as uint64 words: the bit of each hash whose n adds up to two or more."""
    often = stage(counts.groupBy("hash").agg(F.sum("n").alias("n")).where("n >= 2").select("hash"), "repeated-hashes")
    out = bitmap_of(often)
    release(counts.sparkSession, often)
    return out


def bitmap_of(often: DataFrame) -> np.ndarray:
    """The bitmap of a staged table's hash column: the leading COUNTED_BITS of each hash."""
    bits = min(MOST, max(LEAST, (BITS_EACH * often.count()).bit_length()))
    bucket = often.select(F.shiftright("hash", COUNTED_BITS - bits).cast("int").alias("bucket"))
    words = bucket.groupBy(F.shiftright("bucket", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bucket & 63)")).alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    found = words.toArrow()  # at most 2**(MOST - 6) rows
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(bitmap).bit_length() + 5
    bucket = hashes >> np.uint64(64 - bits)
    return (bitmap[(bucket >> np.uint64(6)).astype(np.int64)] >> (bucket & np.uint64(63))) & np.uint64(1) > 0
