"""64-bit FNV-1a and the keys made from it. The wrapping product needs Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow_udf
from .text import composite_key

# Fixed values of the FNV-1a hash.
OFFSET, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
SAMPLE = 64 * 1024


def fnv1a(values: list[bytes]) -> list[str]:
    """Hashes of many byte strings, position by position, longest first so that the work set shrinks."""
    order = sorted(range(len(values)), key=lambda k: -len(values[k]))
    lengths = np.array([len(values[k]) for k in order])
    flat = np.frombuffer(b"".join(values[k] for k in order), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    hashes = np.full(len(values), OFFSET)
    for j in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -j, "left"))  # those longer than j
        hashes[:n] = (hashes[:n] ^ flat[starts[:n] + j]) * PRIME
    out = [""] * len(values)
    for k, h in zip(order, hashes.tolist()):
        out[k] = f"{h:016x}"
    return out


@arrow_udf("string")
def hash64(texts: pd.Series) -> pd.Series:
    known = texts.notna()
    out = pd.Series([None] * len(texts), dtype=object)
    out[known.to_numpy()] = fnv1a([t.encode() if isinstance(t, str) else bytes(t) for t in texts[known]])
    return out


def cache_key(text: Column, provider: Column, voice: Column, speed: Column, language: Column) -> Column:
    return hash64(composite_key(provider, voice, F.format_string("%.2f", speed), language, hash64(text)))


def fingerprint(content: Column, name: Column) -> Column:
    """A file's identity: size, name and the hashes of the whole file, or of its head, middle and tail."""
    size = F.octet_length(content)
    middle = F.floor(size / 2 - SAMPLE / 2).cast("int")
    small = composite_key(size, name, hash64(content))
    sampled = composite_key(size, name, hash64(F.substring(content, 1, SAMPLE)), hash64(F.substring(content, middle + 1, F.lit(SAMPLE))), hash64(F.substring(content, size - SAMPLE + 1, F.lit(SAMPLE))))
    return hash64(F.when(size <= 3 * SAMPLE, small).otherwise(sampled))


def document_id(mark: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(mark, 1, 12))
