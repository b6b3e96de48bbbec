"""Stable pseudo-random order keys that do not depend on partitioning, platform or run."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def blake2b(size: int):
    @F.pandas_udf("binary")
    def digest(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hashlib.blake2b(t.encode(), digest_size=size).digest(), na_action="ignore")

    return digest


def entity_key(entity_id: Column, seed: int) -> Column:
    """16 bytes; BINARY compares byte by byte."""
    return blake2b(16)(F.concat(F.lit(f"{seed}\0"), entity_id))


def pair_key(s1: Column, target: Column, seed: int) -> Column:
    """8 bytes."""
    return blake2b(8)(F.concat(F.lit(f"{seed}\0"), s1, F.lit("\0"), target))


def sha_key(value: Column, seed: int) -> Column:
    """The same without Python, for orders that need not agree with other programs."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), value), 256)
