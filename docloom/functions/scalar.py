"""Column functions: hashes, the base-4 text form of bytes, trigrams, keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

TRIPLET = 3


@pandas_udf(LongType())
def fnv1a64(data: pd.Series) -> pd.Series:
    """64-bit FNV-1a of binary values, as the signed long of the same bits; null stays null.

    All values of a batch advance one byte at a time together.
    """
    raw = [b"" if x is None else bytes(x) for x in data]
    sizes = np.array([len(x) for x in raw], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    state = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-sizes, kind="stable")
    for i in range(int(sizes.max(initial=0))):
        live = order[: np.searchsorted(-sizes[order], -i, "left")]
        state[live] = (state[live] ^ flat[starts[live] + i]) * np.uint64(0x100000001B3)
    return pd.Series(state.view(np.int64)).astype(object).where(data.notna().to_numpy(), None)


def base4_encode(data: Column) -> Column:
    """Bytes as symbols 0-3, two bits each from the top, padded with 0 to whole triplets."""
    pairs = F.create_map(*[F.lit(x) for i in range(16) for x in (f"{i:X}", f"{i >> 2}{i & 3}")])
    symbols = F.array_join(F.transform(F.filter(F.split(F.hex(data), ""), lambda c: c != ""), lambda c: F.element_at(pairs, c)), "")
    return F.when(F.length(symbols) == 0, "").otherwise(F.rpad(symbols, F.ceil(F.length(symbols) / TRIPLET).cast("int") * TRIPLET, F.lit("0")))


def base4_decode(symbols: Column, n_bytes: Column) -> Column:
    """The first n_bytes bytes; null where a symbol is none of 0-3 or there are too few."""
    digits = F.create_map(*[F.lit(x) for i in range(16) for x in (f"{i >> 2}{i & 3}", f"{i:X}")])
    nibbles = F.transform(F.sequence(F.lit(0), 2 * n_bytes - 1), lambda i: F.element_at(digits, F.substr(symbols, 2 * i + 1, F.lit(2))))
    good = symbols.rlike("^[0-3]*$") & (F.length(symbols) >= 4 * n_bytes)
    return F.when(good & (n_bytes > 0), F.unhex(F.array_join(nibbles, ""))).when(good, F.lit(b""))


def mirror(symbols: Column) -> Column:
    """The parity copy: 3 less each symbol."""
    return F.translate(symbols, "0123", "3210")


def broken_positions(symbols: Column, copy: Column) -> Column:
    """Positions from 0 at which the parity copy doesn't fit; missing symbols don't fit either."""
    n = F.greatest(F.length(symbols), F.length(copy))
    fits = lambda i: F.substr(mirror(symbols), i + 1, F.lit(1)) == F.substr(copy, i + 1, F.lit(1))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~fits(i)))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; none for a shorter text."""
    n = F.length(text)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(text, i, F.lit(3))))
    return F.when(n >= 3, grams).otherwise(F.array().cast("array<string>"))


def canonical_key(value: Column) -> Column:
    """Text by which equal values are equal."""
    return value.cast("string")


def sort_key(value: Column) -> Column:
    """A whole number, or null."""
    return F.try_to_number(value, F.lit("S999999999999999999")).cast("long") if isinstance(value, str) else value.try_cast("long")


def stable_id(name: Column) -> Column:
    """A number for a name, the same everywhere."""
    return F.xxhash64(name)


def hex_signature(data: Column) -> Column:
    return F.lower(F.hex(data))


def semantic_key(user: Column, collection: Column) -> Column:
    """What records are placed together by: their user, else their collection."""
    return F.coalesce(F.concat(F.lit("user:"), user.cast("string")), F.concat(F.lit("collection:"), collection.cast("string")))


def size_bucket(n: Column) -> Column:
    """Whole logarithm to base two; 0 for none."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")
