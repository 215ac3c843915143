"""Operators over stored frames: signature, collection, payload and field entries, as audit.materialised() makes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.plan import PlanError, Where
from .predicates import like

HEADER = ("version", "created_at", "updated_at")
SIGNATURE, PAYLOAD = "_signature", "_payload"
WINDOW = 64  # positions around an estimated one


def fnv1a64_of(data: bytes) -> int:
    """FNV-1a of a literal, as the signed long of its bits; columns have functions.scalar.fnv1a64."""
    state = 0xCBF29CE484222325
    for byte in data:
        state = (state ^ byte) * 0x100000001B3 % 2**64
    return state - 2**64 if state >= 2**63 else state


def may_match(where: Where) -> Column:
    """Prefilter on field entries: for equality one of the field with the operand's hash, else one of the field."""
    of_field = lambda e: e["field_name"] == where.field
    if where.field == SIGNATURE:
        return F.lit(True)
    if where.op == "eq":
        wanted = fnv1a64_of(str(where.value).encode())
        return F.exists("entries", lambda e: of_field(e) & (e["value_hash"] == wanted))
    return F.exists("entries", of_field)


def holds(where: Where) -> Column:
    """The condition on the payload's bytes: ranges in byte order, LIKE on its text; `_signature` is the frame's number."""
    if where.field == SIGNATURE:
        if where.op != "eq":
            raise PlanError("a signature is asked for by equality")
        return F.col("signature") == int(where.value)
    if where.field != PAYLOAD:
        return F.lit(False)  # frames have no other entry
    if where.op == "like":
        return like(F.decode("payload", "UTF-8"), where.value)
    operand = F.lit(str(where.value).encode())
    value = F.col("payload")
    return {"eq": value == operand, "ne": value != operand, "gt": value > operand, "gte": value >= operand, "lt": value < operand, "lte": value <= operand}[where.op]


def matching(frames: DataFrame, *wheres: Where) -> DataFrame:
    """Frames that meet all conditions: prefiltered by their entries, then verified by their bytes."""
    return reduce(lambda df, w: df.where(may_match(w) & holds(w)), wheres, frames)


def ordered(frames: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """By a header field, or by signature for any other; ties by signature in the same direction."""
    keys = [field, "signature"] if field in HEADER and field in frames.columns else ["signature"]
    return frames.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys])


def probed(frames: DataFrame, signature: int, window: int = WINDOW) -> DataFrame:
    """The frame of a signature, looked for around the place where consecutive signatures would have it.

    The range is what row-group statistics prune by, so only the near groups are read.
    """
    return frames.where(F.col("signature").between(signature - window, signature + window) & (F.col("signature") == signature))
