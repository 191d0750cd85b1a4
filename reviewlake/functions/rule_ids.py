"""Stable id of a finding: category prefix plus six hex digits of a message hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message_hash(message: Column) -> Column:
    """Rolling hash ``int32(h << 5) - h + code``: the shift wraps to 32 bits, the running value does not."""

    def step(acc: Column, ch: Column) -> Column:
        shifted = F.shiftleft(acc, 5).bitwiseAND(F.lit(4294967295))
        signed = shifted.bitwiseXOR(F.lit(2147483648)) - F.lit(2147483648)
        return signed - acc + F.ascii(ch)

    return F.aggregate(F.split(message, ""), F.lit(0).cast("long"), step)


def finding_rule_id(category: Column, message: Column, upper: bool = True) -> Column:
    digits = F.substring(F.hex(F.abs(message_hash(message))), 1, 6)
    prefix = F.upper(F.substring(category, 1, 3))
    return F.concat(prefix, F.lit("-"), digits if upper else F.lower(digits))
