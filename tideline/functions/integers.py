"""Integers as C's ``%i`` reads them: decimal, ``0x`` hexadecimal, ``0`` octal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One integer, atomic: a scanner that has taken a digit never gives it back.
INT = r"((?>[+-]?(?:0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)))"


def parse_int(token: Column) -> Column:
    """INT value of a token that matches ``INT``; null for others and for values
    outside 32 bits."""
    negative = token.startswith("-")
    digits = F.regexp_replace(token, r"^[+-]", "")
    hexadecimal = F.conv(F.when(digits.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.substr(digits, F.lit(3))), 16, 10)
    octal = F.conv(F.when(digits.rlike(r"^0[0-7]{1,20}$"), digits), 8, 10)
    decimal = F.when(digits.rlike(r"^([1-9][0-9]{0,17}|0)$"), digits)
    value = F.coalesce(hexadecimal, octal, decimal).cast("decimal(20,0)") * F.when(negative, -1).otherwise(1)
    return F.when(value.between(-(1 << 31), (1 << 31) - 1), value).cast("int")
