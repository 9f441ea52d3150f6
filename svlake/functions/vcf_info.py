"""Column functions for variant-call lines: routing by type, INFO fields, identifiers.

``strict`` reads a key only at a field boundary. ``compat`` reproduces the first-substring search of the tools whose files are
to be matched: a key is found inside another (END inside CIEND) and a value that isn't a number leaves the default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def info_value(info: Column, key: str) -> Column:
    """Value of ``key`` in ``k=v;...``; null if absent."""
    return F.nullif(F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def info_map(info: Column) -> Column:
    """All fields as a map; flags have a null value, and of repeated keys the last counts."""
    pairs = F.transform(F.filter(F.split(info, ";"), lambda f: f != ""), lambda f: F.struct(F.split_part(f, F.lit("="), F.lit(1)).alias("k"), F.when(F.contains(f, F.lit("=")), F.regexp_replace(f, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def route(line: Column) -> Column:
    """DEL if the line says SVTYPE=DEL anywhere, else INS if it says SVTYPE=INS, else null."""
    return F.when(F.contains(line, F.lit("SVTYPE=DEL")), F.lit("DEL")).when(F.contains(line, F.lit("SVTYPE=INS")), F.lit("INS"))


def interval(info: Column, key: str) -> tuple[Column, Column]:
    """The two numbers of CIPOS or CIEND; 0 and 0 if absent."""
    value = F.regexp_extract(info, rf"{key}.([^;]*)", 1)
    at = lambda i: F.coalesce(F.split_part(value, F.lit(","), F.lit(i)).try_cast("int"), F.lit(0))
    return at(1), at(2)


def ins_length(info: Column, pos: Column) -> Column:
    """SVLEN with its sign; without it END - pos."""
    return F.coalesce(info_value(info, "SVLEN").cast("int"), (info_value(info, "END").cast("bigint") - pos).cast("int"))


def del_end(info: Column, pos: Column, compat: bool = False) -> Column:
    """END of a deletion; without it pos + |SVLEN|, and without that 0."""
    length = F.abs(info_value(info, "SVLEN").try_cast("bigint"))
    if not compat:
        return F.coalesce(info_value(info, "END").try_cast("bigint"), pos + length, F.lit(0).cast("bigint"))
    first = F.split_part(F.substring(info, F.instr(info, "END") + F.lit(4), F.length(info)), F.lit(";"), F.lit(1)).try_cast("bigint")
    return F.when(F.instr(info, "END") > 0, F.coalesce(first, F.lit(0).cast("bigint"))).otherwise(F.coalesce(pos + length, F.lit(0).cast("bigint")))


def abs_length(info: Column) -> Column:
    """|SVLEN| for matching; null if absent, an error if not a number."""
    return F.abs(info_value(info, "SVLEN").cast("int"))


def fused_id(first: Column, second: Column) -> Column:
    """The second record's tool, the part of its id before a dot, with the first record's id."""
    return F.concat_ws(".", F.split_part(second, F.lit("."), F.lit(1)), first)


def type_class(svtype: Column) -> Column:
    return F.when(svtype.isin("INS", "DEL"), svtype).otherwise(F.lit("OTHER"))


def soft_clipped(cigar: Column, at: int) -> Column:
    """Whether the first (1) or last (-1) operation is a soft clip."""
    return F.coalesce(F.element_at(cigar, at)["op"] == 4, F.lit(False))


def mapped_primary(flag: Column) -> Column:
    return (flag.bitwiseAND(4) == 0) & (flag.bitwiseAND(256) == 0)


def label(kind: Column) -> Column:
    """1 for INS and DEL, 0 for negatives."""
    return F.when(kind.isin("INS", "DEL"), 1).otherwise(0)


def one_hot(y: Column) -> Column:
    return F.when(y == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))


def argmax(scores: Column) -> Column:
    """Place of the largest score from 0; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
