"""Declared tables: column kinds, their domains, and which changes of a definition stored data allow."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
GROUP, GROUP_STEP = 65_536, 256
#: Domains of the integer kinds; u8 columns also have a width in bits.
DOMAINS = {"i32": (-(1 << 31), (1 << 31) - 1), "u32": (0, (1 << 32) - 1), "u8": (0, 255)}
SPARK_TYPES = {"i32": T.IntegerType(), "u32": T.LongType(), "u8": T.ShortType(), "string": T.StringType()}


@dataclass(frozen=True)
class ColumnDef:
    """A column: its kind, whether it may be null, its width in bits (u8) and the value of rows stored before it."""

    kind: str
    nullable: bool = False
    bits: int = 8
    default: int | str | None = None

    def __post_init__(self):
        if self.kind not in SPARK_TYPES:
            raise ValueError(f"unknown kind {self.kind}")
        if not 1 <= self.bits <= 8:
            raise ValueError("a u8 column has 1 to 8 bits")
        if self.default is not None:
            if self.kind == "string":
                if not isinstance(self.default, str):
                    raise ValueError("the default of a string column is a string")
            elif not isinstance(self.default, int) or not self.low <= self.default <= self.high:
                raise ValueError("the default is outside the column's domain")

    @property
    def low(self) -> int:
        return DOMAINS[self.kind][0]

    @property
    def high(self) -> int:
        return (1 << self.bits) - 1 if self.kind == "u8" else DOMAINS[self.kind][1]

    @property
    def spark(self) -> T.DataType:
        return SPARK_TYPES[self.kind]


def i32(**more) -> ColumnDef:
    return ColumnDef("i32", **more)


def u32(**more) -> ColumnDef:
    return ColumnDef("u32", **more)


def u8(bits: int = 8, **more) -> ColumnDef:
    return ColumnDef("u8", bits=bits, **more)


def string(**more) -> ColumnDef:
    return ColumnDef("string", **more)


@dataclass(frozen=True)
class TableDef:
    """A table: its columns in order, and how many rows a row group has."""

    columns: dict[str, ColumnDef]
    row_group_size: int = GROUP

    def __post_init__(self):
        if not self.columns:
            raise ValueError("a table has at least one column")
        for name in self.columns:
            check_name(name)
        if self.row_group_size < GROUP_STEP or self.row_group_size % GROUP_STEP:
            raise ValueError(f"a row group has a multiple of {GROUP_STEP} rows")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.spark, c.nullable) for n, c in self.columns.items()])


def check_name(name: str) -> str:
    """A name that is safe in a path."""
    if not NAME.fullmatch(name):
        raise ValueError(f"not a valid name: {name!r}")
    return name


def check_evolution(stored: TableDef, wanted: TableDef) -> list[str]:
    """The columns that ``wanted`` adds to what is stored; ValueError for any other difference.

    Only additions are allowed, and an added column is nullable or has a default.
    """
    if stored.row_group_size != wanted.row_group_size:
        raise ValueError("the row group size cannot change")
    for name, old in stored.columns.items():
        new = wanted.columns.get(name)
        if new is None:
            raise ValueError(f"column {name} is stored but not defined")
        if (old.kind, old.nullable, old.bits) != (new.kind, new.nullable, new.bits):
            raise ValueError(f"column {name} has another definition than stored")
    added = [n for n in wanted.columns if n not in stored.columns]
    for name in added:
        if not wanted.columns[name].nullable and wanted.columns[name].default is None:
            raise ValueError(f"added column {name} needs a default or nulls")
    return added


def out_of_domain(name: str, column: ColumnDef) -> Expr:
    """Whether a value breaks the column's definition."""
    value = F.col(name)
    bad = value.isNull() if not column.nullable else F.lit(False)
    if column.kind != "string":
        bad = bad | F.coalesce((value < column.low) | (value > column.high), F.lit(False))
    return bad


def conform(df: DataFrame, table: TableDef, *keep: str) -> DataFrame:
    """``df`` in the table's types; a value outside its domain fails the query that reads it."""
    columns = []
    for name, c in table.columns.items():
        checked = F.when(out_of_domain(name, c), F.raise_error(F.lit(f"a value of column {name} is outside its domain"))).otherwise(F.col(name))
        columns.append(checked.cast(c.spark).alias(name))
    return df.select(*keep, *columns)
