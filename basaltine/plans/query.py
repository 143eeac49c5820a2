"""An immutable query builder over a DataFrame or a stored table, and what its plan would skip."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.operators.predicates import all_of, between, check_literal, eq, lt
from basaltine.schema import TableDef
from basaltine.sources.store import Store


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    low: int | str | None = None
    high: int | str | None = None

    def test(self) -> Column:
        c = F.col(self.column)
        return {
            "eq": lambda: eq(self.column, self.low), "lt": lambda: lt(self.column, self.low), "between": lambda: between(self.column, self.low, self.high),
            "null": lambda: c.isNull(), "not_null": lambda: c.isNotNull(),
        }[self.operator]()

    def may_match(self, default: int | str | None, stored: bool) -> Column:
        """Whether a row group can hold a row that matches, by its zone map (or an added column's default)."""
        if stored:
            lo, hi, nulls = F.col(f"min_{self.column}"), F.col(f"max_{self.column}"), F.col(f"nulls_{self.column}")
        else:
            lo = hi = F.lit(default)
            nulls = F.col("rows") if default is None else F.lit(0)
        found = {
            "eq": lambda: (lo <= F.lit(self.low)) & (hi >= F.lit(self.low)), "lt": lambda: lo < F.lit(self.low),
            "between": lambda: (lo < F.lit(self.high)) & (hi >= F.lit(self.low)) if self.low < self.high else F.lit(False),
            "null": lambda: nulls > 0, "not_null": lambda: nulls < F.col("rows"),
        }[self.operator]()
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Query:
    """Predicates that all must hold, and the columns to return; every call returns a new query."""

    table: TableDef
    rows: DataFrame | None = None
    store: Store | None = None
    name: str = ""
    predicates: tuple[Predicate, ...] = ()
    selected: tuple[str, ...] | None = None

    def _known(self, column: str) -> None:
        if column not in self.table.columns:
            raise KeyError(f"unknown column {column}")

    def where(self, column: str, operator: str, low: int | str, high: int | str | None = None) -> Query:
        """``operator``: eq, lt, or between (from low up to but without high)."""
        self._known(column)
        if operator not in ("eq", "lt", "between") or (operator == "between") != (high is not None):
            raise ValueError("a predicate is eq or lt with one value, or between with two")
        check_literal(self.table.columns[column], *([low] if high is None else [low, high]))
        return replace(self, predicates=(*self.predicates, Predicate(column, operator, low, high)))

    def where_null(self, column: str) -> Query:
        self._known(column)
        return replace(self, predicates=(*self.predicates, Predicate(column, "null")))

    def where_not_null(self, column: str) -> Query:
        self._known(column)
        return replace(self, predicates=(*self.predicates, Predicate(column, "not_null")))

    def select(self, *columns: str) -> Query:
        for c in columns:
            self._known(c)
        if len(set(columns)) < len(columns):
            raise ValueError("a column is selected twice")
        return replace(self, selected=columns)

    def _surviving(self) -> DataFrame:
        stored = self.store.manifest(self.name)["columns"]
        tests = [p.may_match(self.table.columns[p.column].default, p.column in stored) for p in self.predicates]
        return self.store.zone_map(self.name).where(all_of(*tests))

    def _matching(self) -> DataFrame:
        rows = self.rows
        if self.store is not None:
            held = self.store.is_cached(self.name) or not self.predicates
            rows = self.store.table(self.name) if held else self.store._rows(self.name, self._surviving())
        for p in self.predicates:  # plain filters, which reach the scan; null fails them as it fails a mask
            rows = rows.where(p.test())
        return rows

    def execute(self) -> DataFrame:
        """row_id and the selected columns (all by default) of the matching rows."""
        return self._matching().select("row_id", *(self.selected or self.table.columns))

    def count(self) -> DataFrame:
        """One row, ``count``; no selected column is read."""
        return self._matching().agg(F.count(F.lit(1)).alias("count"))

    def statistics(self) -> dict[str, int]:
        """What the query reads, from the zone map, and what it finds.

        groups_total and groups_skipped; pages_read, a page per surviving group and needed column; rows_scanned, the
        rows of the surviving groups, and rows_matched; cache_hits, the pages that are held in memory.
        """
        total = self.store.manifest(self.name)["groups"]
        left, scanned = self._surviving().agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        needed = {p.column for p in self.predicates} | set(self.selected or self.table.columns)
        pages = left * len(needed & set(self.store.manifest(self.name)["columns"]))
        held = pages if self.store.is_cached(self.name) else 0
        return {"groups_total": total, "groups_skipped": total - left, "pages_read": pages, "rows_scanned": scanned, "rows_matched": self.count().first()["count"], "cache_hits": held}

    def mask(self) -> DataFrame:
        """row_id, selected: the predicates as a published mask, for all rows; later queries join it by row id."""
        rows = self.rows if self.store is None else self.store.table(self.name)
        return rows.select("row_id", all_of(*[p.test() for p in self.predicates]).alias("selected"))


def query(store: Store, name: str) -> Query:
    """A query over a stored table."""
    return Query(store.tables[name], store=store, name=name)


def query_rows(table: TableDef, rows: DataFrame) -> Query:
    """A query over rows that have a ``row_id``."""
    return Query(table, rows=rows)
