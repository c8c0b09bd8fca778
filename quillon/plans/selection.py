"""An immutable selection over the rows of one table: every step only extends a predicate, which Catalyst plans as a whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import Kind, of_type
from ..functions.values import Rule, as_float, as_int, as_uint, holds, rule

from .accessor import Accessor, Expiry

ROW = "row_id"


@dataclass(frozen=True)
class Table:
    """Rows at one version, with the names that a selection may use."""

    df: DataFrame
    kinds: dict[str, Kind]
    indexes: dict[str, tuple[str, Rule]] = field(default_factory=dict)
    sorts: dict[str, str] = field(default_factory=dict)
    key: str | None = None
    strict: bool = False

    @classmethod
    def of(cls, df: DataFrame, row: str | None = None, **more) -> Table:
        """Any DataFrame. row: the column that names its rows; without one, numbers that hold for this plan only."""
        own = F.col(row).cast("long") if row else F.monotonically_increasing_id()
        kinds = {f.name: of_type(f.dataType) for f in df.schema.fields}
        return cls(df.withColumn(ROW, own), kinds, **more)

    def index(self, name: str, column: str, given: Rule) -> Table:
        if name in self.indexes or name in self.kinds:
            raise ValueError(f"{name} is taken")
        if column not in self.kinds:
            raise ValueError(f"no column {column}")
        return replace(self, indexes={**self.indexes, name: (column, given)})

    def sort(self, name: str, column: str) -> Table:
        if column not in self.kinds:
            raise ValueError(f"no column {column}")
        return replace(self, sorts={**self.sorts, name: column})

    def predicate(self, name: str) -> Column | None:
        """An index's rule, a bool column, or the presence of any other column; None for an unknown name.

        It may be null, which a filter takes as false: wrapped in a coalesce it would not reach the scan.
        """
        if name in self.indexes:
            column, given = self.indexes[name]
            return rule(given, F.col(column))
        if name in self.kinds:
            return F.col(name) if isinstance(self.kinds[name].type, T.BooleanType) else F.col(name).isNotNull()
        return None

    def select(self) -> Selection:
        return Selection(self)


@dataclass(frozen=True)
class Selection:
    table: Table
    sel: Column | None = None  # None: all rows, and no filter yet

    def _with(self, sel: Column) -> Selection:
        return replace(self, sel=sel)

    def _and(self, p: Column) -> Selection:
        return self._with(p if self.sel is None else self.sel & p)

    def _or(self, p: Column) -> Selection:
        return self._with(p if self.sel is None else self.sel | p)

    # selections by name

    def with_(self, *names: str) -> Selection:
        """Rows that have all; an unknown name leaves none."""
        out = self
        for name in names:
            p = self.table.predicate(name)
            out = out._and(F.lit(False) if p is None else p)
        return out

    def without(self, *names: str) -> Selection:
        """Rows that have none of them; unknown names don't count."""
        out = self if self.sel is not None else self._with(F.lit(True))
        for name in names:
            p = self.table.predicate(name)
            out = out if p is None else out._and(~holds(p))
        return out

    def union(self, *names: str) -> Selection:
        """With the rows that have one of the names. On an untouched selection the first name starts it."""
        out = self
        for name in names:
            p = self.table.predicate(name)
            if p is not None:
                out = out._or(p)
            elif self.table.strict and out.sel is None:
                out = out._with(F.lit(True))  # an unknown first name is used up
        return out

    def with_union(self, *names: str) -> Selection:
        """Rows that have one of the names at least; unknown names don't count."""
        if self.sel is None or (self.table.strict and len(names) == 1):
            return self.union(*names)
        found = [p for p in map(self.table.predicate, names) if p is not None]
        if not found:
            return self._and(F.lit(False)) if names else self
        any_of = found[0]
        for p in found[1:]:
            any_of = any_of | p
        return self._and(any_of)

    # selections by value

    def _by(self, column: str, given: Rule, fits, converted) -> Selection:
        kind = self.table.kinds.get(column)
        if kind is None or not fits(kind):
            return self._and(F.lit(False))
        value = converted(F.col(column), kind)
        return self._and(F.col(column).isNotNull() & rule(given, value))

    def with_value(self, column: str, given: Rule) -> Selection:
        """Rows with a value for which the rule holds. A rule as SQL text names the column itself."""
        return self._by(column, given, lambda k: True, lambda c, k: c)

    def with_float(self, column: str, given: Rule) -> Selection:
        return self._by(column, given, lambda k: k.numeric, lambda c, k: self._number(as_float(c), k))

    def with_int(self, column: str, given: Rule) -> Selection:
        """The rule sees whole numbers, cut towards zero."""
        return self._by(column, given, lambda k: k.numeric, lambda c, k: as_int(c))

    def with_uint(self, column: str, given: Rule) -> Selection:
        """The rule sees whole numbers, cut towards zero; negative ones are left out."""
        return self._by(column, given, lambda k: k.numeric, lambda c, k: as_uint(c, k.type, self.table.strict))

    def with_string(self, column: str, given: Rule) -> Selection:
        return self._by(column, given, lambda k: k.textual, lambda c, k: c)

    def where(self, given: Column | str) -> Selection:
        return self._and(F.expr(given) if isinstance(given, str) else given)

    def _number(self, c: Column, kind: Kind) -> Column:
        return F.when(~F.isnan(c), c) if self.table.strict else c

    def at(self, row_id: int) -> Selection:
        return self._and(F.col(ROW) == F.lit(row_id))

    def by_key(self, key: str) -> Selection:
        if self.table.key is None:
            raise ValueError("the table has no key")
        return self._and(F.col(self.table.key) == F.lit(key))

    # results

    @property
    def condition(self) -> Column:
        return F.lit(True) if self.sel is None else self.sel

    def rows(self) -> DataFrame:
        return self.table.df if self.sel is None else self.table.df.where(self.sel)

    def select(self, *columns: str | Column) -> DataFrame:
        """Columns of the selected rows, in no order. A name may be an index: whether its rule holds."""
        return self.rows().select(*(self.column(c) for c in columns))

    def column(self, c: str | Column) -> Column:
        if isinstance(c, Column) or c in self.table.kinds or c == ROW:
            return c if isinstance(c, Column) else F.col(c)
        p = self.table.predicate(c)
        if p is None:
            raise ValueError(f"no column or index {c}")
        return holds(p).alias(c)

    def bool_(self, name: str) -> Column:
        """Whether a row has it: of an index, a bool column, or the presence of any other."""
        p = self.table.predicate(name)
        if p is None:
            raise ValueError(f"no column or index {name}")
        return holds(p)

    def range(self, *columns: str | Column) -> DataFrame:
        """Columns of the selected rows, in the order of rows."""
        return self.rows().orderBy(ROW).select(*(self.column(c) for c in columns or (ROW,)))

    def iterate(self, *columns: str) -> Iterator:
        """The selected rows in order, fetched a partition at a time."""
        return self.range(*columns).toLocalIterator()

    def ascend(self, index: str, *columns: str | Column, top: int | None = None) -> DataFrame:
        """Columns of the selected rows, in the order of a sorted index."""
        from ..operators.ordering import ascending

        if index not in self.table.sorts:
            raise ValueError(f"no sorted index {index}")
        out = ascending(self.rows(), self.table.sorts[index], self.table.strict)
        out = out if top is None else out.limit(top)
        return out.select(*(self.column(c) for c in columns or (ROW,)))

    def agg(self, **aggregates) -> DataFrame:
        """One row. Values are Aggregates or Columns."""
        kinds, strict = self.table.kinds, self.table.strict
        return self.rows().agg(*((a if isinstance(a, Column) else a.of(kinds, strict)).alias(name) for name, a in aggregates.items()))

    def _one(self, op: str, column: str | None = None):
        from ..operators.aggregates import Aggregate

        return self.agg(v=Aggregate(op, column)).first()["v"]

    def count(self) -> int:
        return self._one("count")

    def sum(self, column: str):
        return self._one("sum", column)

    def avg(self, column: str):
        return self._one("avg", column)

    def min(self, column: str):
        """The smallest value and whether there was a row."""
        return self._extreme("min", column)

    def max(self, column: str):
        return self._extreme("max", column)

    def _extreme(self, op: str, column: str):
        from ..operators.aggregates import Aggregate, any_row

        row = self.agg(v=Aggregate(op, column), ok=any_row).first()
        return row["v"], row["ok"]

    def scalar(self, aggregate) -> Column:
        """An aggregate of this selection as a value for another rule: a scalar subquery."""
        return self.agg(v=aggregate).scalar()

    # typed access

    def any(self, column: str) -> Accessor:
        return Accessor(self, column)

    def ttl(self, column: str = "expire") -> Expiry:
        return Expiry(self, column)

    def key(self) -> Accessor:
        if self.table.key is None:
            raise ValueError("the table has no key")
        return Accessor(self, self.table.key)

    # all rows, changed where selected

    def updated(self, **values) -> DataFrame:
        """All rows; those selected have the new values."""
        return self._changed({c: self.table.kinds[c].stored(v if isinstance(v, Column) else F.lit(v)) for c, v in values.items()})

    def merged(self, **deltas) -> DataFrame:
        """All rows; the deltas are merged into those selected by the columns' rules."""
        return self._changed({c: self.table.kinds[c].merged(F.col(c), d if isinstance(d, Column) else F.lit(d)) for c, d in deltas.items()})

    def _changed(self, new: dict[str, Column]) -> DataFrame:
        df, on = self.table.df, holds(self.condition)
        return df.select(*(F.when(on, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))

    def deleted(self) -> DataFrame:
        """The rows that aren't selected."""
        return self.table.df.where(~holds(self.condition))


def _typed(kind: str):
    def access(self: Selection, column: str) -> Accessor:
        return Accessor(self, column, kind)

    access.__doc__ = f"Access to a column of kind {kind}; another kind is an error."
    return access


for _kind in ("int", "int16", "int32", "int64", "uint", "uint16", "uint32", "uint64", "float32", "float64", "string", "enum", "record"):
    setattr(Selection, _kind, _typed(_kind))
