"""Small helpers shared by the Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def call(name: str, *args) -> Column:
    """Call a SQL function by name with Column arguments (for signatures whose
    Python wrapper only takes literals)."""
    return F.call_function(name, *[col_of(a) if isinstance(a, Column) else F.lit(a)
                                   for a in args])


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Catalyst does not share common subexpressions inside higher-order
    functions, so an expensive value used inside a lambda would otherwise be
    recomputed per array element.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def materialize(value: Column) -> Column:
    """Inlining barrier for struct results.

    A ``struct(...)`` column read only through its fields is inlined field by
    field by the optimizer, so shared parts of the fields would be computed once
    per field; wrapped like this, the struct is computed once per row and the
    fields are read from it.
    """
    return let(value, lambda x: x)
