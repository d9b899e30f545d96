"""Declared columns: name, expression, type, dependencies and aggregate, inherited by class.

A class's columns are its ``Column`` attributes.  A subclass that declares a column again keeps what it
leaves open (type, dependencies, aggregate) from its parents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Declared:
    """``make``: an expression, a constant, or a function of nothing; None if only subclasses know."""

    make: Callable[[], Expr] | Expr | object | None = None
    dtype: str | None = None
    depends: tuple[str, ...] = ()
    aggregate: Callable[[Expr], Expr] | None = None

    def expression(self) -> Expr:
        made = self.make() if callable(self.make) else self.make
        made = made if isinstance(made, Expr) else F.lit(made)  # a constant holds for every row
        return made.cast(self.dtype) if self.dtype else made


class Source:
    """A source of standardized rows."""

    name = "source"

    @classmethod
    def declared(cls) -> dict[str, Declared]:
        out: dict[str, Declared] = {}
        for klass in reversed(cls.__mro__):
            for name, value in vars(klass).items():
                if isinstance(value, Declared):
                    old = out.get(name, Declared())
                    out[name] = replace(
                        value, make=old.make if value.make is None else value.make, dtype=value.dtype or old.dtype,
                        depends=value.depends or old.depends, aggregate=value.aggregate or old.aggregate,
                    )
        return out

    @classmethod
    def standardize(cls, raw: DataFrame) -> DataFrame:
        """All columns, those first that others need; an error names what can't be resolved."""
        left, have, frame = cls.declared(), set(), raw
        while left:
            ready = [n for n, d in left.items() if not set(d.depends) - have]
            if not ready:
                raise ValueError(f"columns of {cls.__name__} that depend on what is absent: {sorted(left)}")
            missing = [n for n in ready if left[n].make is None]
            if missing:
                raise ValueError(f"columns of {cls.__name__} without a definition: {missing}")
            frame = frame.withColumns({n: left[n].expression() for n in ready})
            have.update(ready)
            for n in ready:
                del left[n]
        return frame.select(*cls.declared(), F.lit(cls.name).alias("name"))

    @classmethod
    def aggregates(cls) -> list[Expr]:
        return [d.aggregate(F.col(n)).alias(n) for n, d in cls.declared().items() if d.aggregate]
