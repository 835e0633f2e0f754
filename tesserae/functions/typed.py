"""Values of no fixed type as a typed key ``(rank, num, txt)``.

rank 0: null; 1: number or boolean, in ``num``; 2: text (arrays and objects as JSON text), in ``txt``.
Null sorts before numbers and numbers before text.  Comparison, order and grouping use these three
columns, since a VARIANT can do none of them, and never rely on implicit casts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TypedKey:
    rank: Column
    num: Column
    txt: Column

    def is_null(self) -> Column:
        return self.rank == 0

    def order(self, descending: bool = False) -> list[Column]:
        """Nulls come first in ascending and last in descending order."""
        return [c.desc() if descending else c.asc() for c in (self.rank, self.num, self.txt)]

    def text(self) -> Column:
        """The value as text; null stays null."""
        return F.when(self.rank == 1, number_text(self.num)).when(self.rank == 2, self.txt)

    def compare(self, op: str, literal) -> Column:
        """``value op literal`` in three-valued logic."""
        if isinstance(literal, bool):
            literal = int(literal)
        if isinstance(literal, (int, float)):
            same, other = _op(self.num, op, F.lit(float(literal))), F.lit(op in (">", ">=", "!="))
            return F.when(self.rank == 1, same).when(self.rank == 2, other)
        same, other = _op(self.txt, op, F.lit(str(literal))), F.lit(op in ("<", "<=", "!="))
        return F.when(self.rank == 1, other).when(self.rank == 2, same)


def _op(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def number_text(num: Column) -> Column:
    """Integers without a decimal point."""
    whole = (num == F.floor(num)) & (F.abs(num) < 1e15)
    return F.when(whole, num.cast("bigint").cast("string")).otherwise(num.cast("string"))


def json_parts(v: Column) -> Column:
    """What the typed key of a variant is made from: its JSON text, and its plain text if it is one."""
    return F.struct(F.to_json(v).alias("json"), F.try_variant_get(v, "$", "string").alias("text"))


def of_parts(parts: Column) -> TypedKey:
    """Typed key of :func:`json_parts`; the first character of a JSON text tells its kind."""
    j = parts["json"]
    kind = F.substr(j, F.lit(1), F.lit(1))
    rank = F.when(j.isNull() | (j == "null"), 0).when(kind.isin('"', "[", "{"), 2).otherwise(1)
    num = F.when(kind == "t", 1.0).when(kind == "f", 0.0).when(~kind.isin('"', "[", "{", "n"), j.try_cast("double"))
    txt = F.when(kind == '"', parts["text"]).when(kind.isin("[", "{"), j)
    return TypedKey(rank, num, txt)


def of_variant(v: Column) -> TypedKey:
    return of_parts(json_parts(v))


def once(c: Column) -> Column:
    """A generator of one row that holds ``c``.  Expressions above it read its column; the optimizer cannot
    copy ``c`` into each of them, as it does with a projected column that filters and projections use."""
    return F.explode(F.array(c))


def of_text(c: Column) -> TypedKey:
    return TypedKey(F.when(c.isNull(), 0).otherwise(2), F.lit(None).cast("double"), c.cast("string"))


def of_number(c: Column) -> TypedKey:
    return TypedKey(F.when(c.isNull(), 0).otherwise(1), c.cast("double"), F.lit(None).cast("string"))


def either(a: TypedKey, b: TypedKey) -> TypedKey:
    """``a`` where it is not null, else ``b``."""
    has = a.rank > 0
    return TypedKey(
        F.when(has, a.rank).otherwise(b.rank), F.when(has, a.num).otherwise(b.num), F.when(has, a.txt).otherwise(b.txt)
    )


def truthy(k: TypedKey, parts: Column, inline_text: Column) -> Column:
    """Present and not false, 0, empty text, array or object; absent or null: whether the inline text is not empty."""
    inline = F.coalesce(F.length(inline_text) > 0, F.lit(False))
    return F.when(k.rank == 0, inline).when(k.rank == 1, k.num != 0).otherwise(~parts["json"].isin('""', "[]", "{}"))
