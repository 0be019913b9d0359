"""Column expressions of the text formats and of two-sided graphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in an optional weight field, from the first character to the last.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: How the text formats spell a distance that does not exist.
NO_DISTANCE = -1
LARGEST_DOUBLE = "1.79769e+308"


def fields(line: Column) -> Column:
    """Fields between single spaces; a space at the end of a line adds none."""
    parts = F.split(line, " ", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def weight_or_one(field: Column) -> Column:
    """The field as a number if all of it is one, else 1."""
    return F.when(field.rlike(NUMBER), field.try_cast("double")).otherwise(F.lit(1.0))


def left_node(unitig: Column) -> Column:
    return unitig * 2


def right_node(unitig: Column) -> Column:
    return unitig * 2 + 1


def other_side(node: Column) -> Column:
    return node.bitwiseXOR(F.lit(1).cast("long"))


def unitig_of(node: Column) -> Column:
    return F.shiftright(node, 1)


def source_side(v: Column, kind: Column) -> Column:
    """A link leaves the right side of v if its type begins with F."""
    return v * 2 + (F.coalesce(F.substring(kind, 1, 1), F.lit("")) == "F").cast("long")


def target_side(w: Column, kind: Column) -> Column:
    """A link enters the right side of w if its type ends with R."""
    return w * 2 + (F.coalesce(F.substring(kind, 2, 1), F.lit("")) == "R").cast("long")


def printed(value: Column) -> Column:
    """A double with six significant digits and no zeros at the end, exponents of two digits or more."""
    v = value.cast("double")
    rounded = F.split(F.format_string("%.5e", F.abs(v)), "e")
    exponent = rounded.getItem(1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(rounded.getItem(0), r"\.", ""), "0+$", "")
    pointed = lambda whole, rest: F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    scientific = F.concat(pointed(F.substring(digits, 1, 1), F.substring(digits, 2, 5)), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(exponent)))
    whole = exponent + 1
    over = pointed(F.rpad(F.substring(digits, F.lit(1), whole), whole, "0"), F.substring(digits, whole + 1, F.lit(6)))
    under = F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), digits)
    text = F.when(digits == "", "0").when((exponent < -4) | (exponent > 5), scientific).when(exponent >= 0, over).otherwise(under)
    return F.when(v.isNotNull(), F.concat(F.when((v < 0) & (text != "0"), "-").otherwise(""), text))


def fixed_distance(distance: Column, bound: float | None = None) -> Column:
    """The distance, or -1 where there is none below the bound."""
    none = distance.isNull() if bound is None else distance.isNull() | (distance >= bound)
    return F.when(none, F.lit(float(NO_DISTANCE))).otherwise(distance)
