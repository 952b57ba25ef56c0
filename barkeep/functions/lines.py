"""Expressions over raw lines of delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(value: Column) -> Column:
    """Without one trailing carriage return."""
    return F.regexp_replace(value, "\r$", "")


def fields(value: Column) -> Column:
    """The comma-separated fields; one empty field at the end is dropped."""
    parts = F.split(value, ",", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def csv_fields(value: Column) -> Column:
    """The fields of a line by the rules of CSV: quotes around a field are dropped, doubled ones within stand for one."""
    plain = F.split(value, ",", -1)
    found = F.regexp_extract_all(F.concat(F.lit(","), value), F.lit(',("(?:[^"]|"")*"|[^,]*)'), 1)
    bare = F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(value.contains('"'), bare).otherwise(plain)


def timestamp(field: Column) -> Column:
    """Epoch milliseconds of a field of 1 to 19 digits that fits a long, else null."""
    return F.when(field.rlike("^[0-9]{1,19}$"), field.try_cast("bigint"))


def first_fields(parts: Column, n: int | Column) -> Column:
    """The first n fields as a line."""
    return F.array_join(F.slice(parts, F.lit(1), F.lit(n) if isinstance(n, int) else n), ",")


def symbol_from_path(path: Column) -> Column:
    """The file's name without ``.csv`` and without ``_fr`` at its end."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.csv$", 1), "_fr$", "")


def decoded(path: Column) -> Column:
    """A path as Spark's metadata spells it, without percent signs for other characters."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def symbol_of_file(path: Column) -> Column:
    """The symbol of a file's path in Spark's metadata: of its folder ``symbol=...``, else of its name."""
    folder = F.regexp_extract(decoded(path), "/symbol=([^/]+)/", 1)
    return F.when(folder != "", decoded(folder)).otherwise(symbol_from_path(decoded(path)))


def file_of_folder(path: Column) -> Column:
    """The name of a file that is kept as a folder ``file=...``."""
    return decoded(F.regexp_extract(decoded(path), "/file=([^/]+)/", 1))


def batch_name(number: Column) -> Column:
    return F.concat(F.lit("batch_"), F.lpad(number.cast("string"), 5, "0"))


def batch_number(name: Column) -> Column:
    """The number in a batch's name, or null for any other name."""
    return F.regexp_extract(name, "^batch_([0-9]{5})", 1).try_cast("int")


def instrument_family(symbol: Column, family: Column) -> Column:
    """The family of the master, else the text before the last hyphen, else the symbol."""
    before = F.regexp_extract(symbol, "^(.*)-[^-]*$", 1)
    known = F.when(family != "", family)
    return F.coalesce(known, F.when(before != "", before), symbol)
