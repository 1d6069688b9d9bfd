"""Column expressions on documents: first value, validation, canonical form, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.model import ID_FIELD

#: What validation may find, in the words of the error column.
EMPTY = "neither an id nor a field"
BAD_ID = "id is not valid utf-8"
BAD_NAME = "field name is not valid utf-8"
RESERVED_NAME = "field name is reserved"
BAD_VALUE = "field value is not valid utf-8"
DUPLICATE_ID = "duplicate id in batch"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_value(fields: Column | str, name: str) -> Column:
    """The value of the first entry of that name, null where there is none."""
    return F.try_element_at(F.filter(_col(fields), lambda e: e["name"] == name), F.lit(1))["value"]


def all_values(fields: Column | str, name: str) -> Column:
    """The values of all entries of that name, in order."""
    return F.transform(F.filter(_col(fields), lambda e: e["name"] == name), lambda e: e["value"])


def has_term(fields: Column | str, name: str, value: str) -> Column:
    """Whether an entry has that name and value; false, never null, where fields, names or values are null."""
    found = F.exists(_col(fields), lambda e: F.coalesce((e["name"] == name) & (e["value"] == value), F.lit(False)))
    return F.coalesce(found, F.lit(False))


def validation_error(id: Column | str, fields: Column | str) -> Column:
    """What is wrong with a document, null for a valid one.

    ``id``, names and values may be BINARY or STRING.  A document needs an id or a field; names and values must be valid
    UTF-8, and no name may be the reserved one.  Of several faults the first is named, in order of the entries.  A null
    name or value counts as an empty one; empty ones are valid.

    Documents without fault, the usual case, are told by whole arrays in generated code; entries are looked at one by
    one only where something is wrong.
    """
    id, fields = _col(id), _col(fields)
    no_id = id.isNull() | (F.length(id) == 0)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fault = lambda e: (
        F.when(~F.is_valid_utf8(text(e["name"])), BAD_NAME)
        .when(text(e["name"]) == ID_FIELD, RESERVED_NAME)
        .when(~F.is_valid_utf8(text(e["value"])), BAD_VALUE)
    )
    faults = F.filter(F.transform(fields, fault), lambda x: x.isNotNull())
    texts = lambda part: fields[part].cast("array<string>")
    joined = lambda part: F.coalesce(F.array_join(texts(part), "|"), F.lit(""))
    sound = F.is_valid_utf8(joined("name")) & F.is_valid_utf8(joined("value")) & ~F.coalesce(F.array_contains(texts("name"), ID_FIELD), F.lit(False))
    return (
        F.when((F.coalesce(F.size(fields), F.lit(0)) <= 0) & no_id, EMPTY)
        .when(~F.is_valid_utf8(text(id)), BAD_ID)
        .when(sound, F.lit(None).cast("string"))
        .otherwise(F.try_element_at(faults, F.lit(1)))
    )


def canonical(id: Column | str, fields: Column | str) -> Column:
    """A value by which documents compare: by id, then by their sorted entries, then by the number of entries.

    Two documents are equal if these are; the order of entries does not matter, how often one is listed does.
    """
    return F.struct(F.coalesce(_col(id), F.lit("")).alias("id"), F.array_sort(F.coalesce(_col(fields), F.array())).alias("fields"))


def display(id: Column | str, fields: Column | str) -> Column:
    """``{id: X, fields: {name: value, ...}}``, entries in order, null as empty."""
    pairs = F.transform(_col(fields), lambda e: F.concat(F.coalesce(e["name"], F.lit("")), F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    inner = F.coalesce(F.array_join(pairs, ", "), F.lit(""))
    return F.concat(F.lit("{id: "), F.coalesce(_col(id), F.lit("")), F.lit(", fields: {"), inner, F.lit("}}"))
