"""Regular expressions over values: in the JVM where that is safe, else by a linear-time automaton over Arrow batches.

The JVM's engine backtracks and recurses: repeated groups can exhaust its stack, several repetitions its time.  Such
expressions (``Pattern.linear`` is false) are matched by RE2 itself, which takes time linear in the value and bounded
memory.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.regex import Pattern


@lru_cache(maxsize=1024)
def by_automaton(pattern: Pattern) -> bool:
    """Whether ``pattern`` needs the automaton, and the automaton knows all of its syntax."""
    if pattern.linear:
        return False
    try:
        pc.match_substring_regex(pa.array([""]), pattern.re2)
    except pa.ArrowInvalid:
        return False
    return True


def matches(value: Column, pattern: Pattern) -> Column:
    """Whether ``pattern`` is found in ``value``; null where that is null."""
    if not by_automaton(pattern):
        return value.rlike(pattern.java)
    re2 = pattern.re2

    def run(values: pa.Array) -> pa.Array:
        return pc.match_substring_regex(values, re2)

    return F.arrow_udf(run, "boolean")(value)


def any_matches(fields: Column, name: str, pattern: Pattern) -> Column:
    """Whether an entry of that name has a value in which ``pattern`` is found; by the automaton, false where null."""
    re2 = pattern.re2

    def run(lists: pa.Array) -> pa.Array:
        entries = pc.list_flatten(lists)
        hit = pc.and_(pc.equal(pc.struct_field(entries, "name"), name), pc.match_substring_regex(pc.struct_field(entries, "value"), re2))
        out = np.zeros(len(lists), bool)
        out[pc.list_parent_indices(lists).to_numpy()[pc.fill_null(hit, False).to_numpy(zero_copy_only=False)]] = True
        return pa.array(out)

    return F.arrow_udf(run, "boolean")(fields)
