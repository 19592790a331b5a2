"""Full-text matching and ranking: all terms must occur, rank by cover density.

Terms are the runs of letters and digits of the lower-cased text, without stemming or stop words. A cover is a shortest
stretch that holds all terms of the query; the rank adds up, over the covers, the reciprocal of the cover's length beyond
the number of terms plus one. For one term that is the number of its occurrences. The ranks order results; their scale
carries no meaning.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter

WEIGHT = 0.1
_SPLIT = r"[^\p{L}\p{N}]+"


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, in order."""
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda t: t != "")


def matches(text: Column, query: str) -> Column:
    """Whether all terms of the query occur; a query without terms matches nothing."""
    wanted = query_terms(query)
    if not wanted:
        return F.lit(False)
    found = terms(text)
    out = F.lit(True)
    for t in wanted:
        out = out & F.array_contains(found, t)
    return out


def rank(text: Column, query: str) -> Column:
    """The cover density of a text that matches; 0 for others."""
    wanted = query_terms(query)
    if not wanted:
        return F.lit(0.0)
    found = terms(text)
    if len(wanted) == 1:
        return WEIGHT * F.size(F.filter(found, lambda t: t == wanted[0])).cast("double")
    # (position, number of the term) of every occurrence of a term, in order
    marks = F.filter(F.transform(found, lambda t, i: F.struct(i.alias("p"), F.array_position(F.array(*(F.lit(w) for w in wanted)), t).cast("int").alias("t"))), lambda m: m["t"] > 0)
    zero = F.struct(F.array_repeat(F.lit(-1), len(wanted)).alias("last"), F.lit(-1).alias("from"), F.lit(0.0).alias("sum"))

    def step(state: Column, m: Column) -> Column:
        last = F.transform(state["last"], lambda x, i: F.when(i + 1 == m["t"], m["p"]).otherwise(x))
        start = F.array_min(last)  # a cover ends here if all terms were seen and its start is a new one
        cover = (start >= 0) & (start > state["from"])
        gain = 1.0 / (m["p"] - start + 2 - len(wanted))
        return F.struct(last.alias("last"), F.when(cover, start).otherwise(state["from"]).alias("from"), (state["sum"] + F.when(cover, gain).otherwise(0.0)).alias("sum"))

    return WEIGHT * F.aggregate(marks, zero, step, lambda s: s["sum"])


def check_query(query: str, column: str) -> None:
    if not 1 <= len(query.encode()) <= 4096:
        raise InvalidParameter("a text query has 1 to 4096 bytes")
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", column):
        raise InvalidParameter(f"malformed column name {column!r}")
