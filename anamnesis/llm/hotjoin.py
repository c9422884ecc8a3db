"""A join to a table that says how often each of its keys is met: frequent keys are broadcast, rare ones shuffled.

A key that makes up at least one ``bound``-th of all rows is hot. There can be no more than
``bound`` such keys, whatever the data, so what is broadcast has a proven size; and a key that
isn't hot has fewer than a ``bound``-th of the rows, so no task of the shuffled part is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are broadcast at most.
BOUND = 200_000


def hot_apart(rows: DataFrame, table: DataFrame, key: str, weight: str, bound: int = BOUND) -> DataFrame:
    """The inner join of ``rows`` with ``table`` on ``key``, which is unique in ``table``; ``weight`` is how many rows have the key.

    Both are read more than once, so they should be written tables or cheap to compute. ``weight`` isn't returned.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * F.lit(bound) >= F.lit(total)
    often = F.broadcast(table.where(hot).drop(weight))  # at most ``bound`` rows
    if table.where(~hot).isEmpty():
        return rows.join(often, key)
    rare = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")  # only these are shuffled
    return rows.join(often, key).unionByName(rare.join(table.where(~hot).drop(weight).hint("merge"), key))
