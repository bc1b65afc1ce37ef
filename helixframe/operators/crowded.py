"""Keys that very many rows have, found without an exchange of all keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.plans.scratch import cut


def crowded_keys(df: DataFrame, key: Column, sums: dict[str, Column], limit: int, total: int) -> DataFrame | None:
    """(key, one column for each of ``sums``): the long keys of which a sum exceeds ``limit``; nothing where no key's can.

    A count-min sketch bounds them first: keys fall into cells in two ways, and
    no key sums up to more than its cell does in either. A task passes on a row
    for each cell at most, not for each key, and only the keys of full cells are
    summed by themselves, in an exchange of their own; mostly there are none.
    ``total``: about what a sum comes to over all keys, by which the cells' number
    follows, so that an average cell has an eighth of the limit.
    """
    cells = 1 << max(8, (8 * total // max(1, limit)).bit_length())
    own = df.select(key.alias("key"), *[c.alias(name) for name, c in sums.items()])
    full = " OR ".join(f"{name} > {limit}" for name in sums)
    added = [F.sum(name).alias(name) for name in sums]
    ways = [F.pmod(F.xxhash64("key", F.lit(w)), F.lit(cells)) for w in (0, 1)]
    both = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), x.alias("cell")) for w, x in enumerate(ways)])).alias("x")
    sketch = own.select(both, *sums).groupBy("x.way", "x.cell").agg(*added).filter(full).select("way", "cell")
    sketch = cut(sketch, "cells", rows=2 * cells)
    if sketch.isEmpty():
        return None
    for w, x in enumerate(ways):
        own = own.join(sketch.filter(F.col("way") == w).select("cell"), x == F.col("cell"), "left_semi")
    found = cut(own.groupBy("key").agg(*added).filter(full), "crowded")
    return None if found.isEmpty() else found
