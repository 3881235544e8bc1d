"""The most frequent keys of a table of counts, bounded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, key: str, most: int, always: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts ``n``, in order of key, of as many of the most frequent keys as fit ``most``, ties whole.

    A histogram over sixteenths of powers of two finds from which count on they fit, so no sort and no more than
    ``most`` rows reach the driver; rows for which ``always`` holds come besides.
    """
    bin_of = F.floor(F.log2("n") * 16)
    left, least = most, None
    for b, n in sorted(counts.groupBy(bin_of.alias("b")).count().collect(), reverse=True):
        if n > left:
            break
        left, least = left - n, b
    wanted = F.lit(False) if always is None else always
    if least is not None:
        wanted = wanted | (bin_of >= least)
    t = counts.where(wanted).select(key, "n").toArrow()
    order = np.argsort(t[key].to_numpy(), kind="stable")
    return t[key].to_numpy()[order], t["n"].to_numpy()[order]
