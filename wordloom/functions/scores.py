"""Association and term-weight formulas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(n: Column, total: Column) -> Column:
    return F.try_divide(n.cast("double"), total.cast("double"))


def pmi(together: Column, first: Column, second: Column, total: Column) -> Column:
    """ln(p(xy) / (p(x) p(y))); 0 where any count is 0."""
    ratio = F.try_divide(_share(together, total), _share(first, total) * _share(second, total))
    return F.when((together > 0) & (first > 0) & (second > 0), F.log(ratio)).otherwise(0.0)


def npmi(together: Column, first: Column, second: Column, total: Column) -> Column:
    """PMI over -ln p(xy); 0 where the pair is in no sentence or in all of them."""
    return F.coalesce(F.try_divide(pmi(together, first, second, total), -F.log(_share(F.when(together > 0, together), total))), F.lit(0.0))


def idf(df: Column, total: Column) -> Column:
    """Smoothed: ln((1 + N) / (1 + df)) + 1."""
    return F.log((1 + total).cast("double") / (1 + df).cast("double")) + 1


def of_arrays(together: np.ndarray, first: np.ndarray, second: np.ndarray, total: int) -> dict[str, np.ndarray]:
    """``pmi`` and ``npmi`` of pairs in at least one sentence, by the same steps."""
    share = together / total
    found = np.log(share / ((first / total) * (second / total)))
    below = -np.log(share)
    return {"pmi": found, "npmi": np.divide(found, below, out=np.zeros_like(found), where=below != 0)}


def rounded_array(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from 0; no negative 0."""
    unit = 10.0**digits
    return np.trunc(x * unit + np.copysign(0.5, x)) / unit + 0.0
