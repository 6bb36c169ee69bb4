"""Min-max scaling fitted as one aggregate; transform and inverse as column maths.

``fit`` is the only action: a single-row aggregate (two numbers per column)
brought to the driver, as any estimator's fit does.  A constant column scales
to 0 (range treated as 1).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MinMax:
    cols: tuple[str, ...]
    lo: tuple[float, ...]
    hi: tuple[float, ...]

    def scale_of(self, i: int) -> float:
        rng = self.hi[i] - self.lo[i]
        return 1.0 / (rng if rng != 0 else 1.0)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        exprs = {}
        for i, c in enumerate(self.cols):
            s = self.scale_of(i)
            offset = 0.0 - self.lo[i] * s
            exprs[c + suffix] = F.col(c) * F.lit(s) + F.lit(offset)
        return df.withColumns(exprs)

    def inverse(self, df: DataFrame, col: str, target: str, out: str | None = None) -> DataFrame:
        """Undo the scaling of ``target`` held in ``col``."""
        i = self.cols.index(target)
        s = self.scale_of(i)
        offset = 0.0 - self.lo[i] * s
        return df.withColumn(out or col, (F.col(col) - F.lit(offset)) / F.lit(s))


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> MinMax:
    row = df.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)]).first()
    lo = tuple(float(row[f"lo_{i}"]) for i in range(len(cols)))
    hi = tuple(float(row[f"hi_{i}"]) for i in range(len(cols)))
    return MinMax(tuple(cols), lo, hi)
