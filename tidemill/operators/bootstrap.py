"""Bootstrap intervals of Cohen's d."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of the sorted resamples that the interval leaves below and above (fixed values).
LOW, HIGH = 0.025, 0.975


def intervals(rows: DataFrame, features: list[str], first: str, second: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """(cohort_scope, feature_name, ci_low, ci_high): the 95 % interval of Cohen's d of `first` against `second`.

    rows: key, side, cohort_scope, features. A row comes in each resample as often as a Poisson draw of mean 1
    says, seeded by its key, so a resample needs no rows at hand but sums: tasks add up counts, sums and squares,
    and those are added by scope, feature and resample. Null features count as 0. Resamples in which a side has
    fewer than two rows or nothing varies have a d of 0. Scopes in which a side has fewer than two rows give none.
    """
    names = ["cohort_scope", "side", "feature_name", "resample"]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for x in batches:
            draws = np.empty((len(x), resamples))
            for i, own in enumerate(x["own_seed"]):
                draws[i] = np.random.default_rng([seed, own & (2**63 - 1)]).poisson(1.0, resamples)
            values = x[features].fillna(0.0).to_numpy(dtype=float)
            for key, at in x.groupby(["cohort_scope", "side"]).indices.items():
                n, v = draws[at].T, values[at]
                new = np.stack([np.repeat(n.sum(1)[:, None], len(features), 1), n @ v, n @ (v * v)])
                sums[key] = sums[key] + new if key in sums else new
        for (scope, side), s in sums.items():
            k, f = np.meshgrid(np.arange(resamples), np.arange(len(features)), indexing="ij")
            yield pd.DataFrame({"cohort_scope": scope, "side": side, "feature_name": np.array(features)[f.ravel()], "resample": k.ravel(), "n": s[0].ravel(), "s": s[1].ravel(), "q": s[2].ravel()})

    rows = rows.where(F.col("side").isin(first, second))
    enough = rows.groupBy("cohort_scope").agg(*[F.count_if(F.col("side") == x).alias(n) for n, x in (("a", first), ("b", second))]).where("a >= 2 and b >= 2").select("cohort_scope")
    given = rows.select("cohort_scope", "side", F.xxhash64("key").alias("own_seed"), *[F.col(f).cast("double").alias(f) for f in features])
    parts = given.mapInPandas(add, "cohort_scope string, side string, feature_name string, resample int, n double, s double, q double")
    whole = parts.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    of = lambda c, x: F.coalesce(F.max(F.when(F.col("side") == x, F.col(c))), F.lit(0.0)).alias(f"{c}_{'a' if x == first else 'b'}")
    both = whole.groupBy("cohort_scope", "feature_name", "resample").agg(*[of(c, x) for c in "nsq" for x in (first, second)])
    squares = [F.greatest(F.col(f"q_{i}") - F.col(f"s_{i}") * F.col(f"s_{i}") / F.col(f"n_{i}"), F.lit(0.0)) for i in "ab"]
    pooled = F.sqrt((squares[0] + squares[1]) / (F.col("n_a") + F.col("n_b") - 2))
    d = F.when((F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (pooled > 1e-9), (F.col("s_a") / F.col("n_a") - F.col("s_b") / F.col("n_b")) / pooled).otherwise(0.0)
    sorted_d = both.withColumn("d", d).groupBy("cohort_scope", "feature_name").agg(F.sort_array(F.collect_list("d")).alias("d"))  # `resamples` numbers a group
    return sorted_d.join(F.broadcast(enough), "cohort_scope").select("cohort_scope", "feature_name", F.round(F.col("d")[int(LOW * resamples)], 6).alias("ci_low"), F.round(F.col("d")[int(HIGH * resamples) - 1], 6).alias("ci_high"))
