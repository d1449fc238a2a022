"""The measures that Spark SQL lacks, by name, for use in SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinledger.functions import similarity as sim

PREFIX = "kl_"


def register(spark: SparkSession) -> list[str]:
    """Registers kl_jaro_winkler, kl_sequence_ratio and kl_metaphone, and returns their names."""

    def two(f):
        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(a.fillna(""), b.fillna(""))], dtype="float64")

        return run

    @F.pandas_udf("string")
    def metaphone(a: pd.Series) -> pd.Series:
        return a.fillna("").map(sim.metaphone_of)

    made = {"jaro_winkler": two(sim.jaro_winkler), "sequence_ratio": two(sim.ratio), "metaphone": metaphone}
    for name, f in made.items():
        spark.udf.register(PREFIX + name, f)
    return [PREFIX + name for name in made]
