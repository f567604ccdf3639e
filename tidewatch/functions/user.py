"""Functions of the user's own in SQL: a scalar one as SQL text, an aggregate over Arrow batches, a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@F.pandas_udf("double")
def rms(values: pd.Series) -> float:
    """Root of the mean square: an aggregate that Spark does not have."""
    return float((values.dropna() ** 2).mean() ** 0.5)


@F.udtf(returnType="letter string, n long")
class Letters:
    """A row for every letter of a text."""

    def eval(self, text: str):
        for letter in text or "":
            yield letter, 1


def register_functions(spark: SparkSession) -> None:
    """Make the functions known to SQL, for this session only."""
    spark.sql("create or replace temporary function tidewatch_scaled(x double) returns double return x * 1.5D + 1")
    spark.udf.register("tidewatch_rms", rms)
    spark.udtf.register("tidewatch_letters", Letters)
