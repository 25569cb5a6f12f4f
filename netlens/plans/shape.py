"""Output shaping shared by the registered queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column, so sums taken in another order compare equal."""
    return df.select(
        *[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)
