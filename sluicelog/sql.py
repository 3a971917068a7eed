"""Any Spark SQL over one table."""

from pyspark.sql import DataFrame

VIEW = "records"


def run_sql(df: DataFrame, query: str, view: str = VIEW) -> DataFrame:
    """The result of ``query``, in which ``view`` names ``df``. Lazy; all of Spark's SQL may be used."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(query)
