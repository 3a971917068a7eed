"""From SQL and columns to a ``features`` vector."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import Normalizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.misc import or_category
from ..sql import run_sql


def transform(
    df: DataFrame, sql_query: str | None = None, numerical: list[str] = (), categorical: list[str] = (), normalize: bool = True, normalize_p: float = 2.0
) -> DataFrame:
    """``df`` (or the result of ``sql_query`` over it, as ``records``) with ``features``.

    Categories are indexed by falling frequency, ties by name, and one-hot
    encoded without the last; NULL is a category of its own. The vector holds
    the numbers in the given order, then the categories' slots in theirs; a
    NULL or NaN number counts as 0. With ``normalize`` each row's vector is
    divided by its ``normalize_p``-norm. Other columns stay.
    """
    if sql_query:
        df = run_sql(df, sql_query)
    if not numerical and not categorical:
        raise ValueError("no features named")
    kept = df.columns
    for c in numerical:
        df = df.withColumn(f"{c}_number", F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))
    for c in categorical:
        df = df.withColumn(f"{c}_category", or_category(F.col(c)))
    stages = []
    if categorical:
        # the order is the default one, but ties are broken by name for good
        stages.append(StringIndexer(inputCols=[f"{c}_category" for c in categorical], outputCols=[f"{c}_indexed" for c in categorical], handleInvalid="skip", stringOrderType="frequencyDesc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_indexed" for c in categorical], outputCols=[f"{c}_encoded" for c in categorical], dropLast=True))
    whole = "assembled" if normalize else "features"
    stages.append(VectorAssembler(inputCols=[*[f"{c}_number" for c in numerical], *[f"{c}_encoded" for c in categorical]], outputCol=whole))
    if normalize:
        stages.append(Normalizer(inputCol=whole, outputCol="features", p=float(normalize_p)))
    return Pipeline(stages=stages).fit(df).transform(df).select(*kept, "features")
