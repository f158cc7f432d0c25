"""C7 and the deterministic stand-in score.

``predict`` turns a raw probability column into LATE_PROB (rounded half-even to 4), LATE_PRED
(from the unrounded probability) and RISK_LABEL (right-closed bins on the unrounded one).
``standin_probability`` is a model-free score - the prior late rate shrunk towards the portfolio
base rate - so every downstream report has an exact oracle before a model is trained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import STANDIN_PRIOR_RATE, STANDIN_PRIOR_WEIGHT
from ..functions.expressions import risk_label

# FIXED VALUE: decision threshold stored with the published model
DEFAULT_THRESHOLD = 0.5600000000000003


def standin_probability(fs: DataFrame, out: str = "RAW_PROB") -> DataFrame:
    n = F.col("CUST_INVOICE_COUNT")
    prior = F.lit(float(STANDIN_PRIOR_RATE * STANDIN_PRIOR_WEIGHT))
    p = (F.col("CUST_LATE_RATE") * n + prior) / (n + STANDIN_PRIOR_WEIGHT)
    return fs.withColumn(out, p)


def predict(df: DataFrame, threshold: float, raw: str = "RAW_PROB") -> DataFrame:
    """LATE_PROB, LATE_PRED, RISK_LABEL from the raw probability column (then dropped)."""
    p = F.col(raw)
    return df.select(
        "*",
        F.bround(p, 4).alias("LATE_PROB"),
        (p >= F.lit(float(threshold))).cast("int").alias("LATE_PRED"),
        risk_label(p).alias("RISK_LABEL"),
    ).drop(raw)
