"""Names, types and defaults of the data model.

Series are long: one row an asset and bar. A missing value is NULL; NaN and infinities do not live in columns
(see functions.numeric.finite), so aggregates never meet them.
"""

from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampNTZType

BAR = StructType(
    [StructField("asset", StringType()), StructField("ts", TimestampNTZType())]
    + [StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
OHLC = ("open", "high", "low", "close")
OHLCV = (*OHLC, "volume")

# Windows and bounds of the feature catalogue, in rows of one hour.
VOL_WINDOW = 24
ZSCORE_WINDOW = 720
VOLUME_WINDOW = 336
FFD_WINDOW = 100
MAX_LOOKBACK = 720
PURGE = 720
EMBARGO = 24
CONTEXT_ROWS = 336
MIN_IQR = 1e-2
SCALER_CLIP = 5.0
RETURN_CLIP = 0.20
HOURS_A_YEAR = 8760
TRADING_HOURS_A_YEAR = 252 * 24

#: Columns that hold no market feature: never scaled, last in an observation.
REGIME_COLUMNS = ("hmm_prob_0", "hmm_prob_1", "hmm_prob_2", "hmm_prob_3", "hmm_entropy")
REGIME_PREFIXES = ("hmm_", "prob_")


def feature_columns(schema: StructType, exclude: tuple[str, ...] = ()) -> list[str]:
    """Feature columns by rule: floating point, not excluded, not of a regime, not raw prices or volume."""
    skip = {"asset", "ts", *OHLCV, *exclude}
    return [
        f.name for f in schema.fields
        if f.dataType.typeName() in ("double", "float") and f.name not in skip and not f.name.lower().startswith(REGIME_PREFIXES)
    ]


def regime_last(columns: list[str]) -> list[str]:
    """Columns with the five regime columns last; ValueError if one is missing."""
    missing = [c for c in REGIME_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"missing regime columns: {missing}")
    return [c for c in columns if c not in REGIME_COLUMNS] + list(REGIME_COLUMNS)
