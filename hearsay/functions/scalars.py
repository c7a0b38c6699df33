"""Number, date, label and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label cut-off, sarcasm constants, date format.
LABEL_CUT = 0.05
DOWNWEIGHT, SARCASM_BIAS = 0.35, 0.10
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# Seconds a nanosecond timestamp can hold either side of 1970; beyond it a date is missing.
MAX_EPOCH_SECONDS = 9_223_372_036.0
UNIT_SECONDS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: Column | str) -> Column:
    """Number or null; text that is no number never fails the job."""
    return _col(c).try_cast("double")


def to_long(c: Column | str, source_type: str = "string") -> Column:
    """Whole number or null. Integers pass untouched, text goes by way of double ('12.0' is 12)."""
    if source_type in ("bigint", "int", "smallint", "tinyint"):
        return _col(c).cast("bigint")
    return F.trim(_col(c).cast("string")).try_cast("double").try_cast("bigint")


def clip_weight(c: Column | str) -> Column:
    """Weight that cannot be negative; missing or unreadable counts as 0."""
    return F.greatest(F.coalesce(F.nanvl(to_double(c), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def fill_weight(c: Column | str) -> Column:
    """Weight with missing values as 0; may be negative."""
    return F.coalesce(_col(c), F.lit(0))


def bytes_to_long(blob: Column | str, unsigned: bool = False) -> Column:
    """Integer from little-endian bytes: eight bytes are a signed long, fewer are unsigned.

    ``unsigned=True`` reads eight bytes as decimal(20,0). More than eight bytes are no integer: null.
    """
    fitting = F.when(F.octet_length(_col(blob)) <= 8, _col(blob))
    pairs = F.regexp_extract_all(F.hex(fitting), F.lit("(..)"), F.lit(1))
    digits = F.array_join(F.reverse(pairs), "")
    whole = F.conv(F.when(digits == "", F.lit("0")).otherwise(digits), 16, 10 if unsigned else -10)
    return whole.cast("decimal(20,0)" if unsigned else "bigint")


def epoch_to_timestamp(c: Column | str, unit: str = "s") -> Column:
    """UTC timestamp of an epoch count; unreadable or out of range is null."""
    seconds = to_double(c) * F.lit(UNIT_SECONDS[unit])
    return F.when(F.abs(seconds) <= MAX_EPOCH_SECONDS, F.timestamp_seconds(seconds))


def listing_timestamp(c: Column | str) -> Column:
    """Creation time of a listing row; epoch 0 means unknown."""
    return epoch_to_timestamp(F.nullif(to_double(c), F.lit(0.0)))


def epoch_to_iso(c: Column | str) -> Column:
    return F.date_format(epoch_to_timestamp(c), ISO_UTC)


def parse_date(c: Column | str, source_type: str = "string") -> Column:
    """Timestamp from text, a timestamp, or epoch seconds, by the column's type."""
    if source_type == "string":
        return F.try_to_timestamp(_col(c))
    if source_type in ("timestamp", "timestamp_ntz", "date"):
        return _col(c).cast("timestamp")
    return epoch_to_timestamp(c)


def month_start(ts: Column | str) -> Column:
    return F.date_trunc("month", _col(ts))


def year_start(ts: Column | str) -> Column:
    return F.date_trunc("year", _col(ts))


def _label(score: Column, positive: str, negative: str, neutral: str) -> Column:
    # NaN is greater than any number in Spark, so it is made null first: null is neutral.
    known = F.nanvl(score, F.lit(None).cast("double"))
    return (
        F.when(known > LABEL_CUT, positive).when(known < -LABEL_CUT, negative).otherwise(neutral)
    )


def label_sentiment(score: Column | str) -> Column:
    return _label(_col(score), "positive", "negative", "neutral")


def label_score(score: Column | str) -> Column:
    return _label(_col(score), "mostly positive", "mostly negative", "mostly neutral")


def row_mean(*cols: Column | str) -> Column:
    """Mean across columns of one row, nulls skipped."""
    parts = [_col(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    known = sum((c.isNotNull().cast("int") for c in parts[1:]), parts[0].isNotNull().cast("int"))
    return total / F.nullif(known, F.lit(0))


def softmax(*logits: Column | str) -> list[Column]:
    """Probabilities of one row of logits, shifted by the largest so nothing overflows."""
    parts = [_col(c) for c in logits]
    top = F.greatest(*parts)
    powers = [F.exp(c - top) for c in parts]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def negativity(negative: Column | str, positive: Column | str) -> Column:
    return _col(negative) - _col(positive)


def effective_negativity(
    raw: Column | str,
    sarcasm: Column | str,
    downweight: float = DOWNWEIGHT,
    sarcasm_bias: float = SARCASM_BIAS,
) -> Column:
    """Negativity in which a sarcastic share is trusted less and leans to the negative."""
    raw, sarcasm = _col(raw), _col(sarcasm)
    softened = F.lit(downweight) * raw + F.lit(sarcasm_bias)
    return (F.lit(1.0) - sarcasm) * raw + sarcasm * softened


def is_complaint(score: Column | str, cut: float = 0.2) -> Column:
    return (_col(score) > cut) & ~F.isnan(_col(score))
