"""Caps on what is brought to the driver.  Distributed reads have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.study import StudyError

# Elements of an eager read, of a validation and of an opening.
MAX_EAGER = 1 << 31
MAX_VALIDATION = 1 << 26
MAX_OPEN = 1 << 20


def elements(frame: DataFrame) -> int:
    """How many values a frame holds, arrays by their length."""
    arrays = [n for n, t in frame.dtypes if t.startswith("array")]
    plain = len(frame.columns) - len(arrays)
    sized = sum((F.coalesce(F.size(n), F.lit(0)) for n in arrays), F.lit(plain))
    return frame.agg(F.coalesce(F.sum(sized.cast("bigint")), F.lit(0)).alias("n")).first().n


def collect_within(frame: DataFrame, most: int = MAX_EAGER) -> list:
    """Collect a frame, or refuse it if it holds more than ``most`` values."""
    n = elements(frame)
    if n > most:
        raise StudyError("E41", f"{n} values are more than the {most} that one read may hold")
    return frame.collect()
