"""High-water marks: text, typed columns, lookback."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.spec import NUMBER, TIMESTAMP, TargetSpec

#: Accepted timestamp text.  A cast is looser, so text is matched before it is cast.
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
NUMBER_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
TYPES = {TIMESTAMP: "timestamp_ntz", NUMBER: "decimal(38,10)"}
CANONICAL = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def parse(text: str, kind: str) -> datetime | Decimal:
    """Typed watermark of a text; ValueError for any other form."""
    if kind == NUMBER:
        if not re.match(NUMBER_TEXT, text):
            raise ValueError(f"{text!r} is not a valid number")
        return Decimal(text)
    if not re.match(TIMESTAMP_TEXT, text):
        raise ValueError(f"{text!r} does not parse as TIMESTAMP")
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f" if "." in text else "%Y-%m-%d %H:%M:%S")


def render(value: datetime | Decimal | None) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")
    text = format(Decimal(value), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def effective(spec: TargetSpec, last: datetime | Decimal | None, on_first_page: bool = True) -> datetime | Decimal:
    """Where a page begins: the initial mark without a stored one; on the first page of a
    run with lookback the stored one less that, in whole seconds; else the stored one."""
    if last is None:
        return parse(spec.initialWm, spec.watermarkType)
    if spec.lookbackMinutes is None or not on_first_page or spec.watermarkType == NUMBER:
        return last
    return last.replace(microsecond=0) - timedelta(minutes=spec.lookbackMinutes)


def parsed(text: Column, kind: str) -> Column:
    """Typed watermark of a text column; null for any other form."""
    pattern = NUMBER_TEXT if kind == NUMBER else TIMESTAMP_TEXT
    return F.when(text.rlike(pattern), text.try_cast(TYPES[kind]))


def rendered(mark: Column) -> Column:
    return F.date_format(mark, CANONICAL)


def looked_back(mark: Column, minutes: int) -> Column:
    """The column form of the lookback."""
    return (F.date_trunc("SECOND", mark) - F.make_interval(mins=F.lit(minutes))).cast("timestamp_ntz")
