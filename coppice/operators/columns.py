"""Column names, feature and label choice."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame

from coppice.functions.names import clean_name


def clean_columns(df: DataFrame) -> DataFrame:
    """Rename every column by :func:`clean_name`, in one projection."""
    names = [clean_name(name) for name in df.columns]
    repeated = sorted(name for name, n in Counter(names).items() if n > 1)
    if repeated:
        raise ValueError(f"columns share a name after cleaning: {repeated}")
    return df.toDF(*names)


def split_columns(df: DataFrame, label: str | None = None, drop: Iterable[str] = ()) -> tuple[list[str], str]:
    """Feature names and label name.

    The label is the last column unless named; every other column that is not in
    ``drop`` is a feature, in table order.
    """
    if label is None:
        label = df.columns[-1]
    elif label not in df.columns:
        raise ValueError(f"no label column {label!r} in {df.columns}")
    unwanted = {label, *drop}
    return [name for name in df.columns if name not in unwanted], label
