"""Unicode composition (NFC), which Spark SQL lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def composed(text: Column) -> Column:
    """``text`` in composed form.

    Only rows that hold a combining mark are sent to Python; the rest stays as it is.
    """
    marked = text.rlike(r"\p{M}")
    return F.when(marked, _nfc(F.when(marked, text))).otherwise(text)
