"""Unicode normal forms, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composed form; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")
