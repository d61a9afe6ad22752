"""Unicode normalisation, which built-in functions don't have: in Arrow batches, and only for texts beyond ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """The text with compatibility forms composed: full-width letters, ligatures, circled numbers and the like become plain. Texts of ASCII alone aren't sent to Python; null stays null."""

    @F.pandas_udf("string")
    def normalised(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(normalised(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
