"""Binary codec of vectors: little-endian 32-bit floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def to_blob(vec: pd.Series) -> pd.Series:
    return vec.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))
