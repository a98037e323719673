"""Compatibility forms of text beyond the width of characters; texts go to Python by Arrow batches."""

from unicodedata import is_normalized, normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode's NFKC: ligatures, circled and squared characters, fractions, widths, combining marks."""
    return pa.array([x if x is None or is_normalized("NFKC", x) else normalize("NFKC", x) for x in texts.to_pylist()], pa.string())


def full_key(c: Column) -> Column:
    """``text.normal_key`` after NFKC in full."""
    return T.normal_key(nfkc(c))


def full_value(c: Column) -> Column:
    """``text.normal_value`` after NFKC in full."""
    return T.normal_value(nfkc(c))
