"""What the operators of this subpackage share: the durable tables and sized broadcasts of the core, and their text rules."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataquery.shared import clear_intermediates, fits, fresh, new_path, pin, shared_dir, sized, split_join

__all__ = ["SPACE_CLASS", "bound_batches", "clear_intermediates", "fits", "fresh", "new_path", "normal_space", "pin", "shared_dir", "sized", "split_join", "word_count"]

#: The white space of the word and line rules: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

#: Rows and bytes of an Arrow batch of texts; Spark's own bound of 10,000 rows alone would let long texts fill a worker.
BATCH_ROWS = 1000
BATCH_BYTES = 8 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches within BATCH_ROWS and BATCH_BYTES; smaller bounds of the user's stay."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"-?\d+", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= bound:
            spark.conf.set(key, str(bound))


def normal_space(text):
    """Null as empty, and each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def word_count(text):
    """Number of runs of characters that are no white space; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"{SPACE_CLASS}+"))).cast("long")
