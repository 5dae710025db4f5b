"""What a text shares with a golden profile, whole texts at a time: a column."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship


def profile(spark: SparkSession, golden: dict[bytes, int], first: int | None) -> Callable[[Column], Column]:
    """(n, common, squares) of a text: its words, and of its ``first`` ones (all where None) the sums of count times golden count and of squared counts.

    These are whole numbers, so that no order of words or rows shows in a cosine made of them. Without a text ``n`` is null.
    """
    ship(spark)
    held = spark.sparkContext.broadcast(golden)

    @F.pandas_udf("struct<n: bigint, common: bigint, squares: bigint>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = held.value
        for batch in texts:
            rows = []
            for text in batch:
                words = [] if text is None else text.encode().split()  # of bytes, at the same six blanks as in SQL
                bag = Counter(words if first is None else words[:first])
                rows.append((None if text is None else len(words), sum(bag[w] * counts[w] for w in bag.keys() & counts.keys()), sum(n * n for n in bag.values())))
            yield pd.DataFrame(rows, columns=["n", "common", "squares"]).astype("Int64")

    return of
