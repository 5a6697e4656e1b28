"""Scoring a stream of names against a static list: stateless, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_onoma.functions import scoring as sc
from spark_onoma.operators.match import _decide, resolved


def score_stream(stream: DataFrame, reference: DataFrame, on, a: str, b: str, options: sc.MatchOptions = sc.MatchOptions()) -> DataFrame:
    """Stream rows joined with the static frame by ``on`` (a blocking key) and scored; works on batch frames too."""
    pairs = stream.join(reference, on)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(similarity=[sc.best_evaluation(x, y, resolved(options))[0] for x, y in zip(batch[a], batch[b], strict=True)])

    return _decide(pairs.mapInPandas(run, pairs.withColumn("similarity", F.lit(0.0)).schema), options)
