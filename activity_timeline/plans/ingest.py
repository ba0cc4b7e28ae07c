"""Recordings at their own rates to the samples that an analysis takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.operators.signal import resample
from activity_timeline.params import Params


def ingest(samples: DataFrame, params: Params, block: int | None = None) -> DataFrame:
    """Samples with a sample_rate column (`wav_samples`), each track brought to params.sample_rate.

    The tracks of a session may end at different times: `analyze` takes what is
    missing of the shorter one as silence.
    """
    return resample(samples, F.col("sample_rate"), params.sample_rate, block)
