"""The diversity filters on a stream: each video's last accepted vectors are its state."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Filter


def stream_fold(rows: DataFrame, make_filter: Callable[[], Filter], vector: str = "vec", video: str = "video", index: str = "idx") -> DataFrame:
    """(video, index, accepted) of a stream of (video, index, vector).

    The result is that of the batch fold if a video's frames arrive in order from one batch to the next;
    within a batch they are sorted. State is bounded by the filter's memory.
    """
    kinds = [rows.schema[c].dataType.simpleString() for c in (video, index)]
    schema = f"{video} {kinds[0]}, {index} {kinds[1]}, accepted boolean"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keep = make_filter()
        if state.exists:
            for v in pickle.loads(state.get[0]):
                keep.accept(v)
        new = pd.concat(list(parts)).sort_values(index)
        accepted = []
        for v in new[vector]:
            v = np.array(v, float)
            accepted.append(keep.passes(v))
            if accepted[-1]:
                keep.accept(v)
        state.update((pickle.dumps(list(keep.kept)),))
        yield pd.DataFrame({video: new[video], index: new[index], "accepted": accepted})

    picked = rows.select(video, index, vector)
    return picked.groupBy(video).applyInPandasWithState(run, schema, "kept binary", "append", GroupStateTimeout.NoTimeout)
