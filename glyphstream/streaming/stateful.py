"""Fuzzy runs over a stream: open runs are the state of each stream of observations."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.runs import RunBuilder, ticks_of

OUT = "stream_id long, t_start long, t_end long, text string, n_obs long, conf double"


def fuzzy_runs_stream(obs: DataFrame, sample_us: int, gap: float = 0) -> DataFrame:
    """Runs that have ended, as soon as a later tick of their stream shows it.

    obs: stream_id, t_us, text, conf, box. Times of a stream have to rise from batch to batch; a
    tick that isn't later than all before it raises, as a clock that runs back makes every run
    wrong. A row with a null text marks the end of its stream and lets all of its runs out.
    State is bounded by the texts on screen at once.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        builder = pickle.loads(state.get[0]) if state.exists else RunBuilder(sample_us, gap)
        rows = pd.concat(list(parts))
        done: list[dict] = []
        for t, tick in ticks_of(rows[rows["text"].notna()]):
            if t <= builder.last:
                raise ValueError(f"stream {key[0]}: time {t} does not rise")
            done += builder.feed(t, tick)
        if rows["text"].isna().any():
            done += builder.close(None)
        state.update((pickle.dumps(builder),))
        out = pd.DataFrame(done, columns=["t_start", "t_end", "text", "n_obs", "conf"])
        out.insert(0, "stream_id", key[0])
        yield out

    flat = obs.select("stream_id", "t_us", "text", "conf", F.col("box.x0").alias("x0"), F.col("box.y0").alias("y0"), F.col("box.x1").alias("x1"), F.col("box.y1").alias("y1"))
    return flat.groupBy("stream_id").applyInPandasWithState(run, OUT, "builder binary", "append", GroupStateTimeout.NoTimeout)
