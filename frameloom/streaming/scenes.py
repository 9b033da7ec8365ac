"""Scene cuts of films whose frames arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.sources.frames import SHORTEST, THRESHOLD, change


def stream_cuts(pictures: DataFrame, threshold: float = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """pictures (path, frame, picture) as a stream, each film's in order of arrival: path, frame, score of the frames that begin a scene.

    A film's last picture and the begin of its scene are its state, so a cut may fall between two batches. Frames that were seen already are ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, picture, begin = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for frame, shades in zip(rows["frame"].tolist(), rows["picture"], strict=True):
            if last is not None and frame <= last:
                continue
            score = 0.0 if picture is None else change(bytes(shades), bytes(picture))
            begin = frame if begin is None else begin
            if score >= threshold and frame - begin >= shortest:
                out.append((key[0], frame, score))
                begin = frame
            last, picture = frame, shades
        state.update((last, picture, begin))
        yield pd.DataFrame(out, columns=["path", "frame", "score"])

    return pictures.groupBy("path").applyInPandasWithState(step, "path string, frame long, score double", "last long, picture binary, begin long", "append", GroupStateTimeout.NoTimeout)
