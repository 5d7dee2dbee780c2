"""Records of JSON array files, read in byte ranges by many tasks.

Where a range starts, nothing tells whether that is inside a text, or how deep. So ranges are read twice. First each range says, for a start
outside and for one inside a text, where it would end up: one row a range. Running over those rows gives every range its true start. Then each range
cuts out the records that begin in it, and reads on to the end of its last one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .files import listed, opener

#: Bytes of a range.
RANGE = 16 << 20


def _marks():
    """A function from bytes to (quotes that are not escaped, depth steps where no text is), given how many backslashes stand before."""

    def marks(data: bytes, escapes: int) -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(data, dtype=np.uint8)
        slash = b == 92
        at = np.arange(len(b))
        # Backslashes right before each byte: the distance to the last byte that is none.
        last = np.maximum.accumulate(np.where(slash, -1 - escapes, at))
        before = np.concatenate(([escapes], np.where(slash, at - last, 0)[:-1])) if len(b) else np.zeros(0, dtype=np.int64)
        quotes = (b == 34) & (before % 2 == 0)
        steps = np.where((b == 91) | (b == 123), 1, np.where((b == 93) | (b == 125), -1, 0))
        return quotes, steps

    return marks


def _begin():
    """A function from a stream and a place to the number of backslashes right before it."""

    def begin(stream, start: int) -> int:
        n = 0
        while start - n > 0:
            stream.seek(start - n - 1)
            if stream.read(1) != b"\\":
                break
            n += 1
        return n

    return begin


def _ends():
    """(path, start, stop) to what a range does: whether it leaves the text it is in, and its depth step for both starts."""
    find, marks, begin = opener(), _marks(), _begin()

    def run(frames):
        for frame in frames:
            out = []
            for path, start, stop in frame.itertuples(index=False):
                with find(path)() as stream:
                    escapes = begin(stream, start)
                    stream.seek(start)
                    quotes, steps = marks(stream.read(stop - start), escapes)
                inside = np.cumsum(quotes) % 2 == 1
                out.append((path, start, stop, bool(quotes.sum() % 2), int(steps[~inside].sum()), int(steps[inside].sum())))
            yield pd.DataFrame(out, columns=["path", "start", "stop", "turns", "outside", "inside"])

    return run


def _records():
    """(path, start, stop, text, depth) to the texts of the records that begin in the range: objects right inside the array."""
    find, marks, begin = opener(), _marks(), _begin()

    def run(frames):
        for frame in frames:
            for path, start, stop, text, depth in frame.itertuples(index=False):
                found = []
                with find(path)() as stream:
                    escapes, at, held = begin(stream, start), start, b""
                    stream.seek(start)
                    inside, level = bool(text), int(depth)
                    opened = False
                    while at < stop or opened:
                        data = stream.read(stop - at if at < stop else 1 << 20)
                        if not data:
                            break
                        quotes, steps = marks(data, escapes)
                        within = (np.cumsum(quotes) + inside) % 2 == 1
                        levels = level + np.cumsum(np.where(within, 0, steps))
                        first = np.flatnonzero((steps == 1) & ~within & (levels == 2))
                        last = np.flatnonzero((steps == -1) & ~within & (levels == 1))
                        first = first[first + at < stop]
                        cut = 0
                        if opened and len(last):
                            found.append(held + data[: last[0] + 1])
                            held, opened = b"", False
                        for i in first.tolist():
                            j = int(np.searchsorted(last, i))
                            if j < len(last):
                                found.append(data[i : last[j] + 1])
                            else:
                                cut, opened = i, True
                        if opened:
                            held += data[cut:]
                        tail = len(data) - len(data.rstrip(b"\\"))
                        escapes = tail + (escapes if tail == len(data) else 0)
                        inside, level, at = bool(within[-1]), int(levels[-1]), at + len(data)
                yield pd.DataFrame({"record": pd.Series([r.decode() for r in found], dtype=object)})

    return run


def read_array_records(spark: SparkSession, glob: str, size: int = RANGE) -> DataFrame:
    """(record): the text of every object right inside the JSON arrays of the files, in ranges of ``size`` bytes.

    The rows that carry a file's state over its ranges are one a range; nothing of the files' contents comes to one task.
    """
    step = F.lit(size).cast("bigint")
    parts = listed(spark, glob).where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, step)).alias("start"))
    parts = parts.select("path", "start", F.least(F.col("start") + step, F.col("size")).alias("stop")).repartition("path", "start")
    ends = parts.mapInPandas(_ends(), "path string, start long, stop long, turns boolean, outside long, inside long")
    earlier = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    known = ends.withColumn("text", F.coalesce(F.sum(F.col("turns").cast("int")).over(earlier), F.lit(0)) % 2 == 1)
    delta = F.when(F.col("text"), F.col("inside")).otherwise(F.col("outside"))
    known = known.withColumn("depth", F.coalesce(F.sum(delta).over(earlier), F.lit(0)))
    asked = known.select("path", "start", "stop", "text", "depth").repartition("path", "start")
    return asked.mapInPandas(_records(), "record string")
