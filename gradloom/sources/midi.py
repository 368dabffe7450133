"""Note lists to event tokens and back, in the usual 388-event vocabulary.

Events: 128 note-on, 128 note-off, 100 time shifts of 10 ms, 32 velocities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ON, OFF, SHIFT, VELOCITY, SIZE = 0, 128, 256, 356, 388
NOTE = "struct<pitch:int,velocity:int,start:double,end:double>"


def encode_notes(notes) -> list[int]:
    """Events of (pitch, velocity, start, end) notes in order of time; offs before ons, then by pitch."""
    events = []
    for pitch, velocity, start, end in notes:
        events += [(round(start * 100), 1, pitch, velocity), (round(end * 100), 0, pitch, velocity)]
    out, now, loud = [], 0, None
    for at, on, pitch, velocity in sorted(events):
        wait = at - now
        while wait > 0:
            step = min(wait, 100)
            out.append(SHIFT + step - 1)
            wait -= step
        now = max(now, at)
        if on:
            if velocity // 4 != loud:
                loud = velocity // 4
                out.append(VELOCITY + loud)
            out.append(ON + pitch)
        else:
            out.append(OFF + pitch)
    return out


def decode_events(events) -> list[tuple[int, int, float, float]]:
    """Notes of an event list; an off without an on is skipped, a note that never ends is left out."""
    now, loud, on, out = 0, 0, {}, []
    for e in events:
        if e >= VELOCITY:
            loud = (e - VELOCITY) * 4
        elif e >= SHIFT:
            now += e - SHIFT + 1
        elif e >= OFF:
            if starts := on.get(e - OFF):
                start, velocity = starts.pop(0)
                out.append((e - OFF, velocity, start / 100, now / 100))
        else:
            on.setdefault(e, []).append((now, loud))
    return sorted(out, key=lambda n: (n[2], n[0], n[3]))


def encode_column(df: DataFrame, notes: str = "notes", out: str = "tokens") -> DataFrame:
    """``df`` with the events of an array of notes."""

    @F.pandas_udf("array<int>")
    def run(rows):
        return rows.map(lambda r: None if r is None else encode_notes([(n["pitch"], n["velocity"], n["start"], n["end"]) for n in r]))

    return df.withColumn(out, run(F.col(notes)))


def decode_column(df: DataFrame, tokens: str = "tokens", out: str = "notes") -> DataFrame:
    @F.pandas_udf(f"array<{NOTE}>")
    def run(rows):
        import pandas as pd

        return pd.Series([None if r is None else [dict(zip(("pitch", "velocity", "start", "end"), n)) for n in decode_events(r)] for r in rows])

    return df.withColumn(out, run(F.col(tokens)))
