"""Periodic runs of words: stretches that repeat themselves at least four times.

Word i matches word i - q on the diagonal of lag q; a run of period q is a stretch of matches on that diagonal, q words longer.
The dynamic programme goes through a text from left to right and keeps the active lags only. It is sparse: a run that lasts four
periods matches on at least 3q words in a row, so a lag between 2**t and 2**(t + 1) needs a start only at every (2**t)-th word,
from that word's earlier occurrences in a window of 2**t words. At most n starts a scale are looked at, whatever the text, and those
whose next words differ are dropped at once for all texts of a batch together. A diagonal that goes on is followed to where
it ends, which gives its length, and the run leaves there and then.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once (one text at least).
LOT = 4_000_000
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Starts that are looked at together, and words that are compared first when a diagonal is followed.
_PAIRS, _CHUNK = 2_000_000, 64

Edit = Callable[[object, np.ndarray], np.ndarray]


def _starts(words: np.ndarray, key: np.ndarray, order: np.ndarray, ends: np.ndarray, t: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of matches from which diagonals of lags 2**t to 2**(t + 1) - 1 start, in order of place, some at a time.

    `words` of several texts one after another; `order`: all places by word and place, `key`: the same as one number; `ends`: for
    each place the end of its text.
    """
    step, n = 1 << t, len(words)
    at = np.arange(0, n, step)
    mine = words[at] * (n + 1)
    # A place's earlier occurrences in its window stand next to each other.
    lo = np.searchsorted(key, mine + np.maximum(at - 2 * step + 1, 0))
    hi = np.searchsorted(key, mine + np.maximum(at - step + 1, 0))
    count = hi - lo
    total = np.concatenate(([0], np.cumsum(count)))
    a = 0
    while a < len(at):
        z = max(a + 1, int(np.searchsorted(total, total[a] + _PAIRS, side="right")) - 1)
        place = np.repeat(at[a:z], count[a:z])
        earlier = order[np.repeat(lo[a:z] - total[a:z], count[a:z]) + total[a] + np.arange(len(place))]
        ok = ends[earlier] == ends[place]
        place, earlier = place[ok], earlier[ok]
        # Behind the first start in a run of lag q come (repeats - 1) * q - step matches at least.
        ahead = 1
        while ahead <= (repeats - 2) * step and len(place):
            ok = place + ahead < ends[place]
            place, earlier = place[ok], earlier[ok]
            ok = words[place + ahead] == words[earlier + ahead]
            place, earlier = place[ok], earlier[ok]
            ahead += max(1, ahead // 2)
        yield place, place - earlier
        a = z


def _follow(words: np.ndarray, place: int, lag: int, begin: int, end: int) -> tuple[int, int]:
    """The stretch of matches at `lag` around `place`: its first place and the place behind its last."""
    stop, size = place, _CHUNK
    while stop < end:
        m = min(size, end - stop)
        off = np.flatnonzero(words[stop : stop + m] != words[stop - lag : stop - lag + m])
        if len(off):
            stop += int(off[0])
            break
        stop, size = stop + m, 2 * size
    start, size = place, _CHUNK
    while start > begin + lag:
        m = min(size, start - begin - lag)
        off = np.flatnonzero(words[start - m : start] != words[start - m - lag : start - lag])
        if len(off):
            start -= m - 1 - int(off[-1])
            break
        start, size = start - m, 2 * size
    return start, stop


def find_runs(words: np.ndarray, offsets: np.ndarray, repeats: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """For each text the runs (start, length, period), by start and period.

    `words`: the texts' words as numbers, equal for equal words, one text after another; `offsets`: where each begins, with the
    end added. A run is as long as it can be, its period the smallest, its length at least `least` and `repeats` (2 or more)
    periods.
    """
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends, n = offsets[1:][text], len(words)
    order = np.argsort(words, kind="stable")
    key = words[order] * (n + 1) + order
    found: list[dict[tuple[int, int], int]] = [{} for _ in sizes]
    # The run that covers a place: its first place, its end and its period (0: none); of several the one found last.
    cover = np.zeros((3, n), np.int64)
    t = 0
    while n and (1 << t) * repeats <= sizes.max():
        here, active = -1, {}  # of one text the active lags, each with the place behind its last match
        for place, lag in _starts(words, key, order, ends, t, repeats):
            start, stop, period = cover[:, place]
            # Inside a run whose period divides the lag, the lag gives the same run again.
            new = (period == 0) | (lag % np.maximum(period, 1) > 0) | (place - lag < start) | (place >= stop)
            for k, i, q in zip(text[place[new]].tolist(), place[new].tolist(), lag[new].tolist()):
                if k != here:
                    here, active = k, {}
                if active.get(q, -1) > i:
                    continue
                first, behind = _follow(words, i, q, int(offsets[k]), int(offsets[k + 1]))
                active[q] = behind
                length = behind - first + q
                if length >= max(least, repeats * q) and found[k].get((first - q, length), q) >= q:
                    found[k][first - q, length] = q
                    cover[:, first - q : behind] = np.array([[first - q], [behind], [q]])
        t += 1
    return [sorted((a - int(offsets[k]), n, q) for (a, n), q in runs.items()) for k, runs in enumerate(found)]


def _lots(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Rows in lots of about `size` bytes."""
    at = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(at, (at[first - 1] if first else 0) + size, side="right")))
        yield first, stop
        first = stop


def _work(rows: pa.RecordBatch, edit: Edit | None, repeats: int, least: int) -> pa.RecordBatch:
    """The result of some rows (id, text)."""
    split = pc.ascii_split_whitespace(pc.fill_null(rows.column(1).cast(pa.large_string()), ""))
    flat, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    flat, of = flat.filter(pa.array(real)), of[real]
    offsets = np.searchsorted(of, np.arange(rows.num_rows + 1))
    place = np.arange(len(of))
    if edit is not None:
        for k, i in enumerate(rows.column(0).to_pylist()):
            a, z = offsets[k], offsets[k + 1]
            place[a:z] = a + edit(i, np.arange(z - a))
    words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[place]
    runs = find_runs(words, offsets, repeats, least)
    keep = np.ones(len(words), bool)
    for k, some in enumerate(runs):
        for start, length, period in some:
            keep[offsets[k] + start + period : offsets[k] + start + length] = False
    at = pa.array(np.concatenate(([0], np.cumsum(keep)))[offsets], pa.int32())
    kept = pc.binary_join(pa.ListArray.from_arrays(at, flat.take(pa.array(place[keep]))), pa.scalar(" ", pa.large_string()))
    listed = np.array([r for some in runs for r in some], np.int64).reshape(-1, 3)
    parts = pa.StructArray.from_arrays([pa.array(c) for c in listed.T], ["start", "length", "period"])
    nested = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), parts)
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), nested, kept.cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None, repeats: int = 4, least: int = 6) -> DataFrame:
    """One row a document: id, n_words, runs (start, length, period; by start, then period) and collapsed, the text with each run
    cut to its first period and words joined by one space.

    Words are runs of what is not space or 0x09-0x0D; null and empty texts have none and no runs, and collapse to an empty text.
    `edit` takes a row's id (null too) and the places of its words, and gives the places whose words are read instead.
    Documents stand for themselves, so equal texts, repeated and null ids and other columns have no effect. The work on a text
    grows with its length times the logarithm; a text is held by one task. An empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop in _lots(b.column(1), LOT):
                yield _work(b.slice(first, stop - first), edit, repeats, least)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)


def planted_period(doc_id, places: np.ndarray) -> np.ndarray:
    """The edit of every tenth document (by the CRC-32 of its id in decimal): from a word on, its words repeat those from there.
    A null id is not edited."""
    n = len(places)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(places >= a, a + (places - a) % p, places)


def digest_runs(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the run that repeats most often, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda m, r: F.when(m.isNull() | (r["length"].cast("decimal(20,0)") * m["period"] > m["length"].cast("decimal(20,0)") * r["period"]), r).otherwise(m))
    told = df.withColumn("best", best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return told.select(id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

