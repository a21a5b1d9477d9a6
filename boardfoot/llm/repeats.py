"""Remove every byte that a long repeated string covers, by a run-length index of Burrows-Wheeler type.

Equal strings of `span` bytes have the same anchor: the `gram`-byte string in them with the smallest hash. Anchors that
occur once in the corpus end there. Around the others, the windows of one anchor make up a context, and contexts are
aligned at their anchors and dealt by anchor. Equal contexts are one context with a count. Of the different contexts of
an anchor a positional Burrows-Wheeler transform is built, column by column: in each column it sorts the contexts by what
stands before, keeps the runs of equal bytes and samples, at run ends, where the match with the neighbour began; inside a
run that does not change. From those samples the matching statistics of all contexts are streamed, and windows with a match
of `span` bytes are marked. An anchor with more contexts than a task should hold is settled window by window.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardfoot.llm.text_arrays import U64, Texts, mix, powers, texts
from boardfoot.plans.shared import materialize

POSITION_BITS = 24
POSITION = U64((1 << POSITION_BITS) - 1)


def anchors(lot: Texts, span: int, gram: int, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, content, row, lo, extra): runs of windows of `span` bytes with one anchor, from the bytes of a lot of texts.

    A window's anchor is its `gram`-byte string of the smallest hash, the leftmost of equals, so equal windows have equal
    anchors at the same place. A run's windows start at lo, lo + 1, ..., lo + extra in their row; content is a hash of all its bytes.
    """
    ends = lot.at[1:]
    for b in range(0, len(lot.data) - span + 1, block):
        data = lot.data[b : b + block + span - 1]
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
        n = len(data) - gram + 1
        h = mix((total[gram:] - total[:n]) * down[:n])
        key = (h & ~POSITION) | np.arange(n, dtype=U64)
        wide, width = key, 1
        reach = span - gram + 1
        while 2 * width <= reach:
            wide = np.minimum(wide[:-width], wide[width:])
            width *= 2
        rest = reach - width
        least = np.minimum(wide[: len(wide) - rest], wide[rest:]) if rest else wide
        at = (least & POSITION).astype(np.int64)
        starts = np.arange(b, b + len(at))
        row = np.searchsorted(lot.at, starts, side="right") - 1
        good = starts + span <= ends[row]
        starts, row, at = starts[good], row[good], at[good]
        if not len(starts):
            continue
        head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
        tail = np.concatenate([head[1:], [len(at)]]) - 1
        lo, hi = starts[head] - b, starts[tail] - b + span
        content = mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(U64) * U64(0xD6E8FEB86659FD93) + (at[head] - lo).astype(U64))
        yield h[at[head]], content, row[head], starts[head] - lot.at[row[head]], tail - head


def repeated_windows(symbols: np.ndarray, group: np.ndarray, span: int) -> np.ndarray:
    """(columns, contexts) booleans: whether the `span` symbols that end at a column occur in another context of the group too.

    `symbols` has a column of all contexts in each row, 0 where a context has none; `group` ascends.
    """
    columns, n = symbols.shape
    out = np.zeros((columns, n), bool)
    order, other = np.arange(n), np.int32(1 << 30)
    since = np.zeros(n + 1, np.int32)  # column at which the match with the neighbour before began; other: no match
    since[:-1][np.concatenate([[True], group[1:] != group[:-1]])] = other
    since[-1] = other
    high = group.astype(np.int64) << 10
    for c in range(columns):
        s = symbols[c][order]
        key = high + s
        perm = np.argsort(key, kind="stable")
        order, s, key = order[perm], s[perm], key[perm]
        new = np.full(n + 1, c + 1, np.int32)
        same = np.flatnonzero((key[1:] == key[:-1]) & (s[1:] > 0)) + 1
        first, last = perm[same - 1] + 1, perm[same]
        inner = first == last  # both were neighbours: inside a run of the transform
        new[same[inner]] = since[last[inner]]
        ends = same[~inner]
        if len(ends):
            new[ends] = np.maximum.reduceat(since, np.column_stack([first[~inner], last[~inner] + 1]).ravel())[::2]
        new[:-1][np.concatenate([[True], high[1:] != high[:-1]])] = other
        new[-1] = other
        since = new
        length = c + 1 - since
        out[c, order] = np.maximum(length[:-1], length[1:]) >= span
    return out


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of True in the rows of a matrix."""
    rows, width = marks.shape
    flat = np.zeros((rows, width + 1), np.int8)
    flat[:, 1:] = marks
    step = np.diff(np.concatenate([flat.ravel(), [0]]))
    start, stop = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1)
    return start // (width + 1), start % (width + 1) - 1, stop % (width + 1) - 1


def _index_bucket(table: pa.Table, span: int, gram: int) -> pa.Table:
    """(key, start, stop): bytes that windows of once-only contexts cover which other contexts of their anchor have too."""
    table = table.sort_by([("m", "ascending"), ("x", "ascending")]).combine_chunks()
    n, reach = table.num_rows, span - gram
    m, off, lo = (table.column(c).to_numpy() for c in ("m", "off", "lo"))
    content = table.column("content").combine_chunks()
    size = np.array([len(b) for b in content.to_pylist()]) if n else np.zeros(0, int)
    data = np.frombuffer(b"".join(content.to_pylist()), np.uint8)
    begin = reach - off  # column of a context's first byte; anchors stand in one column
    symbols = np.zeros((reach + span, n), np.uint16)
    ctx = np.repeat(np.arange(n), size)
    col = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) + begin[ctx]
    symbols[col, ctx] = data.astype(np.uint16) + 1
    group = np.cumsum(np.concatenate([[0], m[1:] != m[:-1]]))
    marks = repeated_windows(symbols, group, span)
    marks[:, table.column("n").to_numpy() > 1] = False
    row, first, last = _runs(np.ascontiguousarray(marks.T))
    start = lo[row] + first - span + 1 - begin[row]
    return pa.table({"key": table.column("key").take(pa.array(row)), "start": start, "stop": lo[row] + last + 1 - begin[row]})


def _window_hashes(data: bytes, span: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, U64)
    np.cumsum((b.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    n = len(b) - span + 1
    return mix((total[span:] - total[:n]) * down[:n])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, gram: int = 16, most: int = 20_000) -> DataFrame:
    """One row a document: id, n_bytes, spans array<struct<start,stop>> (maximal removed runs, in order) and kept (binary).

    A byte is removed if it lies in a string of `span` bytes of the document's UTF-8 text that also starts at another place
    of the corpus, overlaps and the same document included; all is judged on the input. Null and shorter texts lose
    nothing, null counts as empty. Repeated rows are documents of their own, so each repeats the other. Other columns are
    not looked at. A task holds at most `most` contexts of one anchor; beyond that their windows are counted by hash.
    Rows are told apart by a 64-bit hash of id and text.
    """
    import zstandard

    spark = docs.sparkSession
    reach = span - gram
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy()
            for lot in texts(b.column("text")):
                for m, x, row, lo, extra in anchors(lot, span, gram):
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(x.view(np.int64)), pa.array(keys[lot.first + row]), pa.array((lo << 8) | extra)], ["m", "x", "key", "at"])

    found = rows.select("key", "text").mapInArrow(occurrences, "m long, x long, key long, at long")
    # Written first, so that the join below has a shuffle on either side and Spark can split a common anchor.
    often = materialize(found.groupBy("m").agg(F.count("*").alias("total")).where("total > 1").select("m"), "common-anchors")
    shared = materialize(found.join(often, "m"), "anchors")
    contexts = shared.groupBy("m", "x").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min_by("at", "key").alias("at"))
    contexts = materialize(contexts, "contexts")
    kinds = contexts.groupBy("m").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = materialize(contexts.join(kinds, "m"), "mixed-contexts")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_mixed = mixed.count()
    hold = max(1000, min(most, n_mixed // partitions))
    buckets = max(1, n_mixed // 2000)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names[:-1]], pa.array([z.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], [*b.schema.names[:-1], "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The contexts' bytes; off is the anchor's place in them."""
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for r in range(b.num_rows):
                data = z.decompress(b.column("packed")[r].as_py())
                items = b.column("items")[r].as_py()
                content, off = [], []
                for i in items:
                    lo, extra = i["at"] >> 8, i["at"] & 255
                    text = data[lo : lo + extra + span]
                    content.append(text)
                    off.append(_anchor_place(text, gram, reach))
                columns = [[i[c] for i in items] for c in ("m", "x", "n", "kinds")]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], b.column("key").slice(r, 1).take(pa.array([0] * len(items))), pa.array([i["at"] >> 8 for i in items], pa.int64()), pa.array(off, pa.int64()), pa.array(content, pa.binary())], ["m", "x", "n", "kinds", "key", "lo", "off", "content"])

    lists = mixed.groupBy("key").agg(F.collect_list(F.struct("m", "x", "n", "kinds", "at")).alias("items"))
    text_of = rows.where(F.octet_length("text") >= span).select("key", "text").mapInArrow(packed, "key long, packed binary")
    bytes_of = text_of.join(lists, "key").mapInArrow(cut, "m long, x long, n long, kinds long, key long, lo long, off long, content binary")
    bytes_of = materialize(bytes_of, "context-bytes")
    few = bytes_of.where(F.col("kinds") <= hold).withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets)))
    marks = few.groupBy("bucket").applyInArrow(lambda t: _index_bucket(t, span, gram), "key long, start long, stop long")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                h = _window_hashes(b.column("content")[r].as_py(), span)
                take = pa.array(np.zeros(len(h), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[b.column(c).slice(r, 1).take(take) for c in ("n", "key")], pa.array(np.arange(len(h)) + b.column("lo")[r].as_py())], ["h", "n", "key", "start"])

    many = bytes_of.where(F.col("kinds") > hold)
    if not many.isEmpty():
        each = many.mapInArrow(windows, "h long, n long, key long, start long")
        again = each.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h")
        marks = marks.unionByName(each.where("n = 1").join(again, "h").select("key", "start", (F.col("start") + span).alias("stop")))
    copies = shared.join(contexts.where("n > 1").select("m", "x"), ["m", "x"])
    lo = F.shiftright("at", 8)
    marks = marks.unionByName(copies.select("key", lo.alias("start"), (lo + F.col("at").bitwiseAND(255) + span).alias("stop")))
    marks = materialize(marks, "marks").groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            sizes, spans, kept = [], [], []
            for r in range(b.num_rows):
                data = z.decompress(b.column("packed")[r].as_py())
                got = b.column("marks")[r].as_py() or []
                gone, last = [], None
                for s, e in sorted((i["start"], i["stop"]) for i in got):
                    if last is not None and s <= last["stop"]:
                        last["stop"] = max(last["stop"], e)
                    else:
                        last = {"start": s, "stop": e}
                        gone.append(last)
                edges = [0, *[x for g in gone for x in (g["start"], g["stop"])], len(data)]
                sizes.append(len(data))
                spans.append(gone)
                kept.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    all_text = rows.select("id", "key", "text").mapInArrow(packed, f"id {id_type}, key long, packed binary")
    out = all_text.join(marks, "key", "left").select("id", "packed", "marks").mapInArrow(finish, f"id {id_type}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def _anchor_place(text: bytes, gram: int, reach: int) -> int:
    """Where a context's anchor stands: in every window of it, so in the part that all windows share; the smallest hash there."""
    b = np.frombuffer(text, np.uint8)
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, U64)
    np.cumsum((b.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    n = len(b) - gram + 1
    h = mix((total[gram:] - total[:n]) * down[:n]) & ~POSITION
    first, last = n - 1 - reach, reach  # the last window starts at `first`; the first window's last gram starts at `last`
    return first + int(h[first : last + 1].argmin())
