"""Encode texts to BPE ids and decode them, with tree concatenation for long texts.

A long text is cut into halves down to pieces, pieces are encoded by themselves, and neighbours are joined by encoding a
window around the cut again. The window grows until its first and last items are the very ones that the two sides had.
From there outwards nothing can differ: splitting into words looks at nothing before a word's start, and a sequence of
tokens is the encoding of its text if each pair of neighbours is. The same join runs inside a word of many symbols. Texts
of over `spread` characters become one row a piece, so that several tasks share one text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: The characters that the tokenizer's patterns call white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Below this code point no character combines, so such a text is in normal form C.
PLAIN_BELOW = 0x250
ID_BITS = 24
ID_MASK, NO_MERGE = (1 << ID_BITS) - 1, 1 << 62


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _class(kind: str) -> str:
    """A regex class body of all characters below PLAIN_BELOW whose category starts with `kind`."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c))[0] == kind)


class WordBpe:
    """BPE with word ends, from the text of a tokenizer file.

    `leaf`: symbols of a word up to which it is merged directly; `known`: words kept with their ids.
    """

    def __init__(self, spec: str, leaf: int = 64, known: int = 100_000) -> None:
        d = json.loads(spec)
        model = d["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.spec, self.leaf, self.known = spec, leaf, known
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        letters = _byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        self.merges: dict[tuple[int, int], int] = {}  # of a pair: its rank above ID_BITS, the new id below
        self.parts: dict[int, tuple[int, ...]] = {i: (i,) for i in (*self.inner, *self.last)}
        for rank, (a, b) in enumerate(model["merges"]):
            new = vocab[a + b]
            self.merges.setdefault((vocab[a], vocab[b]), rank << ID_BITS | new)
            self.parts.setdefault(new, self.parts[vocab[a]] + self.parts[vocab[b]])
        letter, number = _class("L"), _class("N")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{re.escape(SPACE)}{letter}{number}]+")
        self.plain = re.compile(f"[\x00-{chr(PLAIN_BELOW - 1)}]*")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self._library = None

    def normalized(self, text: str) -> str:
        """As the file's normaliser has it, but for runs of white space, which no token holds."""
        if self.plain.fullmatch(text):
            return text.lower()
        return self._tokenizer().normalizer.normalize_str(text)

    def _tokenizer(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
        return self._library

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each word of a normalised text."""
        if self.plain.fullmatch(text):
            return [m.span() for m in self.words.finditer(text)]
        return [at for _, at in self._tokenizer().pre_tokenizer.pre_tokenize_str(text)]

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge the lowest-ranked pair, the leftmost of equals, until none is left."""
        ids, get = list(ids), self.merges.get
        ranks = [get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best & ID_MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NO_MERGE)
        return ids

    def _encode_symbols(self, ids: list[int]) -> list[int]:
        if len(ids) <= self.leaf:
            return self._merge(ids)
        half = len(ids) // 2
        return self._join_tokens(self._encode_symbols(ids[:half]), self._encode_symbols(ids[half:]))

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        w = 1
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            window = self._merge([s for t in (*left[-a:], *right[:b]) for s in self.parts[t]])
            left_ok = a == len(left) or window[0] == left[-a]
            right_ok = b == len(right) or window[-1] == right[b - 1]
            if left_ok and right_ok and (len(window) > 1 or a == len(left) or b == len(right)):
                return left[:-a] + window + right[b:]
            w *= 2

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of normalised text."""
        found = self.cache.get(word)
        if found is None:
            raw = word.encode("utf-8")
            inner = self.inner
            found = tuple(self._encode_symbols([*[inner[b] for b in raw[:-1]], self.last[raw[-1]]]))
            if len(self.cache) < self.known and len(word) <= 64:
                self.cache[word] = found
        return found

    def piece(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
        """Word spans and their ids of a normalised text."""
        at = self.spans(text)
        return at, [self.word(text[s:e]) for s, e in at]

    def join(self, left: tuple, right: tuple, text: str, cut: int) -> tuple:
        """Pieces (spans, ids) before and after `cut` of `text`, spans counted from the start of `text`."""
        (ls, li), (rs, ri) = left, right
        w = 1
        while True:
            a, b = min(w, len(ls)), min(w, len(rs))
            start = ls[-a][0] if a else cut
            stop = rs[b - 1][1] if b else cut
            spans, ids = self.piece(text[start:stop])
            spans = [(s + start, e + start) for s, e in spans]
            left_ok = a == len(ls) or (spans[0] == ls[-a] and ids[0] == li[-a])
            right_ok = b == len(rs) or (spans[-1] == rs[b - 1] and ids[-1] == ri[b - 1])
            if left_ok and right_ok and (len(spans) > 1 or a == len(ls) or b == len(rs)):
                return ls[: len(ls) - a] + spans + rs[b:], li[: len(li) - a] + ids + ri[b:]
            w *= 2

    def tree(self, text: str, size: int, start: int = 0, stop: int | None = None) -> tuple:
        """Spans and ids of a normalised text, by halves down to `size` characters."""
        stop = len(text) if stop is None else stop
        if stop - start <= size:
            spans, ids = self.piece(text[start:stop])
            return [(s + start, e + start) for s, e in spans], ids
        cut = (start + stop) // 2
        return self.join(self.tree(text, size, start, cut), self.tree(text, size, cut, stop), text, cut)

    def encode(self, text: str, size: int) -> list[int]:
        """Ids of a raw text; the file's special tokens count as such where they stand in it."""
        out: list[int] = []
        for i, part in enumerate(self.cut.split(text) if self.cut and "<" in text else [text]):
            if i % 2:
                out.append(self.special[part])
                continue
            part = self.normalized(part)
            if len(part) > size:
                out += chain.from_iterable(self.tree(part, size)[1])
            elif self.plain.fullmatch(part):
                cache = self.cache
                out += chain.from_iterable([cache.get(w) or self.word(w) for w in self.words.findall(part)])
            else:
                out += chain.from_iterable(self.piece(part)[1])
        return out

    def decode(self, ids) -> str:
        """The tokens' names with a space between, as the file names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids])


_loaded: dict[int, WordBpe] = {}


def _bpe(spec) -> WordBpe:
    """One vocabulary a worker process."""
    key = hash(spec.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec.value)
    return _loaded[key]


def _rows(batches: Iterator[pa.RecordBatch], text: str, chars: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts pass `chars` characters."""
    for batch in batches:
        sizes = np.cumsum(np.diff(np.frombuffer(batch.column(text).cast(pa.large_string()).buffers()[1], np.int64)[batch.column(text).offset :][: batch.num_rows + 1]))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _encoded(batch: pa.RecordBatch, ids: list[list[int]], bpe: WordBpe) -> pa.RecordBatch:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    values = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), lists, pa.array([bpe.decode(x) for x in ids], pa.string())], ["id", "n", "ids", "decoded"])


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", piece: int = 16_384, spread: int = 1 << 20) -> DataFrame:
    """(id_col, ids array<int>, decoded string): each text's BPE ids, and the text that these ids decode to.

    `vocabulary` is the path of a tokenizer file on the driver; its text (a few MB, whatever the input) is broadcast.
    Texts over `piece` characters go through the tree; those over `spread` are encoded by several tasks. Null texts count
    as empty: no ids, and an empty decoding. Repeated rows come out as often as they go in; other columns are not looked at.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(spec)
        for batch in _rows(batches, "text"):
            yield _encoded(batch, [bpe.encode(t, piece) for t in batch.column("text").to_pylist()], bpe)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, key, n, part, special, no, text): pieces of normalised text between special tokens."""
        bpe = _bpe(spec)
        for batch in batches:
            for doc, key, n, text in zip(*[c.to_pylist() for c in batch.columns]):
                out = []
                for i, part in enumerate(bpe.cut.split(text) if bpe.cut else [text]):
                    part = part if i % 2 else bpe.normalized(part)
                    count = 1 if i % 2 else max(1, -(-len(part) // piece))
                    out += [(doc, key, n, i, bool(i % 2), k, part[len(part) * k // count : len(part) * (k + 1) // count]) for k in range(count)]
                for s in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[s : s + 64]), cut_types)], cut_names)

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(spec)
        for batch in batches:
            starts, stops, counts, ids = [], [], [], []
            for special, text in zip(batch.column("special").to_pylist(), batch.column("text").to_pylist()):
                at, found = ([(0, len(text))], [(bpe.special[text],)]) if special else bpe.piece(text)
                starts.append([s for s, _ in at])
                stops.append([e for _, e in at])
                counts.append([len(x) for x in found])
                ids.append(list(chain.from_iterable(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.list_(pa.int32())) for c in (starts, stops, counts, ids)]], [*cut_names, "starts", "stops", "counts", "ids"])

    def concatenate(table: pa.Table) -> pa.Table:
        bpe = _bpe(spec)
        parts: dict[int, list] = {}
        for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["no"])):
            at, bounds = list(zip(r["starts"], r["stops"])), np.cumsum([0, *r["counts"]])
            parts.setdefault(r["part"], []).append((r["text"], at, [tuple(r["ids"][a:b]) for a, b in zip(bounds, bounds[1:])]))

        def joined(items: list) -> tuple:
            if len(items) == 1:
                return items[0]
            half = len(items) // 2
            (lt, ls, li), (rt, rs, ri) = joined(items[:half]), joined(items[half:])
            shifted = [(s + len(lt), e + len(lt)) for s, e in rs]
            return lt + rt, *bpe.join((ls, li), (shifted, ri), lt + rt, len(lt))

        ids = list(chain.from_iterable(chain.from_iterable(joined(parts[p])[2] for p in sorted(parts))))
        return pa.Table.from_batches([_encoded(pa.RecordBatch.from_arrays([table.column(c).combine_chunks().slice(0, 1) for c in ("id", "n")], ["id", "n"]), [ids], bpe)])

    cut_names = ["id", "key", "n", "part", "special", "no", "text"]
    arrow_id = to_arrow_type(rows.schema["id"].dataType)
    cut_types = [arrow_id, pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]
    schema = f"id {id_type}, n bigint, ids array<int>, decoded string"
    short = rows.where(F.length("text") <= spread).select("id", F.lit(1).cast("long").alias("n"), "text").mapInArrow(whole, schema)
    long = rows.where(F.length("text") > spread).groupBy("id", "text").agg(F.count("*").alias("n"))
    long = long.select("id", F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull().cast("string"), F.sha2("text", 256)).alias("key"), "n", "text")
    pieces = long.mapInArrow(cut, f"id {id_type}, key string, n bigint, part int, special boolean, no int, text string")
    pieces = pieces.repartition("key", "part", "no").mapInArrow(encode_pieces, f"id {id_type}, key string, n bigint, part int, special boolean, no int, text string, starts array<int>, stops array<int>, counts array<int>, ids array<int>")
    long = pieces.groupBy("key").applyInArrow(concatenate, schema).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("copy")
    return short.unionByName(long).select(F.col("id").alias(id_col), "ids", "decoded")
