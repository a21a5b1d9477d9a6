"""Document fingerprints by Order MinHash (DataFrame functions only).

The k-mers of a text are its runs of k words, told apart by how often they stood before: a k-mer's third occurrence is an item of
its own. A keyed hash puts all items in one order; turned to start at each of `slots` places in turn, it is one order a slot.
Of each order the first two items are taken, put back into the order they have in the text, and the hash of the pair fills the
slot. Two texts agree in a slot if they share those items and hold them in the same order, so a fingerprint is sensitive to what
edit distance counts: changed, repeated and moved words.

All is work on arrays of one row, in time n log n for n words, so a text is never exploded and nothing is shuffled for it. Arrays
hold single longs: a hash with its last bits, as many as the text needs, replaced by a place. Sorting such numbers is sorting by
hash and place.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardfoot.plans.shared import materialize, numbered

SPACES = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kmers(text: Column, k: int) -> Column:
    """A 64-bit hash of every `k` words in a row, by place; of all words if there are fewer; none of a text without words."""
    from_each = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + d) for d in range(1, k)]))
    all_of = lambda w: F.slice(from_each(w), F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
    return _let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t != "", _let(F.split(t, f"[{SPACES}]+"), all_of)).otherwise(F.array().cast("array<bigint>")))


def _mask(n: Column) -> Column:
    """All bits but those that places below `n` need."""
    return (-F.pow(F.lit(2), F.ceil(F.log2(n)))).cast("long")


def _packed(h: Column, i: Column, mask: Column) -> Column:
    """A hash with place `i` instead of its last bits."""
    return h.bitwiseAND(mask).bitwiseOR(i)


def _place(x: Column, mask: Column) -> Column:
    return x.bitwiseAND(F.bitwise_not(mask)).cast("int")


def ordered_items(hs: Column, mask: Column) -> Column:
    """The items of k-mers `hs` in their order: for each its place, behind the hash of its k-mer or, if `number` of its kind stood
    before it, of both.

    Sorted by hash and place, equal k-mers stand next to each other. Those that are not the first of their kind are few; the
    number of each is its distance from the first of them, found by looking 1, 2, 4, ... items back.
    """
    again = lambda xs, j, x: F.get(xs, j - 1) >= x.bitwiseAND(mask)

    def number(later: Column) -> Column:
        first = F.transform(later, lambda x, j: F.when(again(later, j, x), F.lit(0)).otherwise(j))
        steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.size(later))).cast("int")), lambda t: F.pow(F.lit(2), t).cast("int"))
        found = F.aggregate(steps, first, lambda f, d: F.transform(f, lambda x, j: F.greatest(x, F.get(f, j - d))))
        item = lambda i, number: _packed(F.xxhash64(F.get(hs, i), number), i.cast("long"), mask)
        return _let(found, lambda f: F.transform(later, lambda x, j: item(_place(x, mask), j - F.get(f, j) + 1)))

    def counted(xs: Column) -> Column:
        mixed = lambda later: F.sort_array(F.concat(F.array_except(xs, later), number(later)))
        return _let(F.filter(xs, lambda x, j: again(xs, j, x)), lambda later: F.when(F.size(later) == 0, xs).otherwise(mixed(later)))

    return _let(F.sort_array(F.transform(hs, lambda h, i: _packed(h, i.cast("long"), mask))), counted)


def signature(text: Column, k: int = 3, slots: int = 64) -> Column:
    """A text's `slots` (a power of two) hashes, as ints; an empty array for a text without words, null for null."""
    bits = 64 - (slots.bit_length() - 1)

    def fill(hs: Column, mask: Column, s: Column) -> Column:
        """Each slot starts at its part of the order; one whose part is empty starts where the next begins, round the end."""
        n = F.size(s)
        slot = lambda j: F.shiftright(F.get(s, j), bits).cast("int") + slots // 2
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda j: ~F.shiftright(F.get(s, j), bits).eqNullSafe(F.shiftright(F.get(s, j - 1), bits)))
        place = lambda j: _place(F.get(s, j % n), mask)
        pair = lambda a, b: F.shiftright(F.xxhash64(F.get(hs, F.least(a, b)), F.get(hs, F.greatest(a, b))), 32).cast("int")

        def spread(at: Column) -> Column:
            parts = F.transform(at, lambda j, t: F.array_repeat(pair(place(j), place(j + 1)), slot(j) - F.coalesce(slot(F.get(at, t - 1)), F.lit(-1))))
            return _let(F.flatten(parts), lambda out: F.concat(out, F.array_repeat(F.get(out, F.lit(0)), slots - F.size(out))))

        return _let(heads, spread)

    some = lambda hs: _let(_mask(F.size(hs)), lambda mask: _let(ordered_items(hs, mask), lambda s: fill(hs, mask, s)))
    return _let(kmers(text, k), lambda hs: F.when(F.size(hs) > 0, some(hs)).otherwise(F.array().cast("array<int>")))


def fingerprint(sign: Column) -> Column:
    """A signature as text: 8 hexadecimal digits a slot; the empty text for a text without words."""
    return F.array_join(F.transform(sign, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of slots in which two signatures agree. Two texts without words are alike; one without is like no other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(same / F.greatest(F.size(a), F.size(b)), F.lit(0.0)))


def _placed(docs: DataFrame) -> DataFrame:
    """`docs` with the file and the row there that each of its rows comes from. Other frames than of Parquet files are written."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"), "*")
    except AnalysisException:
        docs = materialize(docs, "rows")
        place = docs.metadataColumn("_metadata")
        return docs.select(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"), "*")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, slots: int = 64) -> DataFrame:
    """One row a document: id, its Order MinHash signature and fingerprint. Equal texts have equal fingerprints."""
    sign = signature(F.coalesce(F.col(text_col), F.lit("")), k, slots)
    return docs.select(F.col(id_col), sign.alias("signature")).withColumn("fingerprint", fingerprint(F.col("signature")))


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, slots: int = 64) -> DataFrame:
    """One row a document: id, text, n_chars, edited (its text with the last half, rounded down, replaced by as much from the start of
    the next document's, or all of it), their signatures, next_id and next_signature.

    Next is by descending id, after the last the first; alone, a document is next to itself. Rows of one id follow each other by a
    hash of their text, null ids come last. Null texts are empty. An empty table gives an empty one; other columns have no effect.

    Only ids and lengths are put in order. Then each document sends the document before it what that takes of its text, with
    its signature: texts are shuffled once whole and once by that part.
    """
    rows = _placed(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))).toDF("file", "row", "id", "text")
    order = numbered(rows.select("file", "row", "id", F.char_length("text").alias("n"), F.xxhash64("text").alias("h")), [F.desc_nulls_last("id"), "h", "n"], "place").drop("h", "id")
    order = materialize(order, "order")
    total = order.count()
    before = order.select(((F.col("place") + 1) % max(total, 1)).alias("place"), F.floor(F.col("n") / 2).cast("int").alias("wanted"), F.struct("file", "row").alias("to"))
    links = materialize(order.drop("n").join(before, "place").drop("place"), "links")

    key = ["file", "row"]
    # Both uses read the same columns, so that Spark signs and shuffles the documents once.
    signed = rows.withColumn("signature", signature(F.col("text"), k, slots)).repartition(*key)
    sent = signed.join(links, key).select(F.col("to.file").alias("file"), F.col("to.row").alias("row"), F.substr("text", F.lit(1), F.col("wanted")).alias("head"), F.col("id").alias("next_id"), F.col("signature").alias("next_signature"))
    both = signed.join(sent, key)
    n = F.char_length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("head"))
    out = both.select(F.col("id").alias(id_col), F.col("text").alias(text_col), n.cast("long").alias("n_chars"), edited.alias("edited"), "signature", "next_id", "next_signature")
    return out.withColumn("edited_signature", signature(F.col("edited"), k, slots))
