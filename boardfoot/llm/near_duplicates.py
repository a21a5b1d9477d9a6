"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles, and has a signature of minwise values. A tree starts with all documents in one
node and branches a node by some randomly chosen coordinates of the signature: documents with the same value there go to
one child. A pair of similarity `s` shares a child with a chance that grows with `s`, while unlike documents part at once.
Which coordinates a node takes depends on its path alone, so the first levels of all trees are worked out in the scan.
Of nodes with the same members one is kept. Small nodes are compared exhaustively, once: likely pairs that a node's
forest does not need wait until it is known whether they still are apart. Members of a large node are first compared with
the member that is nearest to what most of the node have in common; then large nodes are branched further, of which those
that do not hang together are kept, and what is left of them at the last level is compared exhaustively on full sets, block
by block. Trees are independent and repeated to reach the target recall. Likely pairs are confirmed on the full sets.
Documents with equal sets are one class from the start, so exact copies, however many, add nothing to any node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardfoot.llm.components import components
from boardfoot.llm.text_arrays import NOT_SPACE, U64, mix, shingles, texts
from boardfoot.plans.shared import broadcast_if_small, materialize, small_batches

WIDTH = 64
_random = np.random.default_rng(17)
_ODD = _random.integers(0, 1 << 31, WIDTH, np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _random.integers(0, (1 << 32) - 1, WIDTH, np.uint32)
_COORDINATE = _random.integers(0, 1 << 63, WIDTH, U64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's set of hashed `k`-word shingles, sorted; fewer words are one shingle, none are no set."""
    for lot in texts(column):
        lot = lot.lowered()
        starts, ends, rows = lot.words(NOT_SPACE)
        words = lot.hashes(starts, ends)
        n = np.bincount(rows, minlength=lot.rows)
        h, owner = shingles(words, rows, k)
        cut, first = np.searchsorted(owner, np.arange(lot.rows + 1)), np.cumsum(n) - n
        for r in range(lot.rows):
            if 0 < n[r] < k:
                one = np.full(1, n[r], U64)
                for w in words[first[r] : first[r] + n[r]]:
                    one = mix(one * U64(0xD1342543DE82EF95) + w)
                yield one
            else:
                yield np.unique(h[cut[r] : cut[r + 1]])


def _sums(items: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums of hashes over a set; with its size they stand for the set."""
    return items.sum(dtype=U64), mix(items ^ U64(0x2545F4914F6CDD1D)).sum(dtype=U64)


def signature(items: np.ndarray) -> np.ndarray:
    """The smallest of each of WIDTH hashes over the set."""
    low = (items & U64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(low), 1024):
        np.minimum(out, ((low[s : s + 1024, None] ^ _XOR) * _ODD).min(axis=0), out=out)
    return out


def children(owner: np.ndarray, node: np.ndarray, values: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Owner and child of each branch: a node takes each coordinate with the chance `rate`, but one at least."""
    at, out = [owner[:0]], [node[:0]]
    for s in range(0, len(node), 4096):
        who, path = owner[s : s + 4096], node[s : s + 4096]
        draw = mix(path[:, None] ^ _COORDINATE)
        take = draw < U64(int(rate * float(1 << 63)) * 2)
        take[np.arange(len(path)), draw.argmin(axis=1)] = True
        p, i = np.nonzero(take)
        at.append(who[p])
        out.append(mix(path[p] * U64(0xD1342543DE82EF95) + _COORDINATE[i] + values[who[p], i].astype(U64)))
    return np.concatenate(at), np.concatenate(out)


def _sketch(rows: DataFrame, k: int, trees: int, depth: int, rate: float) -> DataFrame:
    """(id, n, h1, h2, bits, nodes): size and two sums of hashes identify a set; bits are 8 of each minwise value; nodes are
    the set's paths after `depth` levels."""
    roots = mix(np.arange(1, trees + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, values = [], [], [], []
            for s in shingle_sets(b.column("text"), k):
                n.append(len(s))
                sums = _sums(s)
                h1.append(sums[0])
                h2.append(sums[1])
                values.append(signature(s))
            values = np.array(values, np.uint32).reshape(-1, WIDTH)
            some = np.flatnonzero(np.array(n) > 0)
            owner, node = np.repeat(some, trees), np.tile(roots, len(some))
            for _ in range(depth):
                owner, node = children(owner, node, values, rate)
            order = np.argsort(owner, kind="stable")
            at = np.searchsorted(owner[order], np.arange(len(n) + 1))
            nodes = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(node[order].view(np.int64)))
            bits = [(v >> 8).astype(np.uint8).tobytes() for v in values]
            h1, h2 = (pa.array(np.array(h, U64).view(np.int64)) for h in (h1, h2))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), h1, h2, pa.array(bits, pa.binary()), nodes], ["id", "n", "h1", "h2", "bits", "nodes"])

    return rows.mapInArrow(sketch, "id long, n long, h1 long, h2 long, bits binary, nodes array<long>")


PAIRS = "a long, b long"


def _as_pairs(left: list, right: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right), pa.int64()), pa.array(np.maximum(left, right), pa.int64())], ["a", "b"])


def _rows_of(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint8).reshape(-1, WIDTH)


def _least(threshold: float) -> float:
    """The share of signature values below which a pair is not looked at further: four standard deviations under `threshold`."""
    return threshold - 4 * (threshold * (1 - threshold) / WIDTH) ** 0.5


def _node_pairs(least: float):
    """Pairs of a node's members in different parts whose signatures agree in a share of `least`; `first` are those of a
    forest of the likest."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right, first = [], [], []
            for ids, parts, sig in zip(b.column("ids").to_pylist(), b.column("parts").to_pylist(), b.column("bits").to_pylist()):
                m, parts = _rows_of(sig), np.array(parts)
                same = (m[:, None, :] == m[None, :, :]).sum(axis=2)
                i, j = np.nonzero(np.triu(same >= least * WIDTH, 1) & (parts[:, None] != parts))
                root = list(range(len(ids)))
                for p in np.argsort(-same[i, j], kind="stable"):
                    low, high = sorted((root[i[p]], root[j[p]]))
                    left.append(ids[i[p]])
                    right.append(ids[j[p]])
                    first.append(low != high)
                    if low != high:
                        root = [low if r == high else r for r in root]
            found = _as_pairs(np.array(left, np.int64), np.array(right, np.int64))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(first, pa.bool_())], ["a", "b", "first"])

    return pairs


def _counted(members: DataFrame) -> DataFrame:
    """`members` (node, c, part, ...) with k, of nodes with two parts or more. Of several nodes with the same members one is kept."""
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "c")).alias(f"x{i}") for i in (1, 2)]
    counts = members.groupBy("node").agg(F.count("*").alias("k"), *sums, F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    kept = materialize(counts.groupBy("k", "x1", "x2").agg(F.min("node").alias("node")).select("node", "k"), "node-counts")
    return members.join(kept, "node")


def _small_pairs(nodes: DataFrame, small: int, least: float) -> DataFrame:
    """(a, b, first): likely pairs within small nodes (node, c, part, bits, k), which are compared exhaustively; `first` are
    those that some node's forest takes."""
    lists = [F.collect_list(x).alias(y) for x, y in (("c", "ids"), ("part", "parts"), ("bits", "bits"))]
    few = nodes.where(F.col("k") <= small).groupBy("node").agg(*lists)
    return few.mapInArrow(_node_pairs(least), f"{PAIRS}, first boolean").groupBy("a", "b").agg(F.max("first").alias("first"))


def _head_pairs(large: DataFrame, least: float, sample: int = 64) -> DataFrame:
    """(a, b): each member of a large node (node, c, bits, k) with the node's head, if that is likely. The head is the member
    nearest to the values that are most common among about `sample` members."""
    chance = (F.lit(float(1 << 30)) * sample / F.col("k")).cast("long")
    some = large.where(F.pmod(F.xxhash64(F.lit(6), "node", "c"), F.lit(1 << 30)) < chance).groupBy("node").agg(F.collect_list("bits").alias("bits"))

    def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = []
            for sig in b.column("bits").to_pylist():
                m = _rows_of(sig)
                most.append(bytes(int(np.bincount(m[:, i]).argmax()) for i in range(WIDTH)))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(most, pa.binary())], ["node", "usual"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (_rows_of(b.column("usual").to_pylist()) == _rows_of(b.column("bits").to_pylist())).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("c"), b.column("bits"), pa.array(same.astype(np.int64))], ["node", "c", "bits", "same"])

    usual_of = materialize(some.mapInArrow(usual, "node long, usual binary"), "usual")
    member = large.select("node", "c", "bits")
    scored = member.join(usual_of, "node").mapInArrow(agree, "node long, c long, bits binary, same long")
    nearest = scored.groupBy("node").agg(F.max_by(F.struct("c", "bits"), F.struct("same", F.xxhash64("c"))).alias("head"))
    heads = materialize(nearest.select("node", F.col("head.c").alias("head"), F.col("head.bits").alias("y")), "heads")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = (_rows_of(b.column("bits").to_pylist()) == _rows_of(b.column("y").to_pylist())).sum(axis=1) >= least * WIDTH
            yield _as_pairs(b.column("c").to_numpy()[good], b.column("head").to_numpy()[good])

    pairs = member.join(heads, "node").where("c <> head").select("c", "head", "bits", "y")
    return pairs.mapInArrow(likely, PAIRS).distinct()


def _branched(large: DataFrame) -> DataFrame:
    """(node, c, part, n, bits): the children of large nodes, by one coordinate each, so that there are no more members than before."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, node = children(np.arange(b.num_rows), b.column("node").to_numpy().view(U64), _rows_of(b.column("bits").to_pylist()), 0.0)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(b.column(x).take(at) for x in ("c", "part", "n", "bits"))], ["node", "c", "part", "n", "bits"])

    return large.select("node", "c", "part", "n", "bits").mapInArrow(branch, "node long, c long, part long, n long, bits binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with ``den * intersection >= num * union``, on full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for r, (x, y) in enumerate(zip(b.column("x"), b.column("y"))):
                x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[r] = den * both >= num * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(good))

    joined = pairs.join(sets.select(F.col("c").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("items").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _sets(rows: DataFrame, classes: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(c, items): the full sets of the classes in `needed`."""
    needed = needed.join(classes.select("c", "rep"), "c").select("c", F.col("rep").alias("id"))
    needed = broadcast_if_small(materialize(needed, "needed"), 1_000_000)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(shingle_sets(b.column("text"), k))
            keys = [pa.array(np.array(x, U64).view(np.int64)) for x in zip(*[_sums(s) for s in found])] or [pa.array([], pa.int64())] * 2
            sizes = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("c"), sizes, *keys, pa.array([s.tobytes() for s in found], pa.binary())], ["c", "n", "h1", "h2", "items"])

    # An id may have several rows: the one whose set is the class's is taken, once.
    sets = rows.join(needed, "id").select("c", "text").mapInArrow(items, "c long, n long, h1 long, h2 long, items binary")
    return materialize(sets.where(F.xxhash64("n", "h1", "h2") == F.col("c")).select("c", "items").dropDuplicates(["c"]), "sets")


def _links(rows: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs of classes that are links, by the full sets of their documents."""
    sets = _sets(rows, classes, pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), k)
    return materialize(_confirmed(pairs, sets, num, den), "links")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], lot: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each of `left` with each of `right`."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the shared items, in order of columns."""
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        fits = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        row, at = row[fits], at[fits]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (lr, lc), (rr, rc) = entries(left), entries(right)
    for start in range(0, len(common), lot):
        dense = []
        for n, row, at in ((len(left), lr, lc), (len(right), rr, rc)):
            low, high = np.searchsorted(at, [start, start + lot])
            dense.append(np.zeros((n, lot), np.float32))
            dense[-1][row[low:high], at[low:high] - start] = 1
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _block_links(least: float, num: int, den: int):
    """Links between members of two blocks, or within one, that are in different parts: a forest of them, confirmed on full sets."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for x, y, ids, parts, at, bits, items in zip(*[b.column(c).to_pylist() for c in ("x", "y", "ids", "parts", "at", "bits", "items")]):
                at, parts, m = np.array(at), np.array(parts, np.int64), _rows_of(bits)
                i, j = np.flatnonzero(at == x), np.flatnonzero(at == y)
                likely = (m[i][:, None, :] == m[j][None, :, :]).sum(axis=2) >= least * WIDTH
                likely &= parts[i][:, None] != parts[j][None, :]
                if x == y:
                    likely = np.triu(likely, 1)
                i, j, likely = i[likely.any(axis=1)], j[likely.any(axis=0)], likely[likely.any(axis=1)][:, likely.any(axis=0)]
                if not likely.any():
                    continue
                sets = [np.frombuffer(s, U64) for s in items]
                n = np.array([len(s) for s in sets])
                both = _overlaps([sets[p] for p in i], [sets[q] for q in j])
                root: dict[int, int] = {}

                def top(part: int) -> int:
                    while part in root:
                        part = root[part]
                    return part

                for p, q in zip(*np.nonzero(likely & (den * both >= num * (n[i][:, None] + n[j][None, :] - both)))):
                    low, high = sorted((top(int(parts[i[p]])), top(int(parts[j[q]]))))
                    if low != high:
                        root[high] = low
                        left.append(ids[i[p]])
                        right.append(ids[j[q]])
            yield _as_pairs(np.array(left, np.int64), np.array(right, np.int64))

    return links


def _crowded(large: DataFrame, rows: DataFrame, classes: DataFrame, k: int, num: int, den: int, block: int = 256, room: int = 1 << 22) -> DataFrame:
    """(a, b): links between members of a large node (node, c, part, n, bits) that are in different components so far, all of them compared.

    A node's members are dealt by hash to blocks of about `block` members or `room` bytes of sets. Blocks of its largest component
    meet only the blocks of the others, so a node costs what is not joined yet times its size."""
    sizes = large.groupBy("node", "part").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    stats = sizes.groupBy("node").agg(F.max_by("part", "m").alias("main"), F.max("m").alias("m"), F.sum("m").alias("k"), F.max_by("w", "m").alias("w"), F.sum("w").alias("all"), F.count("*").alias("p")).where("p > 1")
    blocks = lambda m, w: F.ceil(F.greatest(m / block, w * 8 / room, F.lit(1.0))).cast("int")
    stats = materialize(stats.select("node", "main", blocks(F.col("m"), F.col("w")).alias("nm"), blocks(F.col("k") - F.col("m"), F.col("all") - F.col("w")).alias("ns")), "mixed-nodes")
    if stats.isEmpty():
        return large.sparkSession.createDataFrame([], PAIRS)
    own = F.col("part") == F.col("main")
    h = F.xxhash64(F.lit("block"), "c")
    at = F.when(own, F.col("ns") + F.pmod(h, F.col("nm"))).otherwise(F.pmod(h, F.col("ns"))).cast("int")
    member = large.join(stats, "node").withColumn("at", at)
    member = materialize(member.select("node", "c", "part", "bits", "at", F.explode(F.sequence(F.lit(0), F.when(own, F.col("ns") - 1).otherwise(F.col("ns") + F.col("nm") - 1))).alias("o")), "block-members")
    sets = _sets(rows, classes, member.select("c").distinct(), k)
    listed = [F.collect_list(x).alias(y) for x, y in (("c", "ids"), ("part", "parts"), ("at", "at"), ("bits", "bits"), ("items", "items"))]
    pairs = member.join(sets, "c").groupBy("node", F.least("at", "o").alias("x"), F.greatest("at", "o").alias("y")).agg(*listed)
    with small_batches(large.sparkSession, 2):
        return materialize(pairs.mapInArrow(_block_links(_least(num / den), num, den), PAIRS).distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, trees: int = 6, small: int = 32, depth: int = 3, further: int = 2, batch: int = 500) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id that links reach) and kept (id = component_id).

    Words are runs without white space, A-Z in lower case. Documents are linked if ``den * intersection >= num * union`` of
    their sets of distinct `k`-word shingles. Fewer than `k` words are one shingle; null, empty and blank texts have none
    and are linked with nothing. Rows with equal ids are one node. Rows without an id have component_id null and are not kept.
    An empty table gives an empty one. Other columns are not looked at. Python sees `batch` documents or pairs at a time. Trees have `depth` levels,
    and up to `further` more where nodes are large. A tree misses a pair of similarity 0.8 with a chance of about 0.3 in
    `depth` levels and 0.43 in all, so `trees` of them miss it with one of about 0.001 to 0.006; likelier pairs less.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rate, least = den / num / WIDTH, _least(num / den)
    with small_batches(docs.sparkSession, batch):
        sketches = _sketch(rows, k, trees, depth, rate).withColumn("c", F.xxhash64("n", "h1", "h2"))
        sketches = materialize(sketches, "sketches")
        some = sketches.where("n > 0 and id is not null")
        classes = materialize(some.groupBy("c").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("nodes").alias("nodes")), "set-classes")
        nodes = _counted(classes.select(F.explode("nodes").alias("node"), "c", F.col("c").alias("part")))
        nodes = materialize(nodes.join(classes.select("c", "n", "bits"), "c"), "nodes")
        large = nodes.where(F.col("k") > small)
        close = materialize(_small_pairs(nodes, small, least), "close-pairs")
        pairs = close.where("first").select("a", "b")
        crowds = not large.isEmpty()
        if crowds:
            pairs = pairs.unionByName(_head_pairs(large, least)).distinct()
        found = _links(rows, classes, materialize(pairs, "pairs"), k, num, den)
        parts = materialize(components(found, "a", "b"), "parts")
        # What is still apart: the other likely pairs of small nodes, children of large nodes, and blocks of those at the last level.
        apart = close.where("not first").select("a", "b")
        for end in ("a", "b"):
            known = parts.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}"))
            apart = apart.join(known, end, "left").withColumn(f"part_{end}", F.coalesce(f"part_{end}", end))
        apart = apart.where("part_a <> part_b").select("a", "b")
        if crowds:
            known = parts.select(F.col("node").alias("c"), "component")
            large = large.join(known, "c", "left").withColumn("part", F.coalesce("component", "c"))
            for _ in range(further):
                # A node whose members hang together has such children, which are not kept.
                now = materialize(_counted(materialize(_branched(large), "children")), "nodes")
                apart = apart.unionByName(_small_pairs(now, small, least).select("a", "b"))
                large = now.where(F.col("k") > small)
                if large.isEmpty():
                    break
            apart = apart.distinct()
        edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
        edges = edges.unionByName(_links(rows, classes, materialize(apart, "pairs"), k, num, den))
        if crowds:
            edges = edges.unionByName(_crowded(large, rows, classes, k, num, den))
        parts = components(edges, "a", "b").withColumnRenamed("node", "c")
    member = classes.select("c", "rep").join(parts, "c", "left").withColumn("component", F.coalesce("component", "c"))
    lowest = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = member.join(lowest, "component").select("c", "component_id")
    # An id with several texts links what each of them is linked with.
    out = sketches.select("id", "n", "c").join(found, "c", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
