"""Trees against hashlib, whatever the sizes, and what odd rows give."""

import hashlib
import itertools

from pyspark.sql import functions as F

from boardfoot.llm.manifest import lower_ascii, manifest, proof_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, hash int, pos int, N string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    told = ["-" if row[k] is None else f"{len(str(row[k]).encode())}:{row[k]}" for k in ("doc_id", "source", "lang", "n_chars", "text")]
    return h(*told)


def tree(nodes, fan):
    """(root, for each node its path of (left, right))."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            a = i - i % fan
            paths[k].append(("".join(level[a:i]), "".join(level[i + 1 : a + fan])))
        at = [i // fan for i in at]
        level = [h(*level[a : a + fan]) for a in range(0, len(level), fan)]
    return level[0], paths


def expected(rows, fan, tampered):
    groups = [(s, sorted(g, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))) for s, g in itertools.groupby(sorted(rows, key=lambda r: (r["source"] is not None, (r["source"] or "").encode())), key=lambda r: r["source"])]
    trees = [tree([leaf(r) for r in g], fan) for _, g in groups]
    root, above = tree([t[0] for t in trees], fan)
    for (_, g), (subroot, paths), top in zip(groups, trees, above):
        for r, path in zip(g, paths):
            path = path + top
            now = leaf(r | {"text": r["text"] and "".join(c.lower() if c in "ABCXYZ" else c for c in r["text"])}) if tampered(r) else leaf(r)
            for a, b in path:
                now = h(a, now, b)
            yield (r["doc_id"], leaf(r), subroot, root, h(*(a + b for a, b in path)), now)


def check(spark, rows, fan):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], SCHEMA).repartition(3)
    got = manifest(df, tampered={"text": lower_ascii(F.col("text"))}, where=F.col("doc_id") % 5 == 0, fan=fan)
    got = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof"), "folded_root").collect()
    want = sorted(expected(rows, fan, lambda r: r["doc_id"] is not None and r["doc_id"] % 5 == 0), key=str)
    assert sorted(map(tuple, got), key=str) == want
    return want


def row(i, source, text="Some Text", lang="en", n=9):
    return {"doc_id": i, "source": source, "text": text, "lang": lang, "n_chars": n, "tree": "x", "hash": 1, "pos": 2, "N": "y"}


def test_trees_of_many_sizes(spark):
    """Sources of 1 to 40 rows and more sources than a run holds; columns named like the operator's own do no harm."""
    rows = [row(1000 * k + i, f"s{k}", f"ABC {k} {i} é") for k, n in enumerate((1, 2, 3, 4, 5, 9, 16, 17, 40)) for i in range(n)]
    want = check(spark, rows, 4)
    assert len({w[3] for w in want}) == 1 and any(w[5] != w[3] for w in want) and any(w[5] == w[3] for w in want)


def test_odd_rows(spark):
    """Null fields, the null source and the empty one, repeated ids and rows, a long text: every row is a leaf."""
    rows = [row(None, None, None, None, None), row(1, None, ""), row(1, "", None), row(2, "a"), row(2, "a"), row(2, "a", "B"), row(None, "a", "x"), row(5, "ä", "ABC" * 200_000), row(7, "Z", "abc")]
    assert len(check(spark, rows, 2)) == len(rows)


def test_one_row_and_none(spark):
    want = check(spark, [row(5, "a", "abc")], 16)
    assert want[0][1] == want[0][2] == want[0][3] == want[0][5] and want[0][4] == h()
    df = spark.createDataFrame([], SCHEMA)
    assert manifest(df).collect() == []
