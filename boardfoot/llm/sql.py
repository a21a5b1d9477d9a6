"""Operators that DuckDB's SQL can say in full, from their definitions and not from their methods."""

#: Each node with the smallest id that links reach, given `links` (a, b in both directions) and `nodes` (id).
REACHED = """, reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)
"""

# Bytes as hexadecimal digits; windows are cut from pieces of 1,000 starts, since cutting from a long text reads all before it.
REPEATS = """WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS MATERIALIZED (SELECT doc_id, 1000 * k AS base, substring(h, 2000 * k + 1, 2398) AS p FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM b)),
windows AS MATERIALIZED (SELECT doc_id, base + i AS i, md5(substring(p, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, base, p, unnest(range(0, len(p) // 2 - 199)) AS i FROM pieces)),
starts AS (SELECT doc_id, i FROM windows SEMI JOIN (SELECT m FROM windows GROUP BY 1 HAVING count(*) > 1) USING (m)),
fresh AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS f FROM starts),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM fresh) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS heads, list(z ORDER BY z) AS tails FROM runs GROUP BY 1),
docs AS (SELECT doc_id, h, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, list_concat([0], tails) AS froms, list_append(heads, len(h) // 2) AS tos FROM b LEFT JOIN cuts USING (doc_id))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(CASE WHEN n_spans = 0 THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda k: substring(h, CAST(2 * froms[k] + 1 AS BIGINT), CAST(2 * (tos[k] - froms[k]) AS BIGINT))), '') END)) AS kept_sha256 FROM docs"""

NEAR_DUPLICATES = (
    r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END AS s FROM words),
flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents)"""
    + REACHED
    + "SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp ON comp.id = doc_id"
)

NEAR_VECTORS = (
    """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98e0),
nodes AS (SELECT vec_id AS id FROM embeddings)"""
    + REACHED
    + "SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) d ON d.a = vec_id"
)



def crc32(x: str) -> str:
    """The unsigned CRC-32 of an ASCII text: each byte is met, then eight bits are shifted out."""
    flow = f"list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({x}, ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), list_transform(range(8), lambda k: CAST(-1 AS BIGINT))))))"
    return f"xor(4294967295, list_reduce({flow}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"


def _manifest(levels: int = 5) -> str:
    """Trees of up to 16 ** levels rows a source and as many sources; a tree of one node goes up unchanged."""
    field = lambda x: f"coalesce(concat(strlen(CAST({x} AS VARCHAR)), ':', CAST({x} AS VARCHAR)), '-')"
    leaf = lambda text: f"sha256(concat({', '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"leaves AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(small)} ELSE {leaf('text')} END AS shown FROM documents)",
        "d AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "a0 AS (SELECT tree, pos, n, leaf AS h FROM d)",
    ]

    def climb(t: str) -> None:
        sides = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN {}), '') AS {}"
        for k in range(levels):
            parts.append(f"{t}s{k} AS MATERIALIZED (SELECT *, {sides.format('UNBOUNDED PRECEDING AND 1 PRECEDING', 'l')}, {sides.format('1 FOLLOWING AND UNBOUNDED FOLLOWING', 'r')} FROM {t}{k})")
            parts.append(f"{t}{k + 1} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {t}{k} GROUP BY tree, pos // 16)")

    climb("a")
    parts.append(f"b0 AS (SELECT 0 AS tree, tree AS pos, (SELECT count(*) FROM a{levels}) AS n, h FROM a{levels})")
    climb("b")
    parts.append("f0 AS (SELECT doc_id, tree, pos, leaf, shown AS h, '' AS p FROM d)")
    step = "SELECT f.doc_id, f.tree, f.pos, f.leaf, CASE WHEN s.n = 1 THEN f.h ELSE sha256(concat(s.l, f.h, s.r)) END AS h, concat(f.p, s.l, s.r) AS p FROM f{} f JOIN {} s ON s.tree = {} AND s.pos = {} // {}"
    for k in range(2 * levels):
        where = (f"as{k}", "f.tree", "f.pos", 16**k) if k < levels else (f"bs{k - levels}", "0", "f.tree", 16 ** (k - levels))
        parts.append(f"f{k + 1} AS ({step.format(k, *where)})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, t.h AS subroot, r.h AS root, sha256(p) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified FROM f{2 * levels} f JOIN a{levels} t ON t.tree = f.tree CROSS JOIN b{levels} r"


# Every pair of equal words of a text is a match on the diagonal of their distance; matches in a row are found by subtracting
# their row number. Equal stretches of several periods have the smallest.
PERIODS = f"""WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o, {crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
e AS (SELECT *, len(o) AS n, h // 10 AS g FROM c),
x AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM e),
t AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN o[1 + a + (i - a) % p] ELSE o[1 + i] END) ELSE o END AS w FROM x),
w AS MATERIALIZED (SELECT doc_id, n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM t),
m AS (SELECT y.doc_id, y.i, y.i - z.i AS q FROM w y JOIN w z ON y.doc_id = z.doc_id AND y.word = z.word AND z.i < y.i AND 4 * (y.i - z.i) <= y.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, k) WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r),
l AS (SELECT doc_id, count(*) AS c, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS told FROM r GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
f AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN g USING (doc_id, i) GROUP BY 1)
SELECT t.doc_id, coalesce(c, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN f USING (doc_id)"""

ORACLES = {"op1_remove_repeats": REPEATS, "op6_near_duplicates": NEAR_DUPLICATES, "op8_near_vectors": NEAR_VECTORS, "op11_manifest": _manifest(), "op12_periodic_runs": PERIODS}
