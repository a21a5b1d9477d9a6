"""Many queries against many products, inside their groups: phrases, substrings, likeness."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.functions.stemming import stem_tokens
from boardfoot.functions.text import filled, strip
from boardfoot.plans.shared import broadcast_if_small, materialize

# Words that stand for each other, in order.
SYNONYMS = {
    "2x4": ["2x4", "2 x 4", "8/4"], "2x6": ["2x6", "2 x 6"], "2x8": ["2x8", "2 x 8"], "1x4": ["1x4", "1 x 4", "4/4"],
    "1x6": ["1x6", "1 x 6"], "1 inch": ["4/4", '1"', "1 inch"], "2 inch": ["8/4", '2"', "2 inch"],
    "inch and a quarter": ["5/4"], "inch and a half": ["6/4"],
    "select": ["select", "s&b", "sel & btr", "sel&btr", "select & better"],
    "common": ["common", "1c", "#1c", "1 com", "#1 common"], "#1": ["#1", "1c", "#1c", "#1 common", "1 common"],
    "#2": ["#2", "2c", "#2c", "#2 common", "2 common", "2a"], "fas": ["fas", "fas/sel"],
    "rustic": ["rustic", "wormy", "ambrosia", "character"], "prime": ["prime", "superprime", "premium"],
    "pine": ["pine", "syp", "southern yellow pine", "white pine"], "oak": ["oak", "red oak", "white oak"],
    "maple": ["maple", "hard maple", "soft maple"], "birch": ["birch", "white birch", "yellow birch"],
    "elm": ["elm", "red elm", "grey elm"], "cedar": ["cedar", "aromatic cedar", "aromatic red cedar"],
    "treated": ["treated", "pressure treated", "pt"], "rift": ["rift", "rift & quartered", "rift & quarter", "r&q", "quartered"],
    "quartersawn": ["quartered", "quarter sawn", "quarter", "rift & quartered"], "plain": ["plain sawn", "plain", "flat sawn"],
    "kiln dried": ["kiln dried", "kd", "kiln"], "air dried": ["air dried", "ad"], "steamed": ["steamed"],
    "wormy": ["wormy", "ambrosia", "whnd"],
}
# Words that do not have to be found.
SMALL_WORDS = ("the", "and", "for", "all", "with", "any")
LIKE_COLUMNS = ("product", "product_normalized", "species", "grade", "description")
WORD_COLUMNS = (*LIKE_COLUMNS, "thickness", "mill_name")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
LEAST_LIKENESS = 0.4


def expand_query(query: Column) -> Column:
    """The query, the synonyms of every group it touches, then those of groups that its words name."""
    q = F.lower(strip(query))
    groups = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, s)).alias("s")) for k, s in SYNONYMS.items()])
    touched = F.filter(groups, lambda g: F.contains(q, g["k"]) | F.exists(g["s"], lambda s: F.contains(q, s)))
    words = F.transform(F.split(q, r"\s+"), lambda w: F.regexp_replace(w, "^#+|#+$", ""))
    named = F.flatten(F.transform(words, lambda w: F.filter(groups, lambda g: g["k"] == w)))
    return F.array_distinct(F.concat(F.array(q), F.flatten(F.transform(touched, lambda g: g["s"])), F.flatten(F.transform(named, lambda g: g["s"]))))


def fts_phrase(term: Column) -> Column:
    """What is looked up for a term: odd signs are spaces; a single word with signs in it loses them."""
    clean = strip(F.regexp_replace(term, r"[^\w\s/&#+]", " "))
    bare = ~F.contains(clean, F.lit(" ")) & clean.rlike("[/&#]")
    return filled(F.when(bare, strip(F.regexp_replace(term, r"[^\w\s]", ""))).otherwise(clean))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)


def stemmed(df: DataFrame, stem: bool) -> DataFrame:
    """`df` with its column token stemmed; each distinct token is stemmed once."""
    if not stem:
        return df
    words = df.select("token").distinct().withColumn("stem", stem_tokens(F.col("token")))
    return df.join(words, "token").drop("token").withColumnRenamed("stem", "token")


def build_postings(products: DataFrame, columns: tuple[str, ...], stem: bool = True) -> DataFrame:
    """(group_id, id, col, pos, token) of all words in the columns."""
    long = products.unpivot(["group_id", "id"], list(columns), "col", "value").where(F.col("value").isNotNull())
    return stemmed(long.select("group_id", "id", "col", F.posexplode(tokens(F.col("value"))).alias("pos", "token")), stem)


def query_terms(queries: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, group_id, term_no, term) of queries (query_id, group_id, query)."""
    return queries.select("query_id", "group_id", F.posexplode(F.slice(expand_query(F.col("query")), 1, most)).alias("term_no", "term"))


def term_postings(terms: DataFrame, postings: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, term_no, group_id, id, tf): places in one column where a term's words follow each other."""
    t = terms.select("query_id", "group_id", "term_no", F.posexplode(tokens(fts_phrase(F.col("term")))).alias("off", "token"))
    size = t.groupBy("query_id", "term_no").agg(F.count("*").alias("m"))
    hits = stemmed(t, stem).join(postings, ["group_id", "token"]).groupBy("query_id", "term_no", "group_id", "id", "col", (F.col("pos") - F.col("off")).alias("at")).agg(F.count_distinct("off").alias("k"))
    whole = hits.join(broadcast_if_small(size, 200_000), ["query_id", "term_no"]).where("k = m")
    return whole.groupBy("query_id", "term_no", "group_id", "id").agg(F.count("*").alias("tf"))


def long_values(products: DataFrame, columns, *keep: str) -> DataFrame:
    """(group_id, id, keep, col, value) of the columns that are filled; values as they are."""
    return products.unpivot(["group_id", "id", *keep], list(columns), "col", "value").where(F.col("value").isNotNull())


def phrase_counts(phrases: DataFrame, values: DataFrame, stem: bool = True) -> DataFrame:
    """(phrase, value, n): in how many places of each distinct value a phrase's words follow each other."""
    p = phrases.select("phrase").distinct().select("phrase", F.posexplode(tokens(F.col("phrase"))).alias("off", "token"))
    size = p.groupBy("phrase").agg(F.count("*").alias("m"))
    v = values.select("value").distinct().select("value", F.posexplode(tokens(F.col("value"))).alias("pos", "token"))
    hits = stemmed(p, stem).join(stemmed(v, stem), "token").groupBy("phrase", "value", (F.col("pos") - F.col("off")).alias("at")).agg(F.count("*").alias("k"))
    return hits.join(broadcast_if_small(size, 200_000), "phrase").where("k = m").groupBy("phrase", "value").agg(F.count("*").alias("n"))


def bm25_search(queries: DataFrame, products: DataFrame, columns: tuple[str, ...], limit: int = 100, stem: bool = True) -> DataFrame:
    """(query_id, id, score): products that hold a term's phrase, by BM25 over the group's products; a product has the score
    of its first term. The top 2 * limit of each term count.

    Phrases are looked for once in each distinct value; products meet only the values that some term of their group is in.
    """
    words = sum((F.coalesce(F.size(tokens(F.col(c))), F.lit(0)) for c in columns), F.lit(0))
    sized = products.select("group_id", "id", *columns, words.alias("dl"))
    totals = sized.groupBy("group_id").agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    terms = query_terms(queries).select("query_id", "group_id", "term_no", fts_phrase(F.col("term")).alias("phrase"))
    wanted = terms.join(phrase_counts(terms, long_values(products, columns), stem), "phrase").select("query_id", "term_no", "group_id", "value", "n")
    wanted = broadcast_if_small(materialize(wanted, "phrases"), 200_000)
    tf = long_values(sized, columns, "dl").join(wanted, ["group_id", "value"]).groupBy("query_id", "term_no", "group_id", "id").agg(F.sum("n").alias("tf"), F.first("dl").alias("dl"))
    tf = materialize(tf, "term-hits")
    return rank_terms(tf, totals, limit)


def rank_terms(tf: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score) by BM25 from (query_id, term_no, group_id, id, tf, dl): of each term the best 2 * limit, of a product
    found by several terms the score of the first."""
    df = tf.groupBy("query_id", "term_no").agg(F.count("*").alias("df"))
    j = tf.join(df, ["query_id", "term_no"]).join(totals, "group_id")
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    top = Window.partitionBy("query_id", "term_no").orderBy(F.desc("score"), "id")
    j = j.select("query_id", "term_no", "id", score.alias("score")).withColumn("r", F.row_number().over(top)).where(F.col("r") <= 2 * limit)
    return j.groupBy("query_id", "id").agg(F.min_by("score", "term_no").alias("score"))


def grams(x: Column, n: Column) -> Column:
    """The different runs of `n` signs in a text; of none, the empty text."""
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substr(x, i, n))))


def containing(patterns: DataFrame, values: DataFrame) -> DataFrame:
    """(pattern, value): values (in any letter case) that hold a pattern (in small letters).

    Each pattern meets only the values with its rarest run of three signs (of one or two, if it has no more), and is looked
    for in those.
    """
    p = patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct()
    p = p.select("pattern", F.explode(grams(F.col("pattern"), F.least(F.lit(3), F.length("pattern")))).alias("gram"))
    low = F.lower("value")
    runs = F.flatten(F.array(*[F.when(F.length(low) >= n, grams(low, F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(4)]))
    v = materialize(values.select("value").where(F.col("value").isNotNull()).distinct(), "values").select("value", F.explode(runs).alias("gram"))
    v = v.join(broadcast_if_small(p.select("gram").distinct(), 200_000), "gram", "left_semi")
    rarest = p.join(v.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    return v.join(broadcast_if_small(rarest, 200_000), "gram").where(F.contains(low, F.col("pattern"))).select("pattern", "value")


def like_match(queries: DataFrame, products: DataFrame, columns: tuple[str, ...] = LIKE_COLUMNS) -> DataFrame:
    """(query_id, pattern, id): products with a pattern of (query_id, group_id, pattern) inside a column, each once."""
    columns = [c for c in columns if c in products.columns]
    values = long_values(products, columns)
    wanted = materialize(queries.join(containing(queries, values), "pattern"), "patterns")
    return values.join(broadcast_if_small(wanted, 200_000), ["group_id", "value"]).select("query_id", "pattern", "id").distinct()


def partial_search(queries: DataFrame, products: DataFrame, limit: int = 100) -> DataFrame:
    """(query_id, id): products with the query or one of its first terms inside a column, or all its important words. The
    first 2 * limit ids of each pattern count."""
    q = queries.select("query_id", "group_id", F.explode(F.array_distinct(F.concat(F.array(F.lower("query")), F.slice(expand_query(F.col("query")), 1, 5)))).alias("pattern"))
    hits = like_match(q, products)
    important = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*SMALL_WORDS))
    words = queries.select("query_id", "group_id", F.array_distinct(important).alias("words"), F.size(important).alias("size")).where("size >= 2")
    each = like_match(words.select("query_id", "group_id", F.explode("words").alias("pattern")), products, WORD_COLUMNS)
    held = each.groupBy("query_id", "id").agg(F.count("*").alias("k")).join(broadcast_if_small(words.select("query_id", F.size("words").alias("size")), 200_000), "query_id")
    both = held.where("k = size").select("query_id", F.lit("\n all words").alias("pattern"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id", "pattern").orderBy("id"))
    return hits.unionByName(both).withColumn("r", rank).where(F.col("r") <= 2 * limit).select("query_id", "id").distinct()


def likeness(query: str, value: str) -> Column:
    """Ratcliff and Obershelp's ratio, the query first; 0.6 at least if a query word of over 2 letters is inside."""
    return F.pandas_udf(_ratios, "double")(query, value)


def _ratios(query: pd.Series, value: pd.Series) -> pd.Series:
    match, last = SequenceMatcher(None), None

    def one(q: str, v: str) -> float:
        nonlocal last
        if v != last:
            match.set_seq2(v)  # this counts the value's letters, so values come sorted
            last = v
        match.set_seq1(q)
        return max(match.ratio(), 0.6) if any(len(w) > 2 and w in v for w in q.split()) else match.ratio() if match.quick_ratio() >= LEAST_LIKENESS else 0.0

    return pd.Series([one(q, v) for q, v in zip(query, value)], dtype="float64")


#: Parts into which the values of one group and length are dealt, so that a large group is many tasks.
PARTS = 16


def letters(text: Column) -> Column:
    """A text's letters, each with how often it stood before: two texts share as many of these as their letter counts have in
    common, which bounds what any matching of them can pair."""
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(signs, lambda c, i: F.concat(c, F.size(F.filter(F.slice(signs, F.lit(1), i), lambda x: x == c)).cast("string")))


def like_candidates(asked: DataFrame, texts: DataFrame, least: float = LEAST_LIKENESS) -> DataFrame:
    """(query, value): the pairs of one group whose letters let the ratio reach `least`, or whose value holds a word of the query.

    Values meet the queries of their group whose length is near enough, by bands of length; the letters that two texts share then
    bound their ratio exactly from above. Values that hold a word come from the index of runs of signs (`containing`).
    """
    band = lambda n: F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    n = F.length("query")
    far = (2 - least) / least
    q = asked.select("query").distinct().select("query", letters(F.col("query")).alias("ql"), n.alias("qn"))
    q = q.join(asked.distinct(), "query").withColumn("band", F.explode(F.sequence(band(F.floor(n / far)), band(F.ceil(n * far)))))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    n = F.length("value")
    v = texts.select("value").distinct().select("value", letters(F.col("value")).alias("vl"), n.alias("vn"))
    v = texts.join(v, "value").withColumns({"band": band(F.col("vn")), "part": F.pmod(F.hash("value"), F.lit(PARTS))})
    near = v.join(broadcast_if_small(q, 200_000), ["group_id", "band", "part"])
    near = near.where(2 * F.size(F.array_intersect("ql", "vl")) >= least * (F.col("qn") + F.col("vn")))
    words = asked.select("group_id", "query", F.explode(F.filter(F.split("query", r"\s+"), lambda w: F.length(w) > 2)).alias("pattern")).distinct()
    held = words.join(containing(words, texts), "pattern").join(texts, ["group_id", "value"])
    return near.select("query", "value").unionByName(held.select("query", "value")).distinct()


def fuzzy_search(queries: DataFrame, products: DataFrame, limit: int = 100, least: float = LEAST_LIKENESS) -> DataFrame:
    """(query_id, id, score): products with a column like the query. Only distinct pairs of texts are compared, and of these only
    `like_candidates`. `least` is not below LEAST_LIKENESS."""
    columns = [c for c in LIKE_COLUMNS if c in products.columns]
    values = long_values(products, columns).select("group_id", "id", F.lower("value").alias("value"))
    q = queries.select("query_id", "group_id", F.lower("query").alias("query"))
    texts, asked = materialize(values.select("group_id", "value").distinct(), "like-texts"), materialize(q.select("group_id", "query").distinct(), "like-queries")
    pairs = like_candidates(asked, texts, least).repartition("value").sortWithinPartitions("value")
    like = pairs.withColumn("score", likeness("query", "value")).where(F.col("score") >= least)
    wanted = broadcast_if_small(materialize(like.join(q, "query").select("query_id", "group_id", "value", "score"), "likeness"), 200_000)
    best = values.join(wanted, ["group_id", "value"]).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("r", rank).where(F.col("r") <= 2 * limit).drop("r")


def full_queries(found: DataFrame, limit: int) -> DataFrame:
    """The queries with `limit` products or more."""
    return found.groupBy("query_id").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= limit).select("query_id")


def merge_tiers(exact: DataFrame, partial: DataFrame, fuzzy: DataFrame | None, limit: int = 100) -> DataFrame:
    """(query_id, id, tier, score): each product in its first tier; likeness only for queries with fewer than `limit` so far."""
    found = exact.select("query_id", "id", F.lit(1).alias("tier"), "score").unionByName(partial.select("query_id", "id", F.lit(2).alias("tier"), F.lit(0.5).alias("score")))
    if fuzzy is not None:
        found = found.unionByName(fuzzy.join(full_queries(found, limit), "query_id", "left_anti").select("query_id", "id", F.lit(3).alias("tier"), "score"))
    return found.groupBy("query_id", "id").agg(F.min("tier").alias("tier"), F.min_by("score", "tier").alias("score"))


def page_results(found: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of each query's results, best tier and score first, with their number in all."""
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "id")
    total = F.count("*").over(Window.partitionBy("query_id"))
    return found.withColumns({"rank": F.row_number().over(order), "total": total}).where(F.col("rank").between(offset + 1, offset + limit))


def results_after(found: DataFrame, last: DataFrame, limit: int = 100) -> DataFrame:
    """The next `limit` results of each query behind the last one seen (query_id, tier, score, id); of queries without one, the
    first. What was seen is filtered away, so a deep page costs what the first does."""
    seen = last.select("query_id", F.col("tier").alias("t"), F.col("score").alias("s"), F.col("id").alias("i"))
    j = found.join(broadcast_if_small(seen, 200_000), "query_id", "left")
    beyond = (F.col("tier") > F.col("t")) | ((F.col("tier") == F.col("t")) & ((F.col("score") < F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("id") > F.col("i")))))
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "id")
    return j.where(F.col("t").isNull() | beyond).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("t", "s", "i", "rank")


def search(queries: DataFrame, products: DataFrame, columns: tuple[str, ...], limit: int = 100, offset: int = 0, stem: bool = True, fuzzy: bool = True) -> DataFrame:
    """All tiers merged, a page of them. Likeness is worked out only for queries that the other tiers leave below `limit`."""
    exact = materialize(bm25_search(queries, products, columns, limit, stem), "exact")
    partial = materialize(partial_search(queries, products, limit), "partial")
    like = None
    if fuzzy:
        full = full_queries(exact.select("query_id", "id").unionByName(partial), limit)
        like = fuzzy_search(materialize(queries.join(full, "query_id", "left_anti"), "short-queries"), products, limit)
    return page_results(merge_tiers(exact, partial, like, limit), limit, offset)
