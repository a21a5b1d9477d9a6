import corpus_pipeline as P
from tokenizers import Tokenizer

from boardfoot.llm.queries import tokenizer_path
from boardfoot.llm.surrogates import mentions

DIR = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    """Each stage works on all that the one before kept, and gives the columns of documents until the last."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(P.STAGES):
        inside, out = docs, stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name != "tokens":
            assert sorted(docs.columns) == sorted(columns), name
        if name in ("quality", "near_dedup"):
            assert 0 < docs.count() < before
            assert docs.join(inside, columns, "left_anti").isEmpty()
        if name == "pii":
            assert docs.count() == before
            old = {r["entity"] for r in mentions(inside).collect()}
            assert old and not old & {r["entity"] for r in mentions(docs).collect()}
        if name == "mix":
            assert docs.groupBy("doc_id").count().where("count > 2").isEmpty()
        if name == "tokens":
            assert docs.count() == inside.count()
            library = Tokenizer.from_file(tokenizer_path())
            some = inside.limit(20).collect()
            n = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
            assert all(n[r["doc_id"]] == len(library.encode(r["text"], add_special_tokens=False).ids) for r in some)
        before = docs.count()


def odd(spark, folder):
    """Null and repeated ids, repeated rows, null, blank and long texts, and columns whose names the stages use themselves."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words + " a", "en", "s1", 5), (None, "other text of its own kind here", "en", "s1", 5), (7, words, "en", "s1", 5), (7, words, "en", "s1", 5), (7, "quite another text that has nine words in it", "de", "s2", 5)]
    rows += [(8, None, "en", None, 5), (9, "", "en", "s2", 5), (10, " \n ", "en", "s2", 5), (11, "call +1 (017) 555-7713 now please dear friends", "en", "s1", 5), (12, "long " * 30_000, "en", "s3", 5)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, row_key int, id int, copies int, moved int")
    df.write.parquet(folder)
    return spark.read.parquet(folder), df


def test_stages_on_odd_rows(spark, tmp_path):
    read, made = odd(spark, str(tmp_path / "docs"))
    for docs in (read, made):
        kept = P.quality(spark, docs, DIR)
        assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() >= 2
        left = P.near_dedup(spark, docs, DIR)
        assert left.columns == docs.columns
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, (r["text"] or "")[:9]) for r in left.collect())
        assert got == sorted([(7, "w0 w1 w2 "), (-1, "other tex"), (7, "quite ano"), (8, ""), (9, ""), (10, " \n "), (11, "call +1 ("), (12, "long long")])
        clean = P.pii(spark, docs, DIR)
        assert clean.count() == 10 and clean.columns == docs.columns and clean.where("n_chars is null").count() == 1
        mixed = P.mix(spark, docs, DIR)
        assert mixed.columns == docs.columns and mixed.where("doc_id is null").count() > 0 and mixed.where("text is null or trim(text) = ''").count() == 0
        assert mixed.groupBy("doc_id", "text").count().agg({"count": "max"}).first()[0] <= 4  # a repeated row twice, each twice
        assert P.tokens(spark, docs, DIR).count() == 10
        for _, stage in P.STAGES:
            assert stage(spark, docs.limit(0), DIR).count() == 0
