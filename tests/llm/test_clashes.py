"""Input columns named like results or like what operators use inside change nothing."""

from conftest import rows
from pyspark.sql import functions as F

from locusmill.llm import ann, chat, html, jaccard, mixing, suffix, topk


def crowded(df, names):
    for k, n in enumerate(names):
        df = df.withColumn(n, F.lit(f"x{k}") if k % 2 else F.lit(k))
    return df


def test_documents(spark):
    p = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, p, "a"), (2, p + " z", "a"), (3, "x y", None)], "doc_id long, text string, source string")
    more = crowded(df, ["row", "label", "n", "size", "target", "copies", "key", "th", "lo", "hi", "__id", "component_id", "n_shingles", "taken", "s"])
    assert rows(mixing.mix(more)) == rows(mixing.mix(df))
    assert rows(jaccard.near_duplicates(more)) == rows(jaccard.near_duplicates(df))
    assert rows(suffix.repeated_passages(more)) == rows(suffix.repeated_passages(df))
    plain = df.withColumn("size", F.lit(7)).withColumn("th", F.lit(1)).withColumn("copies", F.lit("c"))
    assert suffix.without_repeats(plain).columns == plain.columns and rows(suffix.without_repeats(plain), *df.columns) == rows(suffix.without_repeats(df))
    assert rows(mixing.mixed(plain), *df.columns) == rows(mixing.mixed(df))


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "vec_id long, embedding array<float>")
    more = crowded(df, ["v", "shard", "dim", "part", "ids", "rank", "score", "query_id", "place"])
    assert rows(topk.top_k(more, every=10)) == rows(topk.top_k(df, every=10))
    assert rows(ann.nearest(more, every=10)) == rows(ann.nearest(df, every=10))


def test_turns_and_pages(spark):
    t = spark.createDataFrame([(0, 0, "user", "a"), (1, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    more = crowded(t, ["pair_id", "chosen", "rejected", "prompt", "n_prefix", "__t"])
    assert rows(chat.preference_pairs(more, chat.consecutive_pairs(more))) == rows(chat.preference_pairs(t, chat.consecutive_pairs(t)))
    p = spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string")
    more = crowded(p, ["text", "n_chars", "host", "path", "key", "dg", "n"])
    assert rows(html.extract(more)) == rows(html.extract(p)) == [(1, "http://a/", "x", 1)]
    assert html.extract(more, keep=["page_id", "text"]).columns == ["page_id", "text", "n_chars"]
