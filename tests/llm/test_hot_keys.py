"""Common keys, long words and many ties."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.llm import ann, common, store


def test_spread_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "TOGETHER", 50)
    monkeypatch.setattr(common, "HOT", 10)
    many = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 40).alias("k"), "id")
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    got = common.spread_join(many, one, "k", "n", 3000)
    want = many.join(one, "k").select(*got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert common.spread_join(many.limit(0), one.limit(0), "k", "n", 0).collect() == []


@pytest.mark.parametrize("block", [32, 4096])
def test_ties_of_nearness_go_to_the_smaller_vec_id(spark, block):
    """The query (1, 0) is as near to all (1, x); ids in no order of x. And 400 vectors that tie two by two."""
    rng = random.Random(3)
    xs = list(range(1, 400))
    rng.shuffle(xs)
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, float(x)]) for i, x in enumerate(xs, 1) if i % 20]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), block=block).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(1, 25) if i % 20][:20] and {r.score for r in got} == {1.0}
    rows = [(0, [3.0, 1.0])] + [(i, [float(i // 2), 1.0]) for i in range(1, 401) if i % 20]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).orderBy("rank").collect()
    want = sorted(((-(3.0 * (i // 2) + 1), i) for i in range(1, 401) if i % 20))[:20]
    assert [(-r.score, r.vec_id) for r in got] == want


@pytest.mark.parametrize("file, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_over_slices_long_words_and_lines(file, kind, monkeypatch):
    from tokenizers import Tokenizer

    path = common.tokenizer_path(file)
    library, rng = Tokenizer.from_file(path), random.Random(12)
    encode = common.Encoder(path, kind, most=30)
    letters = "abcdeABC.,'!é 1\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += [None, "", " ", "x" * 30_000, "word " * 9000, "a\n" * 3000, "漢字かな " * 400, "<|endoftext|> a", "   b", "a\x00b c", "İstanbul ǅ ŉ", "z" * 70 + " " + "z" * 70]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (64, 1 << 22):
        monkeypatch.setattr(common.Encoder, "SLICE", size)
        got = [ids.tolist() for _, part in encode.slices(pa.array(texts, pa.string())) for ids in part]
        assert got == want
    assert len(encode.new) <= 30 and len(encode.old) <= 30


def test_shards_are_read_back_each_in_a_task_of_its_own(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = store.write(docs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert manifest.count() == 4
    got = store.read(manifest).withColumn("p", F.spark_partition_id())
    assert got.select("p").distinct().count() == 4 and got.count() == 4000


def test_blocks_of_payload_hold_whole_documents(spark):
    docs = spark.createDataFrame([(i % 50, "w " * (i % 7)) for i in range(300)] + [(None, "n")] * 3, "doc_id long, text string")
    for r in store.write(docs.coalesce(1)).collect():
        shard = store.Shard(r["path"])
        whole = [x for part in shard.documents() for x in part]
        assert whole == [x for part in shard.documents(block=8) for x in part]
        assert [(k, n) for k, _, n, _ in whole[:3]] == [(None, 2)] * 3 or r["nulls"] == 0
        assert all(np.array_equal(shard.starts[i], x[1]) for i, x in enumerate(whole))


def test_shards_and_files_can_be_skipped_by_any_dimension(spark, tmp_path):
    """Of shards (and files) in curve order only some hold a source or a language, as none would if rows were dealt at random."""
    from junctura.llm import shard

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") * 7 % 16).alias("source"), F.concat(F.lit("l"), F.col("id") * 5 % 8).alias("lang"), F.repeat(F.lit("w "), (F.col("id") * 11 % 600 + 1).cast("int")).alias("text"))
    path = f"file://{tmp_path}/shards"
    shard.write_shards(docs, path, shards=16)
    back = spark.read.parquet(path)
    files = back.withColumn("f", F.input_file_name())
    for column in ("source", "lang"):
        per = files.groupBy("f").agg(F.count_distinct(column).alias("n")).agg(F.avg("n")).first()[0]
        assert per <= 0.7 * back.select(column).distinct().count()
    assert back.groupBy("_shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
