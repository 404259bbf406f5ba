from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import decontaminate, mixing, quality, simhash
from logweave.llm.frames import table
from logweave.llm.queries import quality_vocabularies


def test_stages_run_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mix", "shard"]
    docs = table(spark, sf, "documents")
    given, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == given
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() == counts[4]


def test_pipeline_of_an_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, sf).schema)
    assert docs.count() == 0


def test_rows_without_a_unique_id(spark, sf):
    good = [r["text"] for r in quality.keep_good(table(spark, sf, "documents"), quality_vocabularies()).where("lang = 'en'").orderBy("doc_id").limit(4).collect()]
    assert len(set(good)) == 4
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    junk = "# $ % " * 60
    rows = [(None, junk), (None, good[0]), (7, junk), (7, good[1]), (None, None)]
    assert texts(quality.keep_good(frame(rows), quality_vocabularies())) == Counter({(None, good[0]): 1, (7, good[1]): 1})

    rows = [(None, good[0]), (None, good[0]), (7, good[1]), (7, good[1]), (8, good[2]), (None, good[2]), (8, good[3])]
    assert texts(simhash.keep_one(frame(rows))) == Counter({(None, good[0]): 1, (7, good[1]): 1, (8, good[2]): 1, (8, good[3]): 1})

    bench = spark.createDataFrame([(1, " ".join(good[0].split()[:20]))], "item_id long, text string")
    rows = [(None, good[0]), (None, good[1]), (7, good[0]), (7, good[2]), (7, good[2])]
    assert texts(decontaminate.drop_contaminated(frame(rows), bench)) == Counter({(None, good[1]): 1, (7, good[2]): 2})

    rows = [(None if k % 2 else 7, "w " * (k + 1) + str(k)) for k in range(30)] + [(None, "w w"), (None, "w w")] + [(5, f"x{k}") for k in range(9)]
    got = texts(mixing.mix_rows(frame(rows)))
    assert set(got) == set(rows) and got.total() == len(rows)  # one source: every row comes once
    assert texts(mixing.mix_rows(frame(rows[::-1]), ranges=5)) == got


def test_every_source_gives_what_the_mix_takes(spark):
    rows = [(k % 5 or None, f"{k} " + "w " * (k % 7), "en", "ab"[k % 2] if k % 3 else None, None) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit("clash")).withColumn("__size", F.lit(1))
    taken = {r["source"]: r["t"] for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    got = mixing.mix_rows(docs)
    assert got.columns == docs.columns
    assert {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum(mixing.count_words(F.col("text"))).alias("t")).collect()} == taken
    assert mixing.mix_rows(docs.limit(0)).count() == 0


def test_intermediate_folders_can_be_deleted(spark, sf):
    import os

    from logweave.llm import frames

    mark = frames.written()
    kept = frames.materialise(table(spark, sf, "documents"), "probe")
    folders = frames._written[mark:]
    assert kept.count() and all(os.path.isdir(f.removeprefix("file:")) for f in folders)
    frames.discard(spark, mark)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in folders)
