"""The pipeline against a brute-force version, and the queries against their SQL."""

import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loomgraph.llm import mixing, quality
from tests.llm.test_operators import brute_components, words

DATA = "/root/testdata/sf0.001"


def small_tables(spark, path):
    rng = random.Random(37)
    items = [(i, " ".join(f"q{rng.randrange(400)}" for _ in range(20))) for i in range(5)]
    rows = []
    for i in range(150):
        t = words(rng, rng.randrange(40, 90), 3000)
        if i % 5 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if i % 7 == 0 and i:
            t = rows[-1][1]
        if i % 11 == 0:
            t = f"{t} {items[i % 5][1]} end"
        rows.append((i, t, "en", f"s{0 if i % 3 else i % 4}", len(t)))
    rows.append((900, "", "en", None, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("!!" not in t), 0) for i, t, *_ in rows if i % 2 and t], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = small_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [r for r in rows if model.score((r[1] or "").encode()) >= quality.CUT]
    assert {r[0] for r in left if r[1]} == {r[0] for r in rows if r[1] and "!!" not in r[1]}
    component = brute_components([r[:2] for r in left])
    left = [r for r in left if component[r[0]] == r[0]]
    left = [r for r in left if not any(t in r[1] for _, t in items)]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"}
    per = Counter(r["doc_id"] for r in out)
    assert set(per) == {r[0] for r in left} and max(per.values()) <= mixing.MAX_REPEATS + 1
    texts = {r[0]: r[1] for r in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in out)
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_pipeline_takes_odd_columns(spark, tmp_path):
    rows, _ = small_tables(spark, str(tmp_path))
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = {"a.b": "1", "score": "'s'", "kept": "'k'", "shard": "'h'", "mix_order": "'m'", "predicted": "'p'", "c0": "'c'", "_doc": "'d'", "Slot": "'x'", "_leaking": "'l'"}
    twice = plain.unionByName(plain.where("doc_id < 20")).selectExpr("*", *(f"{v} as `{k}`" for k, v in odd.items()))
    twice = twice.unionByName(twice.where("doc_id < 9").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(twice.limit(1).withColumn("text", F.lit(None).cast("string")))
    (tmp_path / "odd").mkdir()
    for t in ("labels", "benchmark"):
        os.symlink(f"{tmp_path}/{t}.parquet", f"{tmp_path}/odd/{t}.parquet")
    twice.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert out.columns == [c for c in twice.columns if c not in ("shard", "Slot")] + ["shard", "slot"]
    got = out.collect()
    assert all((r["a.b"], r["score"], r["kept"], r["mix_order"], r["predicted"], r["c0"]) == (1, "s", "k", "m", "p", "c") for r in got)
    texts = {r["text"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {r["text"] for r in got if r["text"]} == {t for t in texts if t}
    (tmp_path / "none").mkdir()
    for t in ("labels", "benchmark"):
        os.symlink(f"{tmp_path}/{t}.parquet", f"{tmp_path}/none/{t}.parquet")
    twice.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_chat_formatting", "op5_url_filter", "op9_near_dedup", "reply_trees", "url_aliases"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want, got = con.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_queries_are_registered():
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in entry.queries())] == [] and "pipeline" in entry.queries()
