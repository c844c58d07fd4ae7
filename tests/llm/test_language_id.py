"""Language ID: the automaton and the parse against plain string search, held-out labels, odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import language_id as lid

DATA = "/root/testdata/sf0.01"


def by_hand(text: bytes, known: bytes) -> int:
    """Phrases of the greedy parse, by searching for each."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and known.find(text[at : at + size + 1]) >= 0:
            size += 1
        n, at = n + 1, at + size
    return n


def parser(stretches, lang="x"):
    import pandas as pd

    row = lid._automaton((lang,), pd.DataFrame({"h1": range(len(stretches)), "h2": 0, "stretch": stretches})).iloc[0]
    return lid.Parser(**row.to_dict())


def test_automaton_knows_exactly_the_substrings():
    rng = np.random.default_rng(3)
    for _ in range(20):
        s = bytes(rng.integers(97, 100, rng.integers(1, 40)).tolist())
        step = lid.suffix_automaton(s)
        assert len(step) <= 2 * len(s) + 1

        def ways(state):
            return 1 + sum(map(ways, step[state].values()))

        assert ways(0) - 1 == len({s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)})


def test_phrases_equal_plain_search():
    rng = np.random.default_rng(5)
    word = lambda n, top: "".join(chr(c) for c in rng.integers(97, top, n))
    stretches = [word(60, 101), word(80, 101), "été fini"]
    texts = [lid.plain(t.encode()) for t in (word(200, 102), "a", "", "zzz été", word(lid.WINDOW + 5, 101), stretches[0], "é" * 3)]
    known = b"\0".join(lid.plain(s.encode()) for s in stretches)
    p = parser(stretches)
    got = lid.entropies(texts, [p])[:, 0]
    for t, bits in zip(texts, got):
        phrases = sum(by_hand(t[i : i + lid.WINDOW], known) for i in range(0, len(t), lid.WINDOW))
        assert bits == pytest.approx(phrases * p.bits / max(len(t), 1))


def rows(spark, more=()):
    known = [(i, f"the cat and the dog number {i} went there {'x' * (i % 3)}", "en") for i in range(40)]
    known += [(100 + i, f"der hund und die katze nummer {i} gingen dort hin", "de") for i in range(40)]
    return spark.createDataFrame(known + list(more), "doc_id long, text string, lang string")


def test_odd_rows(spark):
    more = [(None, "and the dog", "en"), (900, None, "en"), (901, "", "de"), (902, "12 + 34 = ×", "de"), (903, "und die katze", None),
            (904, "and the dog " * 30_000, None), (905, "你好", None), (903, "und die katze", None)]
    docs = rows(spark, more).select("*", F.lit(1).alias("score"), F.lit("q").alias("a.b"), F.lit(0).alias("_text"))
    learned = lid.learn(docs.where(lid.learnable(F.col("doc_id"))))
    assert [r["lang"] for r in learned] == ["de", "en"]
    out = lid.identify(docs, learned)
    assert out.columns == ["doc_id", "text", "lang", "score", "a.b", "_text", "lang_pred"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in out.where("doc_id is null or doc_id >= 900").collect()]
    # No language has a byte of the last: as many phrases in each, and the smaller one's cost fewer bits.
    assert {(k, p) for k, p, _ in got} == {(None, "en"), (900, "und"), (901, "und"), (902, "und"), (903, "de"), (904, "en"), (905, "en")}
    assert len(got) == len(more) and all(0 <= s <= 1 for _, _, s in got) and [s for k, _, s in got if k in (900, 901, 902)] == [0] * 3
    assert lid.identify(docs.where("false"), learned).count() == 0
    nothing = lid.learn(docs.where("false"))
    assert nothing == [] and {r.lang_pred for r in lid.identify(docs, nothing).collect()} == {"und"}


def test_result_depends_on_texts_alone(spark):
    docs = rows(spark)
    one = lid.learn(docs.repartition(1))
    assert one == lid.learn(docs.union(docs).repartition(7, "text"))
    # Languages share the bound; each keeps one stretch at least.
    assert all(0 < r["chars"] <= lid.STRETCH for r in lid.learn(docs, total=1))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_held_out_languages(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    got = lid.query(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
