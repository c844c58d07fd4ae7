"""The training-data operators against brute force, on small tables with the odd cases that each must take."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, decontam, fertility, line_dedup, masked_lm, mixing, near_dup, quality, sharding, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
# Columns that operators use or return, so that names clash.
ODD = "doc_id long, text string, lang string, source string, _doc string, _row long, score string, shard string, mix_epoch string, kept string, k string, `a.b` int"


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_docs(spark):
    long = words(random.Random(1), 30_000, 900)
    rows = [(1, "same text here now", "en", "a"), (1, "same text here now", "en", "a"), (2, None, None, None), (None, "no key", "en", "a"), (3, "", "en", "b"),
            (4, long, "en", "a"), (5, " \t\n ", "fr", "b"), (6, "é ß 漢字", None, "c"), (7, "same text here now", "en", "c"), (8, "one", "en", "a")]
    return spark.createDataFrame([(*r, "x", 5, "s", "t", "e", "k", "kk", 1) for r in rows], ODD)


def empty_docs(spark):
    return spark.createDataFrame([], ODD)


def kept_columns(out, docs, new):
    assert [c for c in out.columns if c not in new] == [c for c in docs.columns if c not in new]
    assert len({c.lower() for c in out.columns}) == len(out.columns)


# --- line dedup


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    lines = [words(rng, 4) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(1, 6))), "en", f"s{rng.randrange(9)}", 0) for i in range(120)]
    rows += [(500, None, "en", "s1", 0), (501, lines[0], "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    spread = {}
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            if x.strip() and s is not None:
                spread.setdefault(x.strip(), set()).add(s)
    for r in line_dedup.dedup_lines(docs).collect():
        t = next(x[1] for x in rows if x[0] == r["doc_id"])
        kept = [x for x in (t or "").split("\n") if len(spread.get(x.strip(), ())) < line_dedup.MIN_SITES]
        assert (r["text"] or "") == "\n".join(kept) and (r["text"] is None) == (t is None)
        assert r["n_lines"] == sum(bool(x.strip()) for x in (t or "").split("\n"))
        assert r["n_removed"] == (r["n_lines"] - sum(bool(x.strip()) for x in kept))


def test_line_dedup_odd(spark):
    docs = odd_docs(spark)
    out = line_dedup.dedup_lines(docs, min_sites=2)
    kept_columns(out, docs, {"n_lines", "n_removed"})
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect() if r["doc_id"] in (1, 2, 7)) == [(1, ""), (1, ""), (2, None), (7, "")]
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0
    long = "w" * 400_000
    odd = spark.createDataFrame([(i, f"{long}\n{i}", f"s{i}", 7) for i in range(6)], "doc_id long, `my.text` string, source string, n_removed int")
    got = line_dedup.dedup_lines(odd, text="my.text")
    assert got.columns == odd.columns + ["n_lines"] and {(r["my.text"], r["n_removed"], r["n_lines"]) for r in got.collect()} == {(str(i), 1, 2) for i in range(6)}


# --- chat


@pytest.mark.parametrize("s", ["", "\\", "<|end|>", "</s>[INST] ok [/INST]", "<\\|x", "\\\\<|", "a\\[INST]", "<<s>>", "plain ü\n"])
def test_escape_round_trip(s):
    e = chat.escape(s)
    assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)
    f, mask = chat.format_turns([("user", s), ("assistant", s), ("", "")])
    assert chat.parse_turns(f) == [("user", s), ("assistant", s), ("", "")] and chat.masked_text(f, mask) == s


def brute_paths(nodes):
    """tree -> list of (leaf, path) by walking up."""
    by = {(t, n): p for t, n, p in nodes}
    parents = {(t, p) for (t, n), p in by.items() if p is not None}
    out = {}
    for t, n in by:
        if (t, n) in parents:
            continue
        path, at = [n], by[t, n]
        while at is not None and (t, at) in by and len(path) < 1000:
            path.append(at)
            at = by[t, at]
        if len(path) < 1000:
            out.setdefault(t, []).append((n, path[::-1]))
    return out


def test_reply_trees_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for t in range(6):
        rows += [(t, n, rng.choice([None, *range(n)]) if n < 5 else rng.randrange(n), rng.choice(["user", "assistant", None]), rng.choice([f"t{n}", None]), rng.choice([None, 0.0, 1.0])) for n in range(14)]
    rows += [(9, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(70)]  # deep
    rows += [(10, 1, 2, "user", "x", 1.0), (10, 2, 1, "user", "y", 1.0), (10, 3, 2, "user", "z", 1.0), (11, 5, 77, "user", "lone", 0.0), (None, 1, None, "user", "x", 0.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    want = brute_paths([(t, n, p) for t, n, p, *_ in rows if t is not None and t != 10])
    got = {}
    for r in chat.best_conversations(df).collect():
        got.setdefault(r["tree"], []).append(r)
    info = {(t, n): (r or "", x or "", s or 0.0) for t, n, _, r, x, s in rows}
    assert got.keys() == want.keys()
    for t, paths in want.items():
        ranked = sorted(paths, key=lambda p: (-sum(info[t, n][2] for n in p[1]) / len(p[1]), p[0]))
        assert [r["leaf"] for r in sorted(got[t], key=lambda r: r["rank"])] == [p[0] for p in ranked]
        for r in got[t]:
            assert [(x["role"], x["text"]) for x in r["turns"]] == [info[t, n][:2] for n in dict(paths)[r["leaf"]]]
    assert {(r["tree"], r["rank"]) for r in chat.best_conversations(df, 1).collect()} == {(t, 1) for t in want}


def test_chat_query_digests(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "a<|b"), (2, 5, None, "x")], "conv_id long, turn long, role string, text string")
    turns = turns.unionByName(spark.createDataFrame([(None, 3, "user", "lost"), (None, None, "assistant", "x" * 300_000)], turns.schema)).withColumn("score", F.lit("odd"))
    out = chat.format_conversations(chat.linear_messages(turns)).withColumn("d", F.pandas_udf(chat.read_back, chat._DIGESTS)("formatted", "mask")).select("tree.*", "d.*")
    got = {None if r["none"] else r["id"]: r for r in out.collect()}
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 300_000 and got[None]["turns_sha256"] == hashlib.sha256(b"assistant\n" + b"x" * 300_000 + b"\nuser\nlost\n").hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n\nassistant\na<|b\n").hexdigest()
    assert got[1]["loss_chars"] == 4 and got[1]["loss_sha256"] == hashlib.sha256(b"a<|b").hexdigest() and got[2]["loss_chars"] == 0
    assert chat.format_conversations(chat.linear_messages(turns.limit(0))).count() == 0


def test_paths_have_no_longest_length(spark):
    rows = [(1, i, i - 1 if i else None, 1.0) for i in range(40)] + [(2, 1, 2, 1.0), (2, 2, 1, 1.0), (2, 3, 2, 1.0)]
    levels = chat.climb(spark.createDataFrame(rows, "tree long, node long, parent long, score double"))
    assert [r["n"] for r in levels[-1].where("tree = 1").orderBy("node").collect()] == list(range(1, 41))
    assert levels[-1].where("high is null and tree = 2").count() == 0
    out = chat.paths_up(spark.createDataFrame([(1, 39)], "tree long, leaf long"), levels).collect()
    assert sorted((r["tree"], r["leaf"], r["node"], r["up"]) for r in out) == [(1, 39, i, 39 - i) for i in range(40)]


def test_a_comb_spells_out_only_the_chosen_branches(spark, monkeypatch):
    """A spine of messages with a leaf at each: all its paths would be a number of rows with the square of its length."""
    n = 600
    rows = [(1, i, i - 1 if i else None, "user", f"s{i}", 0.0) for i in range(n)] + [(1, n + i, i, "assistant", f"l{i}", float(i in (3, 5))) for i in range(n)]
    made = []
    up = chat.paths_up
    monkeypatch.setattr(chat, "paths_up", lambda leaves, levels: made.append(up(leaves, levels)) or made[-1])
    got = chat.best_conversations(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), 2).collect()
    assert [(r["leaf"], r["score"], [x["text"] for x in r["turns"]]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (n + i, 1 / (i + 2), [f"s{j}" for j in range(i + 1)] + [f"l{i}"]) for i in (3, 5)]
    assert made[0].count() == 5 + 7


# --- quality


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(7)
    good = [(i, words(rng, 80) + ".", "en", "a", 0) for i in range(120)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(rng, 80).split()), "en", "a", 0) for i in range(60)]
    docs = spark.createDataFrame(good + bad, DOCS)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (99999, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, sample_rows=100)
    out = quality.score_documents(docs, model).withColumn("h", quality.held_out(F.col("doc_id"))).collect()
    assert all((r["doc_id"] < 1000) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 and (r["score"] >= quality.CUT) == (r["predicted"] == 1) for r in out)
    assert {r["doc_id"] for r in out if r["h"]} == {r[0] for r in good + bad if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train(docs, flipped, sample_rows=100).w, model.w)
    odd = odd_docs(spark)
    scored = quality.score_documents(odd, model)
    kept_columns(scored, odd, {"score", "predicted"})
    assert scored.where("score is null").count() == 0 and scored.count() == odd.count()
    nothing = quality.train(empty_docs(spark), labels.limit(0))
    assert quality.score_documents(empty_docs(spark), nothing).count() == 0


def test_bradley_terry_equals_plain_descent():
    """The fit against the same steps said plainly, one pair at a time; and its loss against the loss of a step further."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 5)).astype(np.float32)
    y = (x @ np.array([1.0, -2, 0, 0.5, 0]) + rng.standard_normal(40) * 0.3 > 0).astype(int)
    w = quality.fit_bradley_terry(x, y, seed=4, steps=30)
    good, bad = [i for i in range(40) if y[i] == 1], [i for i in range(40) if y[i] == 0]
    draw, v, m, s = np.random.default_rng(4), [0.0] * 5, [0.0] * 5, [0.0] * 5
    for step in range(1, 31):
        grad = [quality.DECAY * a for a in v]
        for i, j in zip(draw.choice(good, quality.PAIRS), draw.choice(bad, quality.PAIRS)):
            gap = [float(x[i][k] - x[j][k]) for k in range(5)]
            lost = 1 / (1 + np.exp(sum(a * b for a, b in zip(v, gap))))
            grad = [g - lost * d / quality.PAIRS for g, d in zip(grad, gap)]
        for k in range(5):
            m[k], s[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * s[k] + 0.001 * grad[k] ** 2
            v[k] -= quality.RATE * (1 - step / 31) * m[k] / (1 - 0.9**step) / ((s[k] / (1 - 0.999**step)) ** 0.5 + 1e-8)
    assert np.allclose(w, v, atol=1e-5)
    assert quality.fit_bradley_terry(x, np.ones(40, int)).any() == False  # noqa: E712
    z = x @ quality.fit_bradley_terry(x, y)
    cut = quality.quantile_cut(z, y)
    assert ((z >= cut) != (y == 1)).sum() == min(((z >= t) != (y == 1)).sum() for t in np.quantile(z, np.linspace(0, 1, 401)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables are not here")
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, quality.train(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id").where(quality.held_out(F.col("doc_id")))
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted"))), F.count(F.lit(1))).first()
    assert r[2] > 500 and r[0] > 0.97 and r[1] > 0.9


# --- masked language model


def small_vocabulary(*texts):
    return masked_lm.Vocabulary(np.bincount(np.concatenate([masked_lm.tokens_of(t) for t in texts]), minlength=masked_lm.MOST_RANKS))


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    v = small_vocabulary("the cat and the dog went to the house by the river " * 3)
    net = masked_lm.Network(v)
    net.E, net.O, net.P = (x + 0.1 * rng.standard_normal(x.shape) for x in (net.E, net.O, net.P))
    net.E[:, masked_lm.SIDE * masked_lm.HIDDEN :][:, : masked_lm.HIDDEN] = 0
    ids = rng.integers(1, 30, 30)
    target = rng.random(len(ids) - 2 * masked_lm.SIDE) < 0.7

    def loss():
        total = 0.0
        for i in np.flatnonzero(target) + masked_lm.SIDE:
            h = np.append(np.tanh(sum(net.E[ids[i + d]].reshape(-1, masked_lm.HIDDEN)[masked_lm.SIDE - d] for d in range(-masked_lm.SIDE, masked_lm.SIDE + 1))), 1)
            k, own = v.class_of[ids[i]], np.flatnonzero(v.class_of == v.class_of[ids[i]])
            z, w = net.O @ h, net.P[own] @ h
            total -= z[k] - np.log(np.exp(z).sum()) + net.P[ids[i]] @ h - np.log(np.exp(w).sum())
        return total / target.sum()

    dh, dO, dP = net.gradients(ids, target)
    rows, g = net.around(ids, dh)
    dE = np.zeros_like(net.E)
    dE[rows] = g.reshape(len(rows), -1)
    for x, gradient, some in ((net.E, dE, ids), (net.O, dO, v.class_of[ids]), (net.P, dP, ids)):
        for _ in range(8):
            i = int(rng.choice(some)), int(rng.integers(0, x.shape[1]))
            if x is net.E and i[1] // masked_lm.HIDDEN == masked_lm.SIDE:
                assert gradient[i] == 0
                continue
            old, seen = x[i], []
            for d in (1e-5, -1e-5):
                x[i] = old + d
                seen.append(loss())
            x[i] = old
            assert abs((seen[0] - seen[1]) / 2e-5 - gradient[i]) < 1e-6


def test_lm_prefers_text_in_order(spark):
    rng = random.Random(11)
    cycle = [f"word{i}" for i in range(12)]
    text = lambda n: " ".join(cycle[(s + i) % 12] for s in [rng.randrange(12)] for i in range(n))
    rows = [(i, text(4000), "en", "a", 0) for i in range(40)]
    net, _ = masked_lm.fit(spark.createDataFrame(rows, DOCS), group_tokens=60_000)
    mixed = text(400).split()
    rng.shuffle(mixed)
    probe = spark.createDataFrame([(1, text(400), "", "", 0), (2, " ".join(mixed), "", "", 0), (3, None, "", "", 0), (4, "Ünknöwn 漢字 bytes", "", "", 0)], DOCS)
    got = {r["doc_id"]: r for r in masked_lm.score_documents(probe, net).collect()}
    assert got[1]["per_token"] > got[2]["per_token"] + 0.3 and (got[3]["n_tokens"], got[3]["log_likelihood"], got[3]["per_token"]) == (0, 0.0, None)
    assert got[4]["n_tokens"] > 10 and got[4]["per_token"] < got[2]["per_token"]
    # Every token from both sides, one by one; the probabilities of all tokens sum to 1.
    v, ids = net.vocabulary, net.vocabulary.encode(rows[0][1])[:50]
    want = []
    for i in range(50):
        near = {d: ids[i + d] if 0 <= i + d < 50 else 0 for d in range(-masked_lm.SIDE, masked_lm.SIDE + 1) if d}
        h = np.append(np.tanh(sum(net.E[t].reshape(-1, masked_lm.HIDDEN)[masked_lm.SIDE - d] for d, t in near.items())), 1)
        z, every = net.O @ h, net.P @ h
        log = np.array([z[v.class_of[t]] - np.log(np.exp(z).sum()) + every[t] - np.log(np.exp(every[v.class_of == v.class_of[t]]).sum()) for t in range(v.size)])
        assert abs(np.exp(log).sum() - 1) < 1e-3
        want.append(log[ids[i]])
    assert np.allclose(net.log_probabilities(ids), want, atol=1e-3)


def test_lm_odd(spark):
    odd = odd_docs(spark)
    net, encoded = masked_lm.fit(odd)
    out = masked_lm.score_documents(odd, net, encoded=encoded)
    kept_columns(out, odd, {"n_tokens", "log_likelihood", "per_token"})
    key = lambda df: sorted((r["doc_id"] or 0, r["n_tokens"], round(r["log_likelihood"], 1)) for r in df.collect())
    assert key(out) == key(masked_lm.score_documents(odd, net))
    assert out.where("n_tokens > 30000 and per_token < 0").count() == 1
    assert len({(r["n_tokens"], round(r["log_likelihood"], 2)) for r in out.where("text = 'same text here now'").collect()}) == 1
    none = empty_docs(spark)
    net, encoded = masked_lm.fit(none)
    assert masked_lm.score_documents(none, net).count() == masked_lm.score_documents(none, net, encoded=encoded).count() == 0


def test_lm_learns_from_every_token_whatever_the_partitions(spark):
    rows = [(i, words(random.Random(i), 50 + i, 3000), "en", "a", 0) for i in range(60)] + [(99, words(random.Random(1), 1500, 90), "en", "a", 0)] + [(7, "a hot text", "en", "a", 0)] * 500
    docs = spark.createDataFrame(rows, DOCS)
    tokens = sum(len(masked_lm.tokens_of(r[1])) for r in rows)
    # Two stretches of a text hold it whole, each with what stands around it.
    encoded = masked_lm.encode_documents(docs, segment=500)
    assert encoded.agg(F.sum("n")).first()[0] == tokens and encoded.agg(F.max("segment")).first()[0] > 5
    dealt = masked_lm.deal_groups(encoded, 11, 1000, 3)
    assert dealt.agg(F.sum(F.col("n") * F.col("times"))).first()[0] == tokens
    per = {r["g"]: r["t"] for r in dealt.groupBy("g").agg(F.sum(F.col("n") * F.col("times")).alias("t")).collect()}
    assert set(per) <= set(range(11)) and max(per.values()) < 4 * tokens / 11
    assert len({r["g"] for r in dealt.where(F.col("n") == len(masked_lm.tokens_of("a hot text"))).collect()}) == 11
    a = masked_lm.fit(docs, group_tokens=1000)[0].pack()
    b = masked_lm.fit(docs.repartition(7), group_tokens=1000)[0].pack()
    assert np.array_equal(a, b) and not np.array_equal(a, masked_lm.Network(small_vocabulary("x")).pack()[: len(a)])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_lm_beats_the_unigram_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    net, encoded = masked_lm.fit(docs)
    ids = np.concatenate([net.vocabulary.encode(r["text"]) for r in docs.collect()])
    got = masked_lm.score_documents(docs, net, encoded=encoded).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    assert got[1] == len(ids) and got[0] / got[1] > net.vocabulary.unigram()[ids].mean() + 1


def test_rounds_grow_with_the_corpus():
    assert masked_lm.round_ends(1) == [1] and masked_lm.round_ends(3) == [1, 3] and masked_lm.round_ends(100) == [1, 4, 16, 64, 100]
    assert len(masked_lm.round_ends(10**7)) > len(masked_lm.round_ends(10**4)) > 5


def test_changes_travel_in_half_precision():
    v = small_vocabulary("the cat sat on the mat and the dog sat too")
    net, start = masked_lm.Network(v), masked_lm.Network(v).pack()
    rng = np.random.default_rng(3)
    ids = rng.integers(1, v.size, 400)
    masked_lm.learn(net, ids, np.ones(400, bool))
    change = np.frombuffer(net.change(start), np.float16).astype(np.float32)
    assert len(net.change(start)) == 2 * len(start) and np.abs(start + change - net.pack()).max() <= 1e-3 * np.abs(net.pack() - start).max()


# --- url filter


def test_aliases_and_precedence(spark):
    link = lambda u: f'<LINK href="{u}" rel=canonical>'
    rows = [
        (1, "http://A.com/en/1?x", None), (2, "https://b.net/p", link("http://a.com/en/1")), (3, "https://c.net/q", "<meta http-equiv='Refresh' content='0; URL=https://b.net/p#z'>"),
        (4, "http://x.example.com/en/77", link("//c.net/q")), (5, None, "x"), (6, "no scheme", link("http://a.com/en/1")), (7, "http://acom/en/1", None),
        (8, "http://s.example.net/de/8", None), (9, "http://s.example.net/de/9", None), (10, "http://q.org", link("/same")), (11, "http://q.org/same", link("http://only.com/en/target")), (2, "https://b.net/p", None),
    ]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    out = url_filter.filter_urls(pages)
    kept_columns(out, pages, {"host", "path", "rule", "verdict", "verdict_by"})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["verdict_by"]) for r in out.collect()}
    assert got[1] == ("a.com", "/en/1", "com/en/", "block", "rule") and got[2][2:] == (None, "block", "alias") and got[3][2:] == (None, "block", "alias")
    assert got[4][2:] == ("example.com/en/7", "allow", "rule") and got[5] == got[6] == ("", "", None, "allow", "default") and got[7][2:] == (None, "allow", "default")
    assert got[8][2:] == ("example.net/de/8", "block", "rule") and got[9][2:] == ("net/de/", "allow", "rule")
    assert got[10][2:] == (None, "block", "alias") and got[11][2:] == (None, "block", "alias") and out.count() == 12
    more = spark.createDataFrame([("http://acom/en/1", "http://a.com/en/1")], "from_url string, to_url string")
    assert {r["verdict"] for r in url_filter.filter_urls(pages, redirects=more).where("page_id = 7").collect()} == {"block"}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_rule_tables_find_what_rule_lists_find(spark):
    rng = random.Random(53)
    part = lambda: rng.choice(["a", "b", "ab", "c.a"])
    rules = [*url_filter.RULES, *((rng.choice(["block", "allow"]), part(), rng.choice(["", "/", "/x", "/x/y"])) for _ in range(12))]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = [f"http://{part()}.{part()}/{rng.choice(['', 'x', 'x/y/z'])}" for _ in range(80)] + ["http://www.example.com/en/77", "http://EXAMPLE.com/en/8?q", "http://com", None, "none", "http://" + "a." * 3000 + "a/x" + "y" * 5000]
    pages = spark.createDataFrame([(i, u, "x" * (200_000 if i == 3 else 0)) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumns({"_h": F.lit("h"), "a.b": F.lit(1)})
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    out = url_filter.filter_urls(pages, rules=table)
    kept_columns(out, pages, {"host", "path", "rule", "verdict", "verdict_by"})
    key = lambda df: sorted((r["page_id"], r["rule"], r["verdict"], r["verdict_by"]) for r in df.collect())
    assert key(out) == key(url_filter.filter_urls(pages, rules=rules)) and url_filter.filter_urls(pages.limit(0), rules=table).count() == 0
    assert url_filter.filter_urls(pages, rules=table.limit(0)).where("rule is not null").count() == 0


def test_links_lead_where_the_sql_says(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(59)
    targets = ["page2.html", "../x", "./", "..", "/en/1", "/a/../b/.", "", "#top", "?q=1", "//other.org/es/2", "HTTP://Up.Org/es/../es/3", "mailto:x@y", "javascript:void(0)", "http://example.com/en/7", "a//b", "&amp;x", "https://www.com"]
    tag = lambda t: rng.choice([f'<link rel="canonical" href="{t}">', f"<LINK href='{t}' rel='shortlink Canonical'/>", f'<meta http-equiv="refresh" content="0; url={t}">', f'<link rel="stylesheet" href="{t}">', f"<link rel=canonical href={t or chr(34) * 2} >"])
    base = lambda: rng.choice(["", "", '<base href="/base/dir/">', '<base target="x"><base href="http://b.net/de/9/z">', '<base href="up/">', '<base href="mailto:x">'])
    urls = [f"http://{h}/{p}" for h in ("a.com", "example.com", "x.example.net", "q.org", "other.org") for p in ("en/1", "en/7/8", "de/8", "", "x/page2.html", "base/dir/x")] + ["http://h.com", None, "relative", "http:///nohost"]
    rows = [(i, u, rng.choice([None, "", base() + tag(rng.choice(targets)) + (tag(rng.choice(targets)) if i % 5 == 0 else "")]) if i % 9 == 0 else base() + tag(rng.choice(targets))) for i, u in enumerate(urls * 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(repr, map(tuple, url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "verdict_by").collect())))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert got == sorted(map(repr, con.execute(url_filter.SQL).fetchall()))
    assert sum("'alias'" in r for r in got) > 5


def test_relative_targets_are_resolved(spark):
    link = lambda u, rel='"shortlink canonical"': f"<link rel={rel} href='{u}'>"
    rows = [
        (1, "https://a.net/x/y.html", link("bad.html")), (2, "https://b.net/x/y/z", link("../bad?q", "canonical")), (3, "https://c.net", "<meta http-equiv=refresh content='0;url=bad.html'>"),
        (4, "https://d.net/x", '<BASE href="/deep/er/">' + link("./bad")), (5, "https://e.net/x", link("mailto:a@b.net/bad")), (6, "https://f.net/x/", link("/go?u=http://a.net/x/bad.html")),
        (7, "https://g.net/x", link("bad", '"not-canonical"')), (8, "https://h.net/x/y", link("../../../bad/..")), (9, "https://i.net/x", link("https://b.net/q/../x/bad")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["a"], r["b"]) for r in url_filter.alias_edges(pages).collect()}
    assert got == {("a.net/x/y.html", "a.net/x/bad.html"), ("b.net/x/y/z", "b.net/x/bad"), ("c.net", "c.net/bad.html"), ("d.net/x", "d.net/deep/er/bad"),
                   ("f.net/x/", "f.net/go"), ("h.net/x/y", "h.net/"), ("i.net/x", "b.net/x/bad")}
    rules = (("block", "a.net", "/x/bad"),)
    assert {r["page_id"] for r in url_filter.filter_urls(pages, rules=rules).where("verdict = 'block'").collect()} == {1}


# --- sharding


def test_jump_hash_is_consistent():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for n in (1, 2, 7, 40):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((b == a) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.02 and a.min() >= 0 and a.max() < n


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s)) for s in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1150 and list(sharding.fisher_yates(0, 1)) == [] and list(sharding.fisher_yates(1, 1)) == [0]


def test_shards_are_whole_and_gapless(spark):
    rows = [(i % 200, words(random.Random(i), 5), "en", "a", i) for i in range(900)] + [(7, "hot", "en", "a", 0)] * 500
    docs = spark.createDataFrame(rows, DOCS)
    got = sharding.shard_documents(docs, n_shards=5, bucket_bytes=600).collect()
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got) == Counter((r[0], r[1], r[4]) for r in rows)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    for k, of in itertools.groupby(sorted(got, key=lambda r: r["doc_id"]), key=lambda r: r["doc_id"]):
        assert len({r["shard"] for r in of}) == 1
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got)
    columns = ["doc_id", "text", "n_chars", "shard", "slot", "grown_shard"]
    other = sharding.shard_documents(docs.repartition(7), n_shards=5, bucket_bytes=600).collect()
    assert Counter(tuple(r[c] for c in columns) for r in other) == Counter(tuple(r[c] for c in columns) for r in got)
    layout = sharding.Layout(docs, "doc_id", "text", 5, 600, 1)
    buckets = sharding.scatter(docs, layout, "doc_id", 5, 1).groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_doc.text") + 16).alias("size")).collect()
    assert layout.heavy.count() == 1 and {(r["_shard"], r["_bucket"]): r["n"] for r in buckets} == {(r["_shard"], r["_bucket"]): r["_count"] for r in layout.starts.collect()}
    per = Counter(r["_shard"] for r in buckets)
    assert sum(layout.buckets) >= len(buckets) and len(set(per.values())) > 1 and all(r["size"] < 1500 for r in buckets)


def test_slots_equal_brute_force(spark):
    """Buckets in turn; in each the order by content hash, then permuted."""
    rows = [(i, words(random.Random(i), 5), "en", None if i % 3 else "a", i) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs, n_shards=3, bucket_bytes=900).collect()}
    keys = docs.select("doc_id", F.xxhash64(F.lit(sharding.SEED), F.col("doc_id").cast("string")).alias("k")).collect()
    shard = dict(zip((r["doc_id"] for r in keys), sharding.jump_hash(np.array([r["k"] for r in keys]).view(np.uint64), 3).tolist()))
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in docs.columns))
    hashes = docs.select("doc_id", *(F.xxhash64(F.lit(n), nulls, *docs.columns).alias(f"h{n}") for n in (11, 13)))
    hashes = hashes.withColumns({"b": F.xxhash64(F.lit(sharding.SEED + 2), "h11", "h13"), "t": F.xxhash64(F.lit(sharding.SEED + 1), "h11", "h13")}).collect()
    size = Counter()
    for i, t, *_ in rows:
        size[shard[i]] += len(t) + 16
    want = {}
    for s in range(3):
        n_buckets, start = -(-size[s] // 900), 0
        for b in range(n_buckets):
            own = sorted((r for r in hashes if shard[r["doc_id"]] == s and r["b"] % n_buckets == b), key=lambda r: (r["t"], r["h11"], r["h13"]))
            order = sharding.fisher_yates(len(own), sharding.SEED * 1_000_003 + s * 1_009 + b * 7_919_113)
            want |= {own[j]["doc_id"]: (s, start + i) for i, j in enumerate(order)}
            start += len(own)
    assert got == want


def test_sharding_odd(spark, tmp_path):
    docs = odd_docs(spark)
    out = sharding.shard_documents(docs, n_shards=3)
    kept_columns(out, docs, {"shard", "slot", "grown_shard"})
    assert out.count() == docs.count() and sharding.shard_documents(empty_docs(spark)).count() == 0
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# --- decontamination


def items_and_index():
    rng = random.Random(13)
    items = [(i, " ".join(f"t{rng.randrange(150)}" for _ in range(rng.randrange(6, 40)))) for i in range(60)]
    return rng, items, decontam.build_index([(i, *decontam.split_item(t)) for i, t in items])


def test_wand_equals_full_scores():
    rng, items, ix = items_and_index()
    impact = np.zeros((len(ix.terms), len(ix.item_ids)))
    for t in range(len(ix.terms)):
        impact[t, ix.items[ix.at[t] : ix.at[t + 1]]] = ix.impacts[ix.at[t] : ix.at[t + 1]]
    assert np.allclose([impact[sorted({ix.terms[w] for w in q + a}), d].sum() for d, (q, a) in enumerate(ix.parts)], 1)
    for k in range(200):
        q = sorted(rng.sample(range(len(ix.terms)), rng.randrange(0, 60)))
        s = impact[q].sum(0) if q else np.zeros(len(ix.item_ids))
        for threshold in (0.2, 0.5):
            assert {(i, round(v, 9)) for i, v in decontam.wand(ix, q, threshold)} == {(i, round(v, 9)) for i, v in enumerate(s) if v >= threshold - 1e-9}
    # The bounds never lose a passage that reaches the threshold.
    docs = [[f"t{rng.randrange(200)}".encode() for _ in range(rng.randrange(0, 400))] for _ in range(30)]
    found = {(d, start, i) for d, start, _, q, blocks in decontam.candidate_windows(ix, docs, 0.5) for i, _ in decontam.wand(ix, q, 0.5, blocks)}
    want = set()
    for d, x in enumerate(docs):
        for start in range(0, max(len(x), 1), ix.longest):
            if start and start + ix.longest >= len(x):
                continue
            q = sorted({ix.terms[w] for w in x[start : start + 2 * ix.longest] if w in ix.terms})
            want |= {(d, start, int(i)) for i in np.flatnonzero(impact[q].sum(0) >= 0.5)} if q else set()
    assert found == want


def test_leaks_are_found_and_clean_stays(spark):
    rng, items, _ = items_and_index()
    noise = lambda n: " ".join(f"t{rng.randrange(150)}" for _ in range(n))
    rows, want = [], set()
    for i, t in items:
        w = t.split()
        if len(w) > 14:
            w[len(w) // 2] = "changed"
        rows.append((i, f"{noise(rng.randrange(300))} {' '.join(w).upper()}, {noise(rng.randrange(90))}"))
        want.add((i, i))
    rows += [(1000 + i, noise(500)) for i in range(40)] + [(2000 + i, " ".join(t.split()[: len(t.split()) // 2])) for i, t in items if len(t.split()) > 12]
    rows += [(None, items[0][1]), (3000, None), (3001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (None, "x y z")], "item_id long, text string")
    every = []
    for how in ({}, {"index_bytes": 2000}):
        every.append({(r["key"], r["item_id"]): (round(r["score"], 9), r["overlap"]) for r in decontam.find_leaks(docs, bench, **how).collect()})
        assert set(every[-1]) == want | {(None, 0)}
    # Parts of a benchmark give what one index gives, score for score.
    assert every[0] == every[1]
    two = spark.createDataFrame([(i, *decontam.split_item(t)) for i, t in items], "ITEM_ID long, Question string, answer string").withColumn("text", F.lit(None).cast("string"))
    assert {(r["key"], r["item_id"]) for r in decontam.find_leaks(docs, two).collect()} == want | {(None, 0)}
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), bench).count() == 0
    odd = odd_docs(spark)
    kept = decontam.clean_documents(odd, spark.createDataFrame([(1, "same text here now")], "item_id long, text string"))
    kept_columns(kept, odd, set())
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 6, 8]
    assert decontam.split_item("Why so? Because it is.") == ("Why so? ", "Because it is.")


def test_long_items_have_passages_of_their_own(spark):
    rng = random.Random(43)
    text = lambda n: " ".join(f"t{rng.randrange(4000)}" for _ in range(n))
    items = [(i, text(30)) for i in range(20)] + [(100, text(3000)), (101, text(400))]
    assert [x.longest for x in decontam.build_indexes([(i, *decontam.split_item(t)) for i, t in items])] == [30, 400, 3000]
    rows = [(i, f"{text(500)} {t} {text(2000)}") for i, t in items] + [(900, text(9000))]
    leaks = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["key"], r["item_id"]) for r in leaks} == {(i, i) for i, _ in items}


def test_leaks_go_row_by_row(spark):
    _, items, _ = items_and_index()
    bench = spark.createDataFrame(items, "item_id long, text string")
    shared = spark.createDataFrame([(None, items[0][1]), (None, "clean"), (5, items[1][1]), (5, "clean too"), (6, None)], "doc_id long, text string")
    assert sorted(map(str, (r["text"] for r in decontam.clean_documents(shared, bench).collect()))) == ["None", "clean", "clean too"]


# --- fertility


def brute_fertility(text, table):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    ids = [i for w in ws for i in table.pieces.encode(w)]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = set()
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    n = len(ids)
    entropy = -sum(c / n * np.log2(c / n) for c in Counter(ids).values()) / np.log2(n) if n > 1 else 1.0 if n else None
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n, sum(map(len, ws)) / n if n else None, sum(map(table.pieces.is_byte, ids)) / n if n else None, entropy)


def test_fertility_equals_brute_force(spark):
    rng = random.Random(17)
    texts = [words(rng, rng.randrange(0, 60), 12) for _ in range(40)] + ["", " \n ", "a\x1cb c\xa0d", "é漢字🙂 " * 6, "one # two | <x>\nsame\nsame\n \nsame", "кот и пёс " * 3, "a b c d e a b c d e f a b c d e"]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(900, None, None, None, 0)], DOCS)
    table = fertility.Words(fertility.TOKENIZERS)
    for r in fertility.fertility_rules(docs).collect():
        t = texts[r["id"]] if r["id"] < 900 else ""
        want = brute_fertility(t, table)
        got = [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "token_entropy")]
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(got, want)), (t, got, want)
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_fertility_verdicts_equal_brute_force(spark):
    rng = random.Random(47)
    pools = {"en": [f"word{i}" for i in range(40)], "de": [f"längeres{i}wort" for i in range(40)], None: [f"w{i}" for i in range(30)]}
    rows = [(i, " ".join(rng.choice(pools[g]) for _ in range(rng.randrange(5, 120))), g, "a", 0) for i, g in enumerate(rng.choices(list(pools), [60, 20, 3], k=250))]
    rows += [(900, "слово за слово " * 20, "ru", "a", 0), (901, " ".join(f"слово{i}" for i in range(50)), "ru", "a", 0), (902, "漢字 " * 50 + "x", None, "a", 0), (903, None, None, None, 0)]
    got = fertility.fertility_rules(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    lang = {r[0]: r[2] for r in rows}
    names, usable = list(fertility.FLOORS), [r for r in got if not r["base_failed"]]
    near = lambda v: round(v * fertility.STEPS + 1e-9) / fertility.STEPS
    median = lambda vs: sorted(map(near, vs))[(len(vs) - 1) // 2]

    def band(group):
        out = {}
        for c in names:
            mid = median([r[c] for r in group])
            off = median([abs(r[c] - mid) for r in group])
            out[c] = (mid, max(off * 1.4826, fertility.FLOORS[c]) * fertility.SPREAD)
        return out

    def drawn(own, n, parent):
        return {c: tuple((a * n + b * fertility.PRIOR_DOCS) / (n + fertility.PRIOR_DOCS) for a, b in zip(own[c], parent[c])) for c in names}

    every = band(usable)
    for r in got:
        if r["base_failed"]:
            assert not r["kept"]
            continue
        of_script = [x for x in usable if x["script"] == r["script"]]
        own = [x for x in of_script if lang[x["id"]] == lang[r["id"]]]
        mine = drawn(band(own), len(own), drawn(band(of_script), len(of_script), every))
        slack = max(1.0, fertility.FULL_TOKENS / max(r["n_tokens"], 1)) ** 0.5
        gap = {c: (r[c] - mine[c][0]) / (mine[c][1] * slack) for c in names}
        if min(abs(abs(g) - 1) for g in gap.values()) > 2e-3:
            assert r["kept"] == (abs(gap["chars_per_token"]) <= 1 and abs(gap["chars_per_unit"]) <= 1 and gap["byte_share"] <= 1 and gap["token_entropy"] >= -1), (r, gap)
    assert 0 < sum(r["kept"] for r in got) < len(usable)


def test_fertility_bands_reject_what_is_unlike(spark):
    rng = random.Random(19)
    pool = "the house stands near river where people walk every morning under tall green trees while children play".split()
    text = lambda: " ".join(rng.choice(pool) for _ in range(80))
    rows = [(i, text(), "en", "a", 0) for i in range(100)] + [(500, " ".join(chr(0x13000 + rng.randrange(900)) * 3 for _ in range(80)), "en", "a", 0), (501, " ".join(w + "###" for w in text().split()), "en", "a", 0)]
    got = {r["id"]: r["kept"] for r in fertility.fertility_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] for i in range(100)) and not got[501]
    assert fertility.fertility_rules(odd_docs(spark)).count() == 10 and fertility.fertility_rules(empty_docs(spark)).count() == 0


# --- near-dedup


def brute_components(rows, size=5, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(sets, 2):
        for a in sets[x]:
            for b in sets[y]:
                if a and 100 * len(a & b) >= percent * len(a | b):
                    p, q = root(x), root(y)
                    parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def near_rows():
    rng = random.Random(23)
    base = [words(rng, 60, 400).split() for _ in range(4)]
    passage = words(rng, 55, 400)
    rows = []
    for g, b in enumerate(base):
        for _ in range(25):
            w = list(b)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    rows += [f"{passage} {words(rng, 20, 5000)}" for _ in range(40)] + ["one", "one", "One two", "one two", "", None, " \t", "one two three"]
    chain = words(rng, 200, 5000).split()
    rows += [" ".join(chain[k * 4 : k * 4 + 100]) for k in range(20)]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_dup_components_equal_brute_force(spark, size, percent):
    rows = near_rows() + [(1, "repeated key other text of its own"), (4, None)]
    want = brute_components(rows, size, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dup.near_dups(docs, shingle=size, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want and len(out) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(29)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.5, 0.85):
        n = int(200 * share * 2 / (1 + share))
        a, b = x[:200], x[200 - n : 400 - n]
        true = n / (400 - n)
        s = near_dup.sketch([a, b], 2048)
        assert abs((s[0] == s[1]).mean() - true) < 0.05
    s = near_dup.sketch([x[:1], x[:0], x[:2]], 64)
    assert (s[[0, 2]] < np.iinfo(np.uint64).max).all() and (s[1] == 0).all()
    # A set's sketch doesn't depend on its batch.
    assert np.array_equal(near_dup.sketch([x[:50], x], 64)[0], near_dup.sketch([x[:50]], 64)[0])


def test_near_dup_odd(spark):
    docs = odd_docs(spark)
    for f in (near_dup.near_dups, fertility.fertility_rules, lambda d: decontam.find_leaks(d, spark.createDataFrame([(1, "x")], "item_id long, text string"))):
        with pytest.raises(ValueError, match="whole number"):
            f(docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    out = near_dup.near_dups(docs)
    kept_columns(out, docs, {"n_shingles", "component_id", "kept"})
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in out.collect()}
    assert got[7] == (1, False) and got[None] == (None, True) and got[2] == (2, True) and got[3] == (3, True)
    kept = near_dup.keep_rows(docs)
    kept_columns(kept, docs, set())
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]
    assert near_dup.near_dups(empty_docs(spark)).count() == 0


def test_keep_rows_judges_texts_not_keys(spark):
    rng = random.Random(31)
    a, b, c, d = (words(rng, 60, 5000) for _ in range(4))
    rows = [(7, a), (7, b), (7, c), (7, ""), (7, b), (None, a), (None, d), (None, d.upper()), (3, b + " x"), (9, None), (9, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in near_dup.keep_rows(docs).collect())
    upper = [x for x in got if x[0] is None and x[1].lower() == d]
    assert len(upper) == 1 and got.pop(upper[0]) == 1
    assert got == Counter([(7, a), (7, c), (7, ""), (3, b + " x"), (9, None), (9, None), (None, " ")])
    assert near_dup.keep_rows(docs.limit(0)).count() == 0
    # Of one key's texts with equally many shingles, each finds its copies.
    twins = spark.createDataFrame([(1, a), (1, b), (2, a + " y"), (3, b + " y"), (4, c)], "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in near_dup.near_dup_components(twins).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_near_dups_judge_rows_without_key(spark):
    rng = random.Random(37)
    a, b, c = (words(rng, 60, 5000) for _ in range(3))
    rows = [(5, a), (None, a + " x"), (3, a + " x y"), (None, b), (None, b), (None, None), (None, ""), (8, c), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dup.near_dup_components(docs)
    got = Counter((r["id"], r["component_id"]) for r in out.collect())
    assert got == Counter({(5, 3): 1, (None, 3): 1, (3, 3): 1, (None, None): 4, (8, 8): 1, (9, 9): 1})
    kept = Counter((r["doc_id"], r["kept"]) for r in near_dup.near_dups(docs).collect())
    assert kept == Counter({(5, False): 1, (None, False): 1, (3, True): 1, (None, True): 4, (8, True): 1, (9, True): 1})


def test_texts_of_one_64_bit_hash_are_told_apart(spark, monkeypatch):
    rng = random.Random(41)
    items = spark.createDataFrame([(1, words(rng, 30, 5000))], "item_id long, text string")
    leak = items.first()["text"]
    rows = [(i, words(rng, 60, 5000)) for i in range(6)] + [(6, f"so {leak} it is"), (7, None), (None, "a few other words")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    for module in (near_dup, decontam):
        monkeypatch.setattr(module, "hash128", lambda c: (F.lit(1).cast("long"), F.xxhash64(F.lit(7), c)))
    assert Counter(map(tuple, near_dup.keep_rows(docs).collect())) == Counter(rows)
    assert Counter(map(tuple, decontam.clean_documents(docs, items).collect())) == Counter([r for r in rows + rows[:2] if r[0] != 6])
    odd = docs.withColumnsRenamed({"text": "a.b", "doc_id": "x`y"})
    assert near_dup.keep_rows(odd, "x`y", "a.b").count() == len(rows)


# --- mixing


def test_exponent_meets_targets(spark):
    tokens = [1000, 400, 90, 10]
    t = spark.createDataFrame([((False, f"s{i}"), n, n, n / 1500) for i, n in enumerate(tokens)], "_src struct<none:boolean,name:string>, tokens long, docs long, share double")
    p = np.array(tokens) / sum(tokens)
    a = mixing.find_exponent(t, max_repeats=3.0)
    assert abs((p.max() / p.min()) ** (1 - a) - 3) < 1e-3
    a = mixing.find_exponent(t, target_entropy=0.9)
    q = p**a / (p**a).sum()
    assert abs(-(q * np.log(q)).sum() - 0.9 * np.log(4)) < 1e-3
    assert mixing.find_exponent(t, max_repeats=1e9) == 0.0 and mixing.find_exponent(t.limit(0)) == 1.0


def test_mix_meets_quotas_and_keeps_all(spark):
    rng = random.Random(31)
    rows = [(i, words(rng, rng.randrange(1, 9)), "en", s, 0) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + [None] * 30)] + [(5000, "same", "en", "b", 0)] * 4 + [(5001, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for budget in (None, 900):
        got = mixing.mix_sources(docs, block_docs=16, budget_tokens=budget, max_repeats=2.0).collect()
        size = lambda t: max(1, len((t or "").split()))
        have = Counter()
        for _, t, _, s, _ in rows:
            have[s] += size(t)
        share = {s: n / sum(have.values()) for s, n in have.items()}
        a = next(i / 10_000 for i in range(10_001) if (max(share.values()) / min(share.values())) ** (1 - i / 10_000) <= 2.0)
        raised = {s: x**a for s, x in share.items()}
        total = budget or max(have[s] / raised[s] for s in have) * sum(raised.values())
        took = Counter()
        for r in got:
            took[r["source"]] += size(r["text"])
        for s in have:
            quota = total * raised[s] / sum(raised.values())
            assert quota - 1 <= took[s] <= quota * 1.001 + 4 * 9
        per = Counter(r["doc_id"] for r in got)
        for s in have:
            n = [per[r[0]] // (4 if r[0] == 5000 else 1) for r in rows if r[3] == s]
            assert max(n) - min(n) <= 1
        if budget is None:
            assert set(per) == {r[0] for r in rows}
    again = mixing.mix_sources(docs.repartition(5), block_docs=16, budget_tokens=900)
    whole = lambda rs: Counter((r["doc_id"], r["mix_epoch"], r["mix_block"], r["mix_order"]) for r in rs)
    assert whole(again.collect()) == whole(got)


def test_mix_order_is_permuted_blocks(spark):
    rows = [(i, words(random.Random(i), 4), "en", s, 0) for i, s in enumerate(["a"] * 400 + ["b"] * 100)]
    got = sorted(mixing.mix_sources(spark.createDataFrame(rows, DOCS), block_docs=20, max_repeats=1.5).collect(), key=lambda r: r["mix_order"])
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        for epoch, of in itertools.groupby(own, key=lambda r: r["mix_epoch"]):
            blocks = [b for b, _ in itertools.groupby(of, key=lambda r: r["mix_block"])]
            assert len(blocks) == len(set(blocks)) and (len(blocks) < 3 or blocks != sorted(blocks))
        assert [r["mix_epoch"] for r in own] == sorted(r["mix_epoch"] for r in own)
    orders = [[r["doc_id"] for r in got if r["source"] == "b" and r["mix_epoch"] == e] for e in (0, 1)]
    assert orders[0] != orders[1] and set(orders[1]) <= set(orders[0])
    # Every stretch of the mix holds the sources by their weights.
    weight = {r["source"]: r["mix_weight"] for r in got}
    for at in range(0, len(got) - 200, 100):
        assert abs(sum(r["source"] == "b" for r in got[at : at + 200]) / 200 - weight["b"]) < 0.08


def test_large_groups_of_copies_are_split(spark, monkeypatch):
    rows = [(i, words(random.Random(i), 6), "en", "a" if i % 2 else "b", 0) for i in range(100)] + [(7, "hot row of five words", None, "a", 0)] * 300
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(mixing, "UNIT_TOKENS", 20)
    monkeypatch.setattr(mixing, "SALT_CHUNKS", 7)
    got = mixing.mix_sources(docs, block_docs=25).collect()
    assert Counter(r["doc_id"] for r in got if r["mix_epoch"] == 0) == Counter(r[0] for r in rows)
    assert len({r["mix_block"] for r in got if r["text"][:3] == "hot"}) > 8


def test_row_hash_tells_nulls_apart(spark):
    from loomgraph.llm.common import row_hash

    df = spark.createDataFrame([(None, "x", None, [1, None]), ("x", None, None, [1, None]), ("x", None, {"a": None}, [1, None]), ("x", None, {}, [1, None]), ("x", None, {}, [None, 1])], "a string, `b.c` string, m map<string,int>, l array<int>")
    assert len({tuple(r) for r in df.select(*row_hash(df)).collect()}) == 5


def test_mixing_odd(spark):
    docs = odd_docs(spark)
    out = mixing.mix_sources(docs)
    kept_columns(out, docs, {"mix_epoch", "mix_block", "mix_order", "mix_weight", "mix_quota"})
    assert {r["doc_id"] for r in out.collect()} == {None, 1, 2, 3, 4, 5, 6, 7, 8} and mixing.mix_sources(empty_docs(spark)).count() == 0
