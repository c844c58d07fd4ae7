"""Source divergence audit against fractions and regular expressions; the tokenizer against both."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import divergence as div

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [t.translate(bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))) for t in TERM.findall((text or "").encode())]


def by_hand(rows, min_docs, top):
    """rows: (text, lang, source)."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for t, lang, s in rows:
        lang, s = lang or "", s or ""
        groups.add((lang, s))
        found = terms_of(t)
        docs[lang].update(set(found))
        count[lang, s].update(found)
        count[lang].update(found)
    out = []
    for lang, s in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)

        def p(who):
            n = sum(count[who][t] for t in kept)
            return {t: 1 + 10**9 * (count[who][t] + 2) // (n + 2 * v) for t in kept}

        f = lambda a, b: (a - b) * (a - b) // (a + b)
        own, all_ = p((lang, s)), p(lang)
        pairs = [(sum(f(own[t], q[t]) for t in kept), o.encode()) for a, o in groups if a == lang and o != s for q in [p((lang, o))]]
        more = [(f(own[t], all_[t]), t) for t in kept if count[lang, s][t] and own[t] > all_[t]]
        for part, items, most in (("pair", pairs, None), ("term", more, top)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1]))[:most], 1):
                out.append((lang, s, part, item.decode(), value, rank))
    return sorted(out)


def corpus(seed=4, n=300, sources=9):
    rng = np.random.default_rng(seed)
    words = ["The", "a", "Été", "été", "漢字", "naïve", "x" * 70 + "y", "x" * 70 + "z", "MiXeD", "mixed", "rare"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        s = int(rng.zipf(1.5)) % sources
        text = "".join(words[(int(rng.zipf(1.3)) + s) % len(words)] + [" ", "\n", "1", "_", "'", "\x00", "--"][int(rng.integers(0, 7))] for _ in range(int(rng.integers(0, 25))))
        rows.append((text, ["en", "de", None, ""][int(rng.integers(0, 4))], f"s{s}"))
    return rows + [(None, "en", "empty"), ("12 34", "en", None), ("", "fr", "a"), ("only once", "fr", "b"), ("only once", "fr", "b")]


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").select("*", F.lit(1).alias("term"), F.lit(2).alias("n"), F.lit(3).alias("a.b"))
    want = by_hand(rows, 10, 10)
    assert collected(div.audit_sources(docs.repartition(5))) == want
    # Small blocks, and so many tiles that most pairs of sources lie in two.
    for name, value in (("TILE", 2), ("BLOCK_TERMS", 3)):
        monkeypatch.setattr(div, name, value)
    assert collected(div.audit_sources(docs.repartition(2))) == want
    assert collected(div.audit_sources(docs, min_docs=3, top=2)) == by_hand(rows, 3, 2)
    assert collected(div.audit_sources(docs, min_docs=10_000)) == by_hand(rows, 10_000, 10)
    assert collected(div.audit_sources(docs.where("false"))) == []


def test_hot_source_and_long_text(spark):
    rows = [("the cat", "en", "hot")] * 400 + [("the dog " * 50_000 + "end", "en", "long")] + [(f"the cow {'q' * i}", "en", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert collected(div.audit_sources(docs, min_docs=2)) == by_hand(rows, 2, 10)


def test_tokenizer_finds_what_the_pattern_finds():
    texts = [t or "" for t, _, _ in corpus(9)] + ["abc", "def", "", "É" * 100, "a" * 64, "a" * 65, "A" * 65]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(t) for t in raw])
    data, starts, ends = div.bounds(np.frombuffer(b"".join(raw), np.uint8), offsets)
    got = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert got == [t for text in texts for t in terms_of(text)]
    # Any hash will do: terms of one hash are told apart by their bytes.
    want = Counter(got)
    for digest in (div.xxhash.xxh3_64_intdigest, lambda b: 1, lambda b: len(b) % 2, lambda b: b[0]):
        order, new = div.grouped(data, starts, ends, digest)
        first = np.flatnonzero(new)
        assert Counter({got[i]: n for i, n in zip(order[first], np.diff(first, append=len(new)))}) == want
        assert all(got[order[i]] == got[order[i - 1]] for i in np.flatnonzero(~new))


def test_shares_are_exact_beyond_64_bits(spark):
    rng = np.random.default_rng(2)
    whole = rng.integers(10, 9 * 10**15, 200)
    count = (whole * rng.random(200)).astype(np.int64) - 2
    count = np.maximum(count, 0)
    want = [1 + 10**9 * (int(c) + 2) // int(w) for c, w in zip(count, whole)]
    assert div.shares(count, whole).tolist() == want
    df = spark.createDataFrame([(i, int(c), int(w) - 4) for i, (c, w) in enumerate(zip(count, whole))], "i int, c long, w long")
    got = df.select("i", div.share(F.col("c"), F.col("w"), F.lit(2).cast("long")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == want
