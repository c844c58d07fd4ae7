"""Which document stands where in a mix, worked out once more in plain Python from the rows' hashes."""

import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import mixing
from loomgraph.llm.common import row_hash


def spark_hash(*values):
    """Spark's xxhash64; a value is (number, bytes)."""
    seed = 42
    for v, size in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(size, "little", signed=True), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def by_hand(rows, exponent, budget, block_docs, unit_tokens):
    """rows: (h1, h2, source, tokens) to a Counter of (h1, h2, epoch, block, order)."""
    seed, units, tokens, docs = mixing.SEED, Counter((s, a, b, n) for a, b, s, n in rows), Counter(), Counter()
    for a, b, s, n in rows:
        tokens[s] += n
        docs[s] += 1
    total = sum(tokens.values())
    raised = {s: (tokens[s] / total) ** exponent for s in tokens}
    scale = sum(raised.values())
    whole = float(budget) if budget is not None else max(tokens[s] / raised[s] for s in tokens) * scale
    out = Counter()
    for s in tokens:
        quota = round(raised[s] / scale * whole, 3)
        full = math.floor(quota / tokens[s])
        rest = quota - full * tokens[s]
        blocks, number = defaultdict(list), math.ceil(docs[s] / block_docs)
        for (src, a, b, n), copies in units.items():
            if src == s:
                most = max(1, unit_tokens // n)
                for chunk in range((copies - 1) // most + 1):
                    here = min(most, copies - chunk * most)
                    blocks[spark_hash((seed + 2, 4), (a, 8), (b, 8), (chunk, 8)) % number].append((a, b, chunk, here, here * n))
        for epoch in range(full + (rest > 0)):
            before = 0
            for block in sorted(blocks, key=lambda k: (spark_hash((seed + 4, 4), (k, 8), (epoch, 4)), k)):
                start = before
                for a, b, chunk, here, size in sorted(blocks[block], key=lambda u: (spark_hash((seed + 3, 4), (u[0], 8), (u[1], 8), (u[2], 8), (epoch, 4)), *u[:3])):
                    if epoch < full or (before < rest and start < rest):
                        at = min((epoch * tokens[s] + start + size / 2) / quota, 1.999)
                        tie = spark_hash((seed + 1, 4), (a, 8), (b, 8), (chunk, 8), (epoch, 4)) % (1 << 22)
                        out[a, b, epoch, block, math.floor(at * float(1 << 40)) * (1 << 22) + tie] += here
                    start += size
                before = start
    return out


@pytest.mark.parametrize("budget, block_docs, unit_tokens", [(None, 16, 65_536), (700, 7, 65_536), (None, 5, 12), (5000, 1000, 65_536)])
def test_order_equals_brute_force(spark, monkeypatch, budget, block_docs, unit_tokens):
    monkeypatch.setattr(mixing, "UNIT_TOKENS", unit_tokens)
    rng = random.Random(61)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))), s) for i, s in enumerate(["a"] * 150 + ["b"] * 40 + [None] * 9)]
    rows += [(900, "one and the same text", "b")] * 30 + [(901, None, "c"), (902, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    h1, h2 = row_hash(docs)
    hashed = docs.select(h1.alias("h1"), h2.alias("h2"), "source", mixing.token_count(F.col("text")).alias("n"))
    plain = [(r["h1"], r["h2"], r["source"], r["n"]) for r in hashed.collect()]
    units = docs.select(mixing._source(F.col("source")).alias("_src"), mixing.token_count(F.col("text")).alias("_tokens"), F.lit(1).alias("copies"))
    exponent = mixing.find_exponent(mixing.source_totals(units), None, mixing.MAX_REPEATS)
    out = mixing.mix_sources(docs, block_docs=block_docs, budget_tokens=budget)
    a, b = row_hash(out.select("doc_id", "text", "source"))
    got = Counter((r["a"], r["b"], r["mix_epoch"], r["mix_block"], r["mix_order"]) for r in out.select(a.alias("a"), b.alias("b"), "mix_epoch", "mix_block", "mix_order").collect())
    assert got == by_hand(plain, exponent, budget, block_docs, unit_tokens)
