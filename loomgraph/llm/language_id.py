"""Language ID by cross-parsing entropy: how few phrases of a language's labelled text make up a text.

A suffix automaton holds all strings that occur in a language's labelled text. A text
is cut greedily into the longest phrases found there; phrases times the bits that name
a place in the labelled text, for each byte, is the cross-parsing entropy. The
language with the least wins.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import blocks_of, column, hash128, unwrap, wrap, write_table

#: A language's labelled text: STRETCH characters from each of at most TEXTS texts (those with the smallest hashes).
STRETCH, TEXTS = 512, 128
#: Characters of labelled text in all languages together; with more languages than fill it, each gets fewer stretches, one at least.
TOTAL_CHARS = 1 << 18
#: Parts in which a language's texts are ranked before the best of all parts are.
PARTS = 32
#: Texts are parsed side by side in windows of so many bytes; a phrase that crosses a window's end counts as two.
WINDOW = 2048
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 48 if 48 <= b <= 57 else 32 for b in range(256))
_AUTOMATON = "lang string, chars long, alphabet binary, state binary, symbol binary, target binary"


def plain(text: bytes) -> bytes:
    """Lower case, digits as 0, each run of other ASCII as one space; empty if there is no letter."""
    s = text.decode("utf-8", "replace").lower()
    return b" ".join(s.encode().translate(_PLAIN).split()) if _LETTER.search(s) else b""


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The smallest automaton that knows all substrings of ``text``: for each state, the next one by byte; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        at, last = last, len(step)
        step.append({})
        longest.append(longest[at] + 1)
        link.append(0)
        while at >= 0 and c not in step[at]:
            step[at][c] = last
            at = link[at]
        if at < 0:
            continue
        old = step[at][c]
        if longest[old] > longest[at] + 1:
            # ``old`` also stands for longer strings, which end in fewer places: a twin takes over the shorter ones.
            twin = len(step)
            step.append(dict(step[old]))
            longest.append(longest[at] + 1)
            link.append(link[old])
            link[old] = twin
            while at >= 0 and step[at].get(c) == old:
                step[at][c] = twin
                at = link[at]
            old = twin
        link[last] = old
    return step


def _automaton(key, rows):
    texts = [plain(t.encode()) for t in rows.sort_values(["h1", "h2"])["stretch"]]
    # No text holds the byte 0, so no phrase goes over from one stretch to the next.
    step = suffix_automaton(b"\0".join(texts))
    alphabet = sorted({c for t in texts for c in t})
    number = {c: i for i, c in enumerate(alphabet, 1)}
    edges = np.array([(s, number[c], t) for s, out in enumerate(step) for c, t in out.items() if c], np.int32).reshape(-1, 3)
    return pd.DataFrame({
        "lang": [key[0]], "chars": [sum(map(len, texts))], "alphabet": [bytes(alphabet)], "state": [edges[:, 0].tobytes()],
        "symbol": [edges[:, 1].astype(np.uint8).tobytes()], "target": [edges[:, 2].tobytes()],
    })


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", texts: int = TEXTS, total: int = TOTAL_CHARS) -> list[dict]:
    """A suffix automaton for each language of ``docs``, built in a task each, as its edges.

    Only texts with a letter and a language count, equal ones once. The automata come to
    the driver; ``total`` bounds them (some 40 bytes a character).
    """
    known = docs.select(column(docs, lang).cast("string").alias("lang"), column(docs, text).alias("t"))
    known = known.where("lang is not null").where(F.col("t").rlike(r"\p{L}"))
    h1, h2 = hash128(F.col("t"))
    known = known.select("lang", h1.alias("h1"), h2.alias("h2"), "t")
    # First among those of one remainder, so that no task ranks all texts of a language.
    keys = known.select("lang", "h1", "h2").distinct()
    for part in (["lang", F.pmod("h2", F.lit(PARTS))], ["lang"]):
        keys = keys.withColumn("rank", F.row_number().over(W.partitionBy(*part).orderBy("h1", "h2"))).where(F.col("rank") <= texts)
    keys = write_table(keys, "languages")
    langs = keys.where("rank = 1").count()
    each = max(1, min(texts, total // (STRETCH * max(1, langs))))
    at = F.pmod("h1", F.greatest(F.length("t") - STRETCH + 1, F.lit(1))).cast("int") + 1
    stretches = known.join(keys.where(F.col("rank") <= each).drop("rank"), ["lang", "h1", "h2"]).select(
        "lang", "h1", "h2", F.substring("t", at, F.lit(STRETCH)).alias("stretch")
    )
    rows = stretches.groupBy("lang", "h1", "h2").agg(F.min("stretch").alias("stretch")).groupBy("lang").applyInPandas(_automaton, _AUTOMATON)
    return sorted((r.asDict() for r in rows.where("chars > 0").collect()), key=lambda r: r["lang"])


class Parser:
    """A language's automaton as one table: by state and byte, the next state and whether a new phrase begins with that byte.

    State 0 knows nothing yet. A byte that no phrase can go on with begins one; one that
    occurs nowhere is a phrase of its own.
    """

    def __init__(self, lang: str, chars: int, alphabet: bytes, state: bytes, symbol: bytes, target: bytes):
        self.lang, self.bits = lang, float(np.log2(chars + 1))
        self.symbols = bytearray(256)
        for i, c in enumerate(alphabet, 1):
            self.symbols[c] = i
        state, target, symbol = np.frombuffer(state, np.int32), np.frombuffer(target, np.int32), np.frombuffer(symbol, np.uint8)
        width = len(alphabet) + 1
        begin = np.ones(width, np.int32)
        begin[symbol[state == 0]] = target[state == 0] * width * 2 + 1
        table = np.tile(begin, (int(max(state.max(), target.max())) + 1, 1))
        on = state > 0
        table[state[on], symbol[on]] = target[on] * width * 2
        self.table = table.ravel()

    def phrases(self, data: np.ndarray, live: np.ndarray) -> np.ndarray:
        """For each window: its phrases. ``data``: byte by window; ``live[i]``: windows longer than i, which come first."""
        data = np.frombuffer(bytes(self.symbols), np.uint8)[data]
        state, at = np.zeros(data.shape[1], np.int32), np.zeros(data.shape[1], np.int64)
        count = np.zeros(data.shape[1], np.int32)
        for i, k in enumerate(live.tolist()):
            s, a = state[:k], at[:k]
            np.right_shift(s, 1, out=a)
            a += data[i, :k]
            np.take(self.table, a, out=s, mode="clip")
            count[:k] += s & 1
        return count


def entropies(texts: list[bytes], parsers: list[Parser]) -> np.ndarray:
    """Cross-parsing entropy in bits a byte, by text and language; without a byte: 0."""
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), -(-sizes // WINDOW))
    pieces = [t[i : i + WINDOW] for t in texts for i in range(0, len(t), WINDOW)]
    out = np.zeros((len(texts), len(parsers)))
    if not pieces:
        return out
    length = np.array([len(p) for p in pieces])
    order = np.argsort(-length, kind="stable")
    longest = int(length.max())
    data = np.frombuffer(b"".join(pieces[i].ljust(longest, b"\0") for i in order), np.uint8).reshape(-1, longest)
    data = np.ascontiguousarray(data.T)
    live = np.searchsorted(-length[order], -np.arange(longest), "left")
    for j, p in enumerate(parsers):
        out[:, j] = np.bincount(owner[order], p.phrases(data, live), len(texts)) * p.bits
    return out / np.maximum(sizes, 1)[:, None]


_BUILT: dict = {}


def _predictor(model):
    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        # Tables are built once for each worker, not for each task.
        if _BUILT.get("id") != model.value["id"]:
            _BUILT.clear()
            _BUILT.update(id=model.value["id"], parsers=[Parser(**r) for r in model.value["automata"]])
        parsers = _BUILT["parsers"]
        names = [p.lang for p in parsers]
        langs, scores = [], []
        for part in blocks_of(pa.RecordBatch.from_arrays([texts], names=["t"]), 0):
            block = [plain(t or b"") for t in part.column(0).cast(pa.large_binary()).to_pylist()]
            if not names:
                block = [b""] * len(block)
            bits = entropies(block, parsers) if names else np.zeros((len(block), 1))
            odds = np.exp2(-8 * (bits - bits.min(1, keepdims=True))).sum(1).tolist()
            langs += [names[w] if t else UNKNOWN for w, t in zip(bits.argmin(1).tolist(), block)]
            scores += [1 / o if t else 0.0 for o, t in zip(odds, block)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict


def learnable(key: Column) -> Column:
    """Rows that may be learned from: crc32 of the key's text, divided by 4, doesn't leave 2. A null key's don't count as such."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def identify(docs: DataFrame, automata: list[dict], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred (string) and score (double, 0 to 1); only the text is looked at.

    lang_pred is the language with the least cross-parsing entropy, ties going to the
    first by name; ``und`` with score 0 for null and empty texts, texts without a
    letter, or if no language was learned. score is the winner's share of 2 to the power
    of -8 times the entropies. Texts are read whole, however long. Repeated rows (ties)
    are judged alike, an empty table stays empty, columns named like the results are
    replaced, all others pass through, whatever their names.
    """
    # At most TOTAL_CHARS characters' automata, or a stretch for each language.
    model = docs.sparkSession.sparkContext.broadcast({"id": uuid4().hex, "automata": automata})
    out = wrap(docs).withColumn("_found", _predictor(model)(F.col("_doc")[text]))
    return unwrap(out, docs.columns, {"lang_pred": F.col("_found.lang"), "score": F.col("_found.score")})


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    automata = learn(docs.where(learnable(F.col("doc_id"))))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), automata).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
