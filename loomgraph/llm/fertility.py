"""Quality rules from tokeniser fertility: characters per token, byte-fallback share, token entropy, with bands per script."""

from __future__ import annotations

import base64
import os
import unicodedata
from array import array
from collections import Counter
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import blocks_of, column, integer_key, write_table

#: Where the vocabulary files lie, on every machine.
TOKENIZERS = "/opt/tokenizers"
PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: How byte-level BPE cuts a text before merging (the published pattern of that vocabulary).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A band is the median of a script and language, plus or minus so many times its scaled median deviation.
SPREAD = 7.0
#: Deviations count as at least this, so that a uniform corpus does not make a band of no width.
FLOORS = {"chars_per_token": 0.03, "chars_per_unit": 0.03, "byte_share": 0.01, "token_entropy": 0.012}
#: Measures of texts with fewer tokens vary too much; their band is wider by the root of the ratio.
FULL_TOKENS = 400
#: A language's band counts beside so many documents of its script's, and a script's beside so many of all: few documents are judged mostly by what is common.
PRIOR_DOCS = 50
#: Measures are counted in so many steps for each unit.
STEPS = 10_000
#: The word cache of a worker is emptied at this many words.
CACHE_WORDS = 400_000
#: The scripts of the bands; a text has the script of most of its letters.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "OTHER")

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


class Words(dict):
    """A number for each word as bytes; in arrays by number: piece ids, byte pieces, byte-level tokens, code points, script."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        with open(os.path.join(folder, RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.units = tiktoken.Encoding("units", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.end, self.unit_counts, self.chars, self.script = (array("q") for _ in range(5))

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        self.ids.extend(self.pieces.encode(text))
        self.end.append(len(self.ids))
        self.unit_counts.append(len(self.units.encode_ordinary(" " + text)))
        self.chars.append(len(text))
        self.script.append(script_of(text))
        self[word] = n = len(self.end) - 1
        return n


_TABLES: dict[str, Words] = {}


def words_table(folder: str) -> Words:
    """The worker's table; it outlives a task, so that words are tokenised once, and forgets at CACHE_WORDS."""
    if folder not in _TABLES:
        _TABLES[folder] = Words(folder)
    if len(_TABLES[folder]) >= CACHE_WORDS:
        _TABLES[folder].forget()
    return _TABLES[folder]


def script_of(word: str) -> int:
    """The place in SCRIPTS of a word's first letter; -1 without a letter."""
    for c in word:
        if c.isalpha():
            name = unicodedata.name(c, "OTHER").split(" ")[0].split("-")[0]
            return SCRIPTS.index(name if name in SCRIPTS else "OTHER")
    return -1


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    chars = len(text.translate(None, _SPACE).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.translate(None, _SPACE)]
    return chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a k-word window which is found at least twice in the text."""
    windows = list(zip(*(words[i:] for i in range(k))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    end = total = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + k - max(i, end)
            end = i + k
    return total


def measure(texts: list[list[bytes]], table: Words) -> dict[str, np.ndarray]:
    """For a block of texts as words: chars_per_token, chars_per_unit, byte_share, token_entropy, n_tokens, script.

    token_entropy is a share of the most that so many tokens can have. Texts without
    words: nan. The script is that of most words with a letter (ties: the first of SCRIPTS).
    """
    n = len(texts)
    flat = np.fromiter(map(table.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
    doc = np.repeat(np.arange(n), [len(x) for x in texts])
    ids, end, unit_counts, chars, script = (np.array(x, np.int64) for x in (table.ids, table.end, table.unit_counts, table.chars, table.script))
    start = np.concatenate(([0], end[:-1])) if len(end) else end
    size = (end - start)[flat]
    tokens = ids[np.repeat(start[flat] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    owner = np.repeat(doc, size)
    total = np.bincount(owner, minlength=n)
    pairs, counts = np.unique(owner * len(table.byte) + tokens, return_counts=True)
    byte = np.bincount(owner[table.byte[tokens]], minlength=n)
    letters = np.bincount(doc[script[flat] >= 0] * len(SCRIPTS) + script[flat][script[flat] >= 0], minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.log2(total) - np.bincount(pairs // len(table.byte), counts * np.log2(counts), minlength=n) / total
        most = np.log2(total)
        own_chars = np.bincount(doc, chars[flat], minlength=n)
        return {
            "chars_per_token": own_chars / total, "chars_per_unit": own_chars / np.bincount(doc, unit_counts[flat], minlength=n),
            "byte_share": byte / total, "token_entropy": np.where(total > 1, entropy / most, np.where(total == 1, 1.0, np.nan)), "n_tokens": total,
            "script": np.where(letters.any(1), letters.argmax(1), len(SCRIPTS) - 1),
        }


_COLUMNS = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, chars_per_unit double, byte_share double, token_entropy double, n_tokens long, script string, lang string"


def _measure_rows(batches, folder: str):
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    for whole in batches:
        for batch in blocks_of(whole, 1):
            table, texts, base = words_table(folder), [], []
            for text in batch.column(1).cast(pa.large_binary()):
                text = text.as_py() or b""
                texts.append(text.split())
                base.append((len(texts[-1]), *base_counts(text, texts[-1])))
            found = measure(texts, table)
            found["script"] = np.array(SCRIPTS, object)[found["script"]]
            counts = np.array(base, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(counts[:, i]) for i in range(5)),
                *(pa.array(found[c], pa.float64(), from_pandas=True) for c in FLOORS), pa.array(found["n_tokens"], pa.int64()),
                pa.array(found["script"], pa.string()), batch.column(2),
            ], names=names)


def medians(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by, a median for each of ``names``, docs): exact medians of values in steps of 1 / STEPS, from counts of the steps, so no order of rows matters."""
    values = F.array(*(F.struct(F.lit(c).alias("m"), F.round(F.col(c) * STEPS).cast("long").alias("v")) for c in names))
    counts = rows.select(*by, F.explode(values).alias("x")).select(*by, "x.m", "x.v").where("v is not null").groupBy(*by, "m", "v").agg(F.count(F.lit(1)).alias("n"))
    of = W.partitionBy(*by, "m")
    ranked = counts.withColumns({"c": F.sum("n").over(of.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)), "t": F.sum("n").over(of)})
    mids = ranked.where("2 * c >= t").groupBy(*by, "m").agg((F.min("v") / STEPS).alias("mid"), F.max("t").alias("t"))
    return mids.groupBy(*by).agg(*(F.max(F.when(F.col("m") == c, F.col("mid"))).alias(c) for c in names), F.max("t").alias("docs"))


def fertility_bands(measured: DataFrame, by: list[str], spread: float = SPREAD) -> DataFrame:
    """For each group of documents that pass the base rules: docs, and for each measure a middle and a width.

    The middle is the median, the width ``spread`` times the scaled median deviation
    from it. All documents count.
    """
    usable, names = measured.where(~base_failed()), list(FLOORS)
    mid = write_table(medians(usable, by, names), "fertility-medians")
    mid = mid.select(*(F.col(c).alias(f"g_{c}") for c in by), *(F.col(c).alias(f"{c}_mid") for c in names), "docs")
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in by]
    # A row for each group, of which there are as many as scripts and languages.
    off = usable.join(mid, same).select(*by, *(F.abs(F.col(c) - F.col(f"{c}_mid")).alias(c) for c in names))
    off = medians(off, by, names).select(*(F.col(c).alias(f"h_{c}") for c in by), *(F.col(c).alias(f"{c}_off") for c in names))
    both = mid.join(off, [F.col(f"g_{c}").eqNullSafe(F.col(f"h_{c}")) for c in by])
    wide = [(F.greatest(F.col(f"{c}_off") * 1.4826, F.lit(FLOORS[c])) * spread).alias(f"{c}_width") for c in names]
    return both.select(*(F.col(f"g_{c}").alias(c) for c in by), "docs", *(f"{c}_mid" for c in names), *wide)


def shrunk(own: DataFrame, parent: DataFrame, by: list[str]) -> DataFrame:
    """``own`` bands drawn towards their parent's (the group of ``by``): PRIOR_DOCS documents of the parent's count beside the own ones."""
    names = [f"{c}_{x}" for c in FLOORS for x in ("mid", "width")]
    wide = parent.select(*(F.col(c).alias(f"p_{c}") for c in by), *(F.col(n).alias(f"p_{n}") for n in names))
    both = own.join(wide, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in by])
    mean = lambda n: (F.col(n) * F.col("docs") + F.col(f"p_{n}") * PRIOR_DOCS) / (F.col("docs") + PRIOR_DOCS)
    return both.select(*(c for c in own.columns if c not in names), *(mean(n).alias(n) for n in names))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fertility_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang", folder: str = TOKENIZERS, spread: float = SPREAD) -> DataFrame:
    """One row for each row of ``docs``: its key (a whole number), base counts, measures, script, base_failed and kept.

    The public vocabularies' files are read from ``folder`` on each machine and
    every word of a text is tokenised (by itself, as both cut at white space).
    Characters per token outside of the band of the text's script and ``lang`` (null:
    a language of its own), a byte-fallback share above it, or a token entropy below
    it reject a text. Bands come from all documents that pass the base rules; ties
    and repeated rows count each. Null or empty text: no words, base_failed. Very long
    texts are measured whole. Null key: kept as null. Other columns are not looked at,
    so none clashes. An empty table gives no rows.
    """
    language = column(docs, lang).cast("string") if lang else F.lit(None).cast("string")
    slim = docs.select(integer_key(docs, key).alias("id"), column(docs, text).alias("text"), language.alias("lang"))
    measured = write_table(slim.mapInArrow(partial(_measure_rows, folder=folder), _COLUMNS), "fertility")
    return judge(measured, spread)


def judge(measured: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Verdicts from the measures by the band of script and language, drawn towards the script's, and that towards the band of all."""
    levels, all_of = (["every"], ["every", "script"], ["every", "script", "lang"]), measured.withColumn("every", F.lit(0))
    bands = write_table(fertility_bands(all_of, levels[0], spread), "fertility-bands")
    for above, by in zip(levels, levels[1:]):
        bands = write_table(shrunk(fertility_bands(all_of, by, spread), bands, above), "fertility-bands")
    bands = bands.drop("docs", "every").withColumnRenamed("script", "b_script").withColumnRenamed("lang", "b_lang")
    out = measured.join(bands, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in ("script", "lang")], "left")
    slack = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(FULL_TOKENS)) / F.greatest("n_tokens", F.lit(1))))
    gap = {c: (F.col(c) - F.col(f"{c}_mid")) / (F.col(f"{c}_width") * slack) for c in FLOORS}
    fine = (F.abs(gap["chars_per_token"]) <= 1) & (F.abs(gap["chars_per_unit"]) <= 1) & (gap["byte_share"] <= 1) & (gap["token_entropy"] >= -1)
    return out.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(fine, F.lit(False))).alias("kept"),
        "script", "n_tokens", "chars_per_token", "chars_per_unit", "byte_share", "token_entropy",
    )


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fertility_rules(docs).withColumnRenamed("id", "doc_id")
