"""Benchmark decontamination: a BM25 inverted index of test items with block-max WAND, queried by every passage."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, hash128, integer_key, text_or_empty, unwrap, wrap, write_table

K1, B = 1.2, 0.75
#: An item is retrieved if a passage scores at least this share of what the item itself would score.
THRESHOLD = 0.6
#: Items in a block of the index.
BLOCK = 4
#: A retrieved item is a leak if so much of it, and of its question and answer each, lies in shared 5-word sequences.
SEQUENCE, OVERLAP, PART_OVERLAP = 5, 0.75, 0.5
#: Indexes that are in memory at a time hold about so many bytes of item texts; a larger benchmark is searched in several scans.
INDEX_BYTES = 32 << 20
#: Items of up to so many words share an index, those of up to SPAN times as many the next one, and so on: passages are as long as an index's items.
SHORT, SPAN = 64, 4
#: Bounds that are added up at a time.
CELLS = 2_000_000

_STRIP = b".,;:!?\"'()[]{}<>*#$%&|`~-_"
_ANSWER = re.compile(r"\?\s|\n\s*(?:answer|a)\s*:\s*", re.I)


def terms_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, without punctuation at their ends; words of punctuation alone are dropped."""
    return [w for w in (x.strip(_STRIP) for x in (text or b"").lower().split()) if w]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: parted after its last ``?`` or before ``answer:``, else in the middle of its words."""
    cuts = [m.end() for m in _ANSWER.finditer(text) if text[m.end() :].strip()]
    if cuts:
        return text[: cuts[-1]], text[cuts[-1] :]
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


@dataclass
class Index:
    """Postings of term t: items[at[t]:at[t + 1]] ascending, with impacts; its blocks and their highest impacts likewise."""

    item_ids: list
    parts: list  # (question terms, answer terms) of each item
    terms: dict
    at: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_at: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    longest: int
    df: np.ndarray  # items of the whole benchmark that hold each term

    def __post_init__(self):
        self._essential: dict = {}
        #: Term and block as one number, ascending as the postings' blocks are.
        self.block_keys = np.repeat(np.arange(len(self.terms)), np.diff(self.block_at)) * self.n_blocks + self.blocks
        self.item_list, self.impact_list = self.items.tolist(), self.impacts.tolist()
        #: For each term: block -> (first posting, end, highest impact).
        self.spans: list[dict] = []
        for t in range(len(self.terms)):
            own, b = self.items[self.at[t] : self.at[t + 1]] // BLOCK, slice(self.block_at[t], self.block_at[t + 1])
            low = self.at[t] + np.searchsorted(own, self.blocks[b])
            high = np.append(low[1:], self.at[t + 1])
            self.spans.append({k: (x, y, z) for k, x, y, z in zip(self.blocks[b].tolist(), low.tolist(), high.tolist(), self.block_max[b].tolist())})

    @property
    def n_blocks(self) -> int:
        return -(-len(self.item_ids) // BLOCK)

    def essential(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Blocks in which a term is needed, as (places by term, blocks).

        An item's most common terms are not needed while together they stay below the
        threshold: a passage with none of the others can't reach it.
        """
        if threshold not in self._essential:
            term = np.repeat(np.arange(len(self.terms)), np.diff(self.at))
            order = np.lexsort((term, -self.df[term], self.items))
            item, s = self.items[order], self.impacts[order]
            total = np.cumsum(s)
            first = np.searchsorted(item, item)
            needed = total - np.where(first > 0, total[first - 1], 0.0) >= threshold - 1e-9
            keys = np.unique(term[order][needed] * self.n_blocks + item[needed] // BLOCK)
            self._essential[threshold] = np.searchsorted(keys, np.arange(len(self.terms) + 1) * self.n_blocks), keys % max(self.n_blocks, 1)
        return self._essential[threshold]


@dataclass
class Statistics:
    """Of the whole benchmark: items with a word, their mean length, and for each term the items that hold it."""

    n: int
    mean: float
    df: dict
    longest: dict  # of each class of lengths


def length_class(n: int) -> int:
    size = SHORT
    while size < n:
        size *= SPAN
    return size


def statistics(rows: list[tuple]) -> Statistics:
    lists = [x for x in (terms_of(q.encode()) + terms_of(a.encode()) for _, q, a in rows) if x]
    longest: dict = {}
    for x in lists:
        longest[length_class(len(x))] = max(longest.get(length_class(len(x)), 0), len(x))
    return Statistics(len(lists), sum(map(len, lists)) / len(lists) if lists else 1.0, Counter(w for x in lists for w in set(x)), longest)


def build_index(rows: list[tuple], of: Statistics | None = None) -> Index:
    """``rows``: (item id, question, answer). Impacts are BM25 scores divided by the item's score for itself.

    ``of``: the whole benchmark's statistics, where ``rows`` are a part of it; an item
    has the same impacts in whichever part it is.
    """
    of = of or statistics(rows)
    parts = [(terms_of(q.encode()), terms_of(a.encode())) for _, q, a in rows]
    kept = sorted((i for i, (q, a) in enumerate(parts) if q or a), key=lambda i: (b" ".join(sorted(set(parts[i][0] + parts[i][1]))), i))
    ids, parts = [rows[i][0] for i in kept], [parts[i] for i in kept]
    terms: dict = {}
    postings: list[dict] = []
    lengths = [len(q) + len(a) for q, a in parts]
    for d, (q, a) in enumerate(parts):
        for w in q + a:
            t = terms.setdefault(w, len(terms))
            if t == len(postings):
                postings.append({})
            postings[t][d] = postings[t].get(d, 0) + 1
    df = np.array([of.df[w] for w in terms], np.float64)
    scored, own = [], np.zeros(max(len(ids), 1))
    for t, p in enumerate(postings):
        idf = np.log(1 + (of.n - df[t] + 0.5) / (df[t] + 0.5))
        d, tf = np.array(list(p), np.int64), np.array(list(p.values()), np.float64)
        s = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.array([lengths[i] for i in d]) / of.mean))
        own[d] += s
        scored.append((d, s))
    at, block_at, items, impacts, blocks, tops = [0], [0], [], [], [], []
    for d, s in scored:
        s = s / own[d]
        items.append(d)
        impacts.append(s)
        b, first = np.unique(d // BLOCK, return_index=True)
        blocks.append(b)
        tops.append(np.maximum.reduceat(s, first))
        at.append(at[-1] + len(d))
        block_at.append(block_at[-1] + len(b))
    cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.empty(0, kind)
    return Index(ids, parts, terms, np.array(at), cat(items, np.int64), cat(impacts, np.float64), np.array(block_at), cat(blocks, np.int64), cat(tops, np.float64), max((of.longest[length_class(n)] for n in lengths), default=1), df)


def build_indexes(rows: list[tuple], of: Statistics | None = None) -> list[Index]:
    """One index for each class of lengths, so that a long item doesn't make long passages of all documents."""
    of, by = of or statistics(rows), {}
    for row in rows:
        by.setdefault(length_class(len(terms_of(row[1].encode())) + len(terms_of(row[2].encode()))), []).append(row)
    return [index for _, part in sorted(by.items()) if (index := build_index(part, of)).item_ids]


def wand(index: Index, query: list[int], threshold: float = THRESHOLD, blocks=None) -> list[tuple[int, float]]:
    """All (item, score) with a score of at least ``threshold`` for the query's distinct terms, by block-max WAND.

    A block whose terms' highest impacts don't sum to the threshold is skipped
    whole. In the others a cursor stands on each term's postings, sorted by item; the
    pivot is the first item at which the block maxima reach the threshold, and the
    cursors before it jump there. ``blocks``: those that can hold such items, where
    that is known (all others are then left out).
    """
    floor, found = threshold - 1e-9, []
    if blocks is None:
        blocks = sorted({b for t in query for b in index.spans[t]})
    for block in blocks:
        live = [[span[0], span[1], span[2]] for t in query if (span := index.spans[t].get(block))]
        if sum(c[2] for c in live) < floor:
            continue
        items, impacts = index.item_list, index.impact_list
        while live:
            live.sort(key=lambda c: items[c[0]])
            bound, pivot = 0.0, None
            for c in live:
                bound += c[2]
                if bound >= floor:
                    pivot = items[c[0]]
                    break
            if pivot is None:
                break
            score = 0.0
            for c in live:
                if items[c[0]] < pivot:
                    c[0] = bisect_left(items, pivot, c[0], c[1])
                if c[0] < c[1] and items[c[0]] == pivot:
                    score += impacts[c[0]]
                    c[0] += 1
            if score >= floor:
                found.append((pivot, score))
            live = [c for c in live if c[0] < c[1]]
    return found


def overlaps(index: Index, item: int, passage: list[bytes]) -> tuple[float, float, float]:
    """Shares of the item's, its question's and its answer's words that lie in its 5-word sequences found in the passage."""
    q, a = index.parts[item]
    words, k = q + a, min(SEQUENCE, len(q) + len(a))
    there = set(zip(*(passage[i:] for i in range(k))))
    covered = np.zeros(len(words), bool)
    for i in range(len(words) - k + 1):
        if tuple(words[i : i + k]) in there:
            covered[i : i + k] = True
    share = lambda x: float(x.mean()) if len(x) else 1.0
    return share(covered), share(covered[: len(q)]), share(covered[len(q) :])


def candidate_windows(index: Index, docs: list[list[bytes]], threshold: float = THRESHOLD):
    """Yields (document, first word, words, its distinct term ids, blocks) of passages that some block's bound lets reach the threshold.

    A document is cut into segments as long as the longest item; each two
    neighbours are a passage, so an item of any length lies whole in one. Only
    blocks with an item that needs one of the passage's terms are looked at; such a
    block's bound is the sum over its segments' distinct terms of their highest
    impact in the block.
    """
    size, get = index.longest, index.terms.get
    ids = [np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)) for words in docs]
    n_segments = np.array([-(-len(x) // size) for x in ids], np.int64)
    first = np.concatenate(([0], np.cumsum(n_segments)))
    n_terms, n_blocks = len(index.terms), index.n_blocks
    if not n_terms or not first[-1]:
        return
    segment = np.concatenate([first[d] + np.arange(len(x)) // size for d, x in enumerate(ids)])
    flat = np.concatenate(ids)
    pairs = np.unique(segment[flat >= 0] * n_terms + flat[flat >= 0])
    seg, term = pairs // n_terms, pairs % n_terms
    cut = np.searchsorted(seg, np.arange(first[-1] + 1))
    owner = np.repeat(np.arange(len(docs)), n_segments)
    # A passage has its first segment's number; a document's last segment begins one only if it is the only one.
    second = np.arange(first[-1]) + 1 < first[owner + 1]
    begins = second | (n_segments[owner] == 1)
    at, blocks = index.essential(threshold)
    where, who = _ranges(at[term], at[term + 1])
    hit = np.unique(seg[who] * n_blocks + blocks[where])
    s, b = hit // n_blocks, hit % n_blocks
    before = (s > 0) & (s > first[owner[s]])
    found = np.unique(np.concatenate((s[begins[s]] * n_blocks + b[begins[s]], (s[before] - 1) * n_blocks + b[before])))
    passage, block = found // n_blocks, found % n_blocks
    end = cut[passage + 1 + second[passage]]
    n = end - cut[passage]
    bound, low = np.zeros(len(found)), 0
    while low < len(found):
        high = max(low + 1, int(np.searchsorted(np.cumsum(n[low:]), CELLS, side="right")) + low)
        where, who = _ranges(cut[passage[low:high]], end[low:high])
        keys = term[where] * n_blocks + block[low:high][who]
        place = np.minimum(np.searchsorted(index.block_keys, keys), len(index.block_keys) - 1)
        bound[low:high] = np.bincount(who, np.where(index.block_keys[place] == keys, index.block_max[place], 0.0), minlength=high - low)
        low = high
    good = np.flatnonzero(bound >= threshold - 1e-9)
    for g in np.unique(passage[good]):
        d, own = owner[g], good[passage[good] == g]
        start = int(g - first[d]) * size
        yield d, start, docs[d][start : start + 2 * size], np.unique(term[cut[g] : end[own[0]]]).tolist(), block[own].tolist()


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges low[i]:high[i] in a row, and the i of each."""
    n = high - low
    who = np.repeat(np.arange(len(n)), n)
    return np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + low[who], who


def search_documents(index: Index, docs: list[list[bytes]], threshold: float = THRESHOLD) -> list[tuple]:
    """(document, item, score, overlap, question overlap, answer overlap) of each leak; of an item found twice, the best."""
    best: dict = {}
    for d, start, passage, terms, blocks in candidate_windows(index, docs, threshold):
        for item, score in wand(index, terms, threshold, blocks):
            # A little more than the passage, so that a sequence at its edge counts whole.
            near = docs[d][max(0, start - SEQUENCE) : start + len(passage) + SEQUENCE]
            whole, q, a = overlaps(index, item, near)
            if whole >= OVERLAP and q >= PART_OVERLAP and a >= PART_OVERLAP:
                best[d, item] = max(best.get((d, item), (0.0,) * 4), (whole, q, a, score))
    return [(d, item, s, w, q, a) for (d, item), (w, q, a, s) in sorted(best.items())]


def _search_rows(batches, indexes, threshold: float):
    """(text, further columns) to the further columns with the items that the text holds."""
    indexes = indexes.value
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        rows, held, size, places = [], [], 0, []

        def done():
            for index in indexes:
                for d, item, *scores in search_documents(index, held, threshold):
                    rows.append((places[d], index.item_ids[item], *scores))
            held.clear()
            places.clear()

        for place, text in enumerate(texts):
            held.append(terms_of(text.as_py()))
            places.append(place)
            size += len(held[-1])
            if size >= 200_000:
                done()
                size = 0
        done()
        at, *columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64()] + [pa.float64()] * 4
        yield pa.RecordBatch.from_arrays(
            [c.take(pa.array(at, pa.int64())) for c in batch.columns[1:]] + [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=batch.schema.names[1:] + ["item_id", "score", "overlap", "question_overlap", "answer_overlap"],
        )


def _item_rows(batches):
    """(slice, item_id, question, answer, length class, terms) of items, split where they aren't."""
    for batch in batches:
        rows = []
        for part, item, q, a in zip(*(c.to_pylist() for c in batch.columns)):
            q, a = (q, a) if a is not None else split_item(q)
            terms = terms_of(q.encode()) + terms_of(a.encode())
            rows.append((part, item, q, a, length_class(len(terms)), terms))
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["slice", "item_id", "q", "a", "lengths", "terms"])


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """(key, item_id, score, overlap, question_overlap, answer_overlap): documents and the benchmark items that they hold.

    Keys are whole numbers. ``items``: item_id and text, or item_id, question and answer. Every passage of
    every whole document, however long, queries the index; all items above the
    threshold are retrieved, and what is verified by overlap of item, question and
    answer is returned, once for a document and item (ties and repeated items each).
    Items without a word, and null ids, are in no index. Numbers of items, lengths and
    document frequencies are those of the whole benchmark. Indexes are built on the
    driver and broadcast; a benchmark of over ``index_bytes`` is split by a hash of
    item_id into as many parts as needed, each with a scan of its own and the same
    results as in one. Null and empty texts leak nothing; rows with a null key are
    searched under a null key; repeated rows give repeated results; other columns are
    not looked at. No items or no documents: no rows.
    """
    return _found(docs.select(column(docs, text).alias("text"), integer_key(docs, key).alias("key")), items, threshold, index_bytes)


def _found(slim: DataFrame, items: DataFrame, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """As ``find_leaks``, for ``slim``: the text and, after it, the columns (long) that the results are to carry."""
    schema = ", ".join(f"{c} long" for c in slim.columns[1:]) + ", item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    columns = {c.lower() for c in items.columns}
    two = {"question", "answer"} <= columns
    item = lambda c: text_or_empty(column(items, c).cast("string"))
    source = items.select(column(items, "item_id").cast("long").alias("item_id"), item("question" if two else "text").alias("q"), (item("answer") if two else F.lit(None).cast("string")).alias("a"))
    source = source.where("item_id is not null")
    total = source.agg(F.sum(F.octet_length("q") + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    slices = max(1, -(-total // index_bytes))
    split = source.select(F.pmod(F.xxhash64("item_id"), F.lit(slices)).cast("int"), "item_id", "q", "a")
    split = write_table(split.mapInArrow(_item_rows, "slice int, item_id long, q string, a string, lengths long, terms array<binary>").where(F.size("terms") > 0), "benchmark")
    n, mean = split.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).first()
    longest = {r["lengths"]: r["n"] for r in split.groupBy("lengths").agg(F.max(F.size("terms")).alias("n")).collect()}  # a row for each class
    held = split.select("slice", F.explode(F.array_distinct("terms")).alias("term"))
    found = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = None
    for s in range(slices):
        rows = [(r["item_id"], r["q"], r["a"]) for r in split.where(F.col("slice") == s).orderBy("item_id", "q", "a").toLocalIterator()]
        own = held.where(F.col("slice") == s).select("term").distinct().join(found, "term").toLocalIterator()  # no more than the part's own words
        indexes = build_indexes(rows, Statistics(n, mean or 1.0, {bytes(r["term"]): r["df"] for r in own}, longest))
        leaks = slim.mapInArrow(partial(_search_rows, indexes=slim.sparkSession.sparkContext.broadcast(indexes), threshold=threshold), schema)
        out = leaks if out is None else out.unionByName(leaks)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose text leaks an item.

    Each row is judged by its own text, found again by 128 bits of hash, whether its key
    is unique, repeated or null. Null and empty texts stay, texts of any length are
    searched whole, equal rows (ties) go or stay together, an empty table stays empty.
    All columns pass through, whatever their names.
    """
    body = column(docs, text)
    h1, h2 = hash128(body)
    leaks = write_table(_found(docs.select(body.alias("text"), h1.alias("_x1"), h2.alias("_x2")), items, **how).select("_x1", "_x2").distinct(), "leaks")
    return unwrap(wrap(docs, h1.alias("_x1"), h2.alias("_x2")).join(leaks, ["_x1", "_x2"], "left_anti"), docs.columns, {})


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, items).withColumnRenamed("key", "doc_id")
