"""LM scoring by masked pseudo-likelihood: a bidirectional window network in numpy predicts each token from both sides.

Texts are cut into tokens by the first ranks of a public byte-level vocabulary, so no
text has an unknown token. The network is trained on every token of every document.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import blocks_of, column, hash128, redeal, text_or_empty, unwrap, wrap, write_table

#: Where the vocabulary files lie, on every machine.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: How byte-level BPE cuts a text before merging (the published pattern of that vocabulary).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merges of this rank and above are not used: a smaller network, some more tokens.
MOST_RANKS = 16_384
#: Tokens on each side that the network sees, and the width of its hidden layer.
SIDE, HIDDEN = 2, 8
WINDOW = 2 * SIDE + 1
#: Tokens of a step of descent, its rate, and how much the squared gradients count at first.
BATCH, RATE, START = 16_384, 0.3, 1e-6
#: A text is stored in pieces of so many tokens; a task of training holds about GROUP_TOKENS.
SEGMENT, GROUP_TOKENS = 65_536, 4_000_000
#: Each round learns from so many times the groups of all rounds before it and those; the first from one.
GROWTH = 4
#: Copies of a segment that fill more than this part of a group are dealt over all groups.
HEAVY = 8
#: Trained networks that are averaged in one task.
FAN_IN = 8
#: Tokens that are scored at a time; bounds memory, whatever a text's length.
BLOCK = 8192
#: The largest number of half precision.
HALF_MAX = 65_504.0
#: Sums of exponentials are at least this, so that they have logarithms.
TINY = 1e-37
SEED = 61

_ENCODINGS: dict = {}


def encoding(folder: str = TOKENIZERS):
    """The worker's tokenizer; loaded once."""
    if folder not in _ENCODINGS:
        import tiktoken

        with open(os.path.join(folder, RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[folder] = tiktoken.Encoding("first-ranks", pat_str=SPLIT, mergeable_ranks={k: v for k, v in ranks.items() if v < MOST_RANKS}, special_tokens={})
    return _ENCODINGS[folder]


def tokens_of(text: str | None, folder: str = TOKENIZERS) -> np.ndarray:
    return encoding(folder).encode_to_numpy(text, disallowed_special=()).astype(np.int64) if text else np.empty(0, np.int64)


def _encode_rows(batches, folder: str, segment: int):
    for whole in batches:
        for batch in blocks_of(whole, 2):
            rows = []
            for h1, h2, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = tokens_of(text, folder)
                for s in range(0, len(ids), segment):
                    part = ids[max(0, s - SIDE) : s + segment + SIDE].astype(np.uint16)
                    rows.append((h1, h2, s // segment, min(segment, len(ids) - s), min(s, SIDE), part.tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h1", "h2", "segment", "n", "lead", "ids"])


def encode_documents(docs: DataFrame, text: str = "text", folder: str = TOKENIZERS, segment: int = SEGMENT) -> DataFrame:
    """(h1, h2, segment, n, lead, ids): the tokens of each row's text in stretches of ``segment`` or fewer (``n``), with up to SIDE more on both sides, ``lead`` of them before."""
    body = column(docs, text)
    rows = docs.select(*hash128(body), body).toDF("h1", "h2", "text").where("text <> ''")
    return write_table(rows.mapInArrow(partial(_encode_rows, folder=folder, segment=segment), "h1 long, h2 long, segment int, n int, lead int, ids binary"), "tokens")


def _own(ids: bytes, lead: int, n: int) -> np.ndarray:
    return np.frombuffer(ids, np.uint16)[lead : lead + n]


def _count_rows(batches):
    total = np.zeros(MOST_RANKS, np.int64)
    for batch in batches:
        for n, lead, ids in zip(*(c.to_pylist() for c in batch.columns)):
            total += np.bincount(_own(ids, lead, n), minlength=MOST_RANKS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])


class Vocabulary:
    """The network's ids of tokens (0: beyond the text's ends), by falling counts: those found in the corpus, and all single bytes.

    A token is predicted as a class and then within it, both from the context. Classes
    are stretches of ids with equal sums of the roots of their counts: frequent ids
    share small ones, so that a token meets the fewest others on average.
    """

    def __init__(self, counts: np.ndarray, folder: str = TOKENIZERS):
        single = [encoding(folder).encode_single_token(bytes([b])) for b in range(256)]
        counts = counts.astype(np.float64)
        counts[single] = np.maximum(counts[single], 1)
        known = np.flatnonzero(counts)
        known = known[np.lexsort((known, -counts[known]))]
        self.folder = folder
        self.ids = np.zeros(MOST_RANKS, np.int64)
        self.ids[known] = np.arange(1, len(known) + 1)
        self.size = len(known) + 1
        self.counts = np.concatenate(([1.0], counts[known]))
        roots = np.sqrt(self.counts / self.counts.sum())
        self.n_classes = math.ceil(roots.sum())
        before = np.cumsum(roots) - roots
        self.class_of = np.minimum(before / roots.sum() * self.n_classes, self.n_classes - 1).astype(np.int64)
        #: The ids of class k are range(first[k], first[k + 1]).
        self.first = np.searchsorted(self.class_of, np.arange(self.n_classes + 1))
        self._single = np.array(single)

    def look_up(self, tokens: np.ndarray) -> np.ndarray:
        """Ids; a token that the corpus hasn't is spelled in bytes."""
        out = self.ids[tokens]
        if out.all():
            return out
        decode = encoding(self.folder).decode_single_token_bytes
        parts = [[i] if i else [self.ids[self._single[b]] for b in decode(int(t))] for t, i in zip(tokens, out)]
        return np.array([i for p in parts for i in p], np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        return self.look_up(tokens_of(text, self.folder))

    def unigram(self) -> np.ndarray:
        """Log-probability of each id without context."""
        return np.log(self.counts / self.counts.sum())


def build_vocabulary(encoded: DataFrame, folder: str = TOKENIZERS) -> Vocabulary:
    """Counts over all tokens of all rows; at most MOST_RANKS numbers come to the driver."""
    counts = np.zeros(MOST_RANKS, np.int64)
    for r in encoded.select("n", "lead", "ids").mapInArrow(_count_rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    return Vocabulary(counts, folder)


def _rows(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """x[ids], for ids that are all within x."""
    return np.take(x, ids, axis=0, mode="clip")


class Network:
    """Parameters and, for rows of them, the sums of their squared gradients (a row's rate falls with the root).

    E: what an id adds to the hidden layers of its neighbours, a stretch of HIDDEN for
    each distance, the farthest ahead first (the middle one, its own, is not used). O:
    classes, P: ids within their class; their last column is the bias.
    """

    _NAMES = ("E", "O", "P", "sum_E", "sum_O", "sum_P")

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED):
        v, k = vocabulary.size, vocabulary.n_classes
        rng = np.random.default_rng(seed)
        mass = np.bincount(vocabulary.class_of, weights=vocabulary.counts, minlength=k)
        self.vocabulary = vocabulary
        self.E = (rng.standard_normal((v, WINDOW * HIDDEN)) * 0.3).astype(np.float32)
        self.E[:, SIDE * HIDDEN : (SIDE + 1) * HIDDEN] = 0
        self.O = np.concatenate((rng.standard_normal((k, HIDDEN)) * 0.1, np.log(np.maximum(mass, 1) / mass.sum())[:, None]), axis=1).astype(np.float32)
        self.P = np.concatenate((np.zeros((v, HIDDEN)), (np.log(vocabulary.counts) - np.log(mass[vocabulary.class_of]))[:, None]), axis=1).astype(np.float32)
        self.sum_E, self.sum_O, self.sum_P = (np.full((n, m), START, np.float32) for n, m in ((v, WINDOW), (k, 2), (v, 2)))

    def pack(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).reshape(-1) for k in self._NAMES])

    def change(self, start: np.ndarray) -> bytes:
        """What was learned since ``start``, in half precision: changes are small beside what they change."""
        return np.clip(self.pack() - start, -HALF_MAX, HALF_MAX).astype(np.float16).tobytes()

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k in self._NAMES:
            x = getattr(self, k)
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def shift(self) -> float:
        """What logits must be lowered by, so that no exponential overflows; 0 unless weights have grown very large."""
        return max(0.0, float(np.abs(self.O).sum(1).max()) - 80, float(np.abs(self.P).sum(1).max()) - 80)

    def hidden(self, ids: np.ndarray) -> np.ndarray:
        """The hidden layers at ``ids[SIDE:-SIDE]`` and a column of ones."""
        n, x = len(ids) - 2 * SIDE, _rows(self.E, ids)
        parts = [x[k : k + n, (WINDOW - 1 - k) * HIDDEN : (WINDOW - k) * HIDDEN] for k in range(WINDOW) if k != SIDE]
        total = parts[0] + parts[1]
        for part in parts[2:]:
            total += part
        h = np.ones((n, HIDDEN + 1), x.dtype)
        h[:, :HIDDEN] = np.tanh(total, out=total)
        return h

    def spans(self, sorted_ids: np.ndarray):
        """(first, end in ``sorted_ids``, first id, end of ids) of each class that occurs."""
        first = self.vocabulary.first.tolist()
        cut = np.searchsorted(sorted_ids, self.vocabulary.first).tolist()
        return [(a, b, low, high) for a, b, low, high in zip(cut, cut[1:], first, first[1:]) if a < b]

    def gradients(self, ids: np.ndarray, target: np.ndarray) -> tuple:
        """Of the mean negative log-probability of ``ids[SIDE:-SIDE]`` where ``target``: those of the hidden layers, of O and of P."""
        h, n, low = self.hidden(ids), max(1, int(target.sum())), np.float32(self.shift())
        y = np.where(target, ids[SIDE : len(ids) - SIDE], 0)
        order = np.argsort(y.astype(np.uint16), kind="stable")[len(y) - int(target.sum()) :]
        sorted_y, sorted_h = y[order], _rows(h, order)
        classes = self.vocabulary.class_of[sorted_y]
        e = np.exp(sorted_h @ self.O.T - low)
        s = 1 / np.maximum(e @ np.ones(e.shape[1], e.dtype), TINY)
        ds = (e @ self.O[:, :HIDDEN]) * s[:, None]
        ds -= _rows(self.O, classes)[:, :HIDDEN]
        ds -= _rows(self.P, sorted_y)[:, :HIDDEN]
        dO = e.T @ (sorted_h * s[:, None])
        first = np.flatnonzero(np.concatenate(([True], sorted_y[1:] != sorted_y[:-1])))[: len(sorted_y)]
        own = np.add.reduceat(sorted_h, first, axis=0) if len(first) else sorted_h
        np.subtract.at(dO, classes[first], own)
        dP = np.zeros_like(self.P)
        for a, b, low_id, high_id in self.spans(sorted_y):
            w, part = self.P[low_id:high_id], sorted_h[a:b]
            e = np.exp(part @ w.T - low)
            s = 1 / np.maximum(e @ np.ones(e.shape[1], e.dtype), TINY)
            ds[a:b] += (e @ w[:, :HIDDEN]) * s[:, None]
            dP[low_id:high_id] = e.T @ (part * s[:, None])
        dP[sorted_y[first]] -= own
        ds *= (1 - sorted_h[:, :HIDDEN] ** 2) / n
        dh = np.zeros((len(y), HIDDEN), ds.dtype)
        dh[order] = ds
        return dh, dO / n, dP / n

    def descend(self, ids: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        dh, dO, dP = self.gradients(ids, target)
        for x, sums, g in ((self.O, self.sum_O, dO), (self.P, self.sum_P, dP)):
            sums[:, 0] += (g[:, :HIDDEN] ** 2).mean(1)
            sums[:, 1] += g[:, HIDDEN] ** 2
            x[:, :HIDDEN] -= rate * g[:, :HIDDEN] / np.sqrt(sums[:, :1])
            x[:, HIDDEN] -= rate * g[:, HIDDEN] / np.sqrt(sums[:, 1])
        rows, g = self.around(ids, dh)
        sums = self.sum_E[rows] + (g * g).mean(2)
        self.sum_E[rows] = sums
        self.E[rows] -= (rate * g / np.sqrt(sums)[:, :, None]).reshape(len(rows), -1)

    def around(self, ids: np.ndarray, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids that occur, the gradient of their rows of E): the hidden layers' around each place of an id, which lie in a row in memory."""
        padded = np.zeros((len(dh) + 4 * SIDE, HIDDEN), dh.dtype)
        padded[2 * SIDE : len(padded) - 2 * SIDE] = dh
        windows = np.lib.stride_tricks.as_strided(padded, (len(ids), WINDOW * HIDDEN), (padded.strides[0], padded.strides[1]), writeable=False)
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        sorted_ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
        g = np.add.reduceat(windows[order], first, axis=0).reshape(-1, WINDOW, HIDDEN)
        g[:, SIDE] = 0
        return sorted_ids[first], g

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Of each token, given the SIDE tokens before and after it; ``ids`` holds 0 where there is none, for which the result means nothing."""
        out, low = np.empty(len(ids), np.float32), np.float32(self.shift())
        padded = np.concatenate((np.zeros(SIDE, np.int64), ids, np.zeros(SIDE, np.int64)))
        for at in range(0, len(ids), BLOCK):
            y = ids[at : at + BLOCK]
            h = self.hidden(padded[at : at + len(y) + 2 * SIDE])
            own = np.einsum("ij,ij->i", h, _rows(self.O, self.vocabulary.class_of[y]) + _rows(self.P, y)) - 2 * low
            e = np.exp(h @ self.O.T - low)
            total = e @ np.ones(e.shape[1], np.float32)
            order = np.argsort(y.astype(np.uint16), kind="stable")
            sorted_h, within = _rows(h, order), np.empty(len(y), np.float32)
            for a, b, low_id, high_id in self.spans(y[order]):
                e = np.exp(sorted_h[a:b] @ self.P[low_id:high_id].T - low)
                within[a:b] = e @ np.ones(e.shape[1], np.float32)
            inside = np.empty(len(y), np.float32)
            inside[order] = within
            out[at : at + len(y)] = own - np.log(np.maximum(total, TINY)) - np.log(np.maximum(inside, TINY))
        return out.astype(np.float64)


def learn(net: Network, flat: np.ndarray, target: np.ndarray) -> int:
    """Steps of descent on the tokens of ``flat`` where ``target``, stretch by stretch; its first and last SIDE are none."""
    seen = 0
    for s in range(SIDE, len(flat) - SIDE, BATCH):
        e = min(s + BATCH, len(flat) - SIDE)
        n = int(target[s:e].sum())
        if n:
            # A small last stretch goes as far as its share of a whole one.
            net.descend(flat[s - SIDE : e + SIDE], target[s:e], RATE * min(1.0, 4 * n / BATCH))
        seen += n
    return seen


def _training(vocabulary, start):
    return lambda key, table: _train_group(key, table, vocabulary, start)


def _train_group(key, table: pa.Table, vocabulary, start) -> pa.Table:
    vocab = vocabulary.value
    net = Network(vocab).load(start.value)
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("h1", "h2", "segment", "times", "n", "lead", "ids"))), key=lambda r: r[:4])
    parts, targets, held, gap, seen = [], [], 0, np.zeros(SIDE, np.int64), 0

    def flush():
        nonlocal held, seen
        if parts:
            seen += learn(net, np.concatenate((*parts, gap)), np.concatenate((*targets, gap != 0)))
        parts.clear()
        targets.clear()
        held = 0

    for _, _, _, times, n, lead, ids in rows:
        # Every token of the corpus has an id, so places stay what they were.
        own = np.concatenate((gap, vocab.ids[np.frombuffer(ids, np.uint16)]))
        place = np.arange(len(own)) - SIDE - lead
        for _ in range(times):
            parts.append(own)
            targets.append((place >= 0) & (place < n))
            held += len(own)
            if held >= 64 * BATCH:
                flush()
    flush()
    return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([seen], pa.int64()), "flat": pa.array([net.change(start.value)], pa.large_binary())},
                    schema=pa.schema([("g", pa.int64()), ("n", pa.int64()), ("flat", pa.binary())]))


def _mean_group(key, table):
    """The mean of what some networks learned, weighted by their tokens; summed in the order of their groups."""
    total, n = 0.0, 0
    for _, own, flat in sorted(zip(*(table.column(c).to_pylist() for c in ("g", "n", "flat"))), key=lambda r: r[0]):
        total, n = total + own * np.frombuffer(flat, np.float16).astype(np.float64), n + own
    return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "flat": pa.array([(total / n).astype(np.float16).tobytes()], pa.binary())})


def deal_groups(encoded: DataFrame, n_groups: int, group_tokens: int, seed: int) -> DataFrame:
    """``encoded`` with g (its group, by a seeded hash of its text) and times (long): how often it is learned from there.

    Copies of a segment share a group, unless they would fill a good part of it: of
    those, one row goes to each group with its share of the copies.
    """
    counted = encoded.groupBy("h1", "h2", "segment", "n").agg(F.count(F.lit(1)).alias("copies"))
    large = write_table(counted.where((F.col("copies") > 1) & (F.col("copies") * F.col("n") * HEAVY > group_tokens)).drop("n"), "tokens-heavy")
    keys, place = ["h1", "h2", "segment"], F.xxhash64(F.lit(seed), "h1", "h2", "segment")
    light = encoded.join(large, keys, "left_anti").withColumns({"g": F.pmod(place, F.lit(n_groups)), "times": F.lit(1).cast("long")})
    one = encoded.join(large, keys).groupBy(*keys, "n", "lead", "copies").agg(F.first("ids").alias("ids"))
    share = lambda g: (F.floor(F.col("copies") / n_groups) + (F.pmod(g - place, F.lit(n_groups)) < F.col("copies") % n_groups).cast("int")).cast("long")
    dealt = one.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long")))).withColumn("times", share(F.col("g"))).where("times > 0")
    return light.unionByName(dealt.select(*light.columns))


def round_ends(n_groups: int) -> list[int]:
    """How many groups have been learned from by the end of each round."""
    ends = [1]
    while ends[-1] < n_groups:
        ends.append(min(ends[-1] * GROWTH, n_groups))
    return ends


def train(encoded: DataFrame, vocabulary: Vocabulary, group_tokens: int = GROUP_TOKENS, seed: int = SEED) -> Network:
    """The network, trained on all tokens of all rows: each is the target of one step.

    Texts are dealt by their hash into groups of about ``group_tokens``, and the groups
    into rounds, each GROWTH times as large as all before it: the network is averaged about
    log(groups) times, however many groups there are. In a round each group goes on from
    the round's common network, text by text in the order of their hashes; what they
    learn is averaged in a tree, weighted by tokens, and one change reaches the driver.
    Groups, orders and sums depend on the texts alone, so other partitions or orders of
    rows train the same network.
    """
    net = Network(vocabulary, seed)
    total = encoded.agg(F.sum("n")).first()[0] or 0
    if not total:
        return net
    n_groups = -(-total // group_tokens)
    sc, words = encoded.sparkSession.sparkContext, encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rows, schema, low = deal_groups(encoded, n_groups, group_tokens, seed), "g long, n long, flat binary", 0
    for high in round_ends(n_groups):
        start = net.pack()
        nets = rows.where((F.col("g") >= low) & (F.col("g") < high)).groupBy("g").applyInArrow(_training(words, sc.broadcast(start)), schema)
        left = high - low
        nets = nets.withColumn("g", F.col("g") - low)
        while left > 1:
            nets = nets.withColumn("of", F.floor(F.col("g") / FAN_IN)).groupBy("of").applyInArrow(_mean_group, schema)
            left = -(-left // FAN_IN)
        for r in nets.select("flat").collect():  # one row, or none if the hash left the round's groups empty
            net.load(start + np.frombuffer(r["flat"], np.float16).astype(np.float32))
        low = high
    return net


def score_tokens(net: Network, rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Summed log-probability of each of some rows (ids, which of them count); some BLOCKs of tokens are held at a time, or one row if it has more."""
    total, held, size, gap = [], [], 0, np.zeros(SIDE, np.int64)

    def done():
        # Rows stand side by side with gaps as wide as a window between them, so none sees another.
        joined = np.concatenate([x for ids, _ in held for x in (ids, gap)])
        counted = np.concatenate([x for _, own in held for x in (own, gap != 0)])
        sums = np.concatenate(([0.0], np.cumsum(np.where(counted, net.log_probabilities(joined), 0.0))))
        at = 0
        for ids, _ in held:
            total.append(float(sums[at + len(ids)] - sums[at]))
            at += len(ids) + SIDE
        held.clear()

    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= 8 * BLOCK:
            done()
            size = 0
    if held:
        done()
    return total


def _score_rows(batches, vocabulary, flat):
    net = Network(vocabulary.value).load(flat.value)
    for batch in batches:
        rows = []
        for n, lead, ids in zip(*(batch.column(c).to_pylist() for c in ("n", "lead", "ids"))):
            own = net.vocabulary.ids[np.frombuffer(ids, np.uint16)]
            place = np.arange(len(own)) - lead
            rows.append((own, (place >= 0) & (place < n)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "segment", "n")), pa.array(score_tokens(net, iter(rows)), pa.float64())], names=["h1", "h2", "segment", "n", "total"])


def _scoring(vocabulary, flat):
    @F.arrow_udf("n long, total double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = Network(vocabulary.value).load(flat.value)
        for texts in batches:
            rows = [net.vocabulary.encode(t.as_py()) for t in texts]
            total = score_tokens(net, ((ids, np.ones(len(ids), bool)) for ids in rows))
            yield pa.StructArray.from_arrays([pa.array([len(x) for x in rows], pa.int64()), pa.array(total, pa.float64())], names=["n", "total"])

    return score


def score_documents(docs: DataFrame, net: Network, text: str = "text", encoded: DataFrame | None = None) -> DataFrame:
    """``docs`` with n_tokens (long), log_likelihood (double: sum over all tokens, each given both sides) and per_token (double: its mean).

    ``encoded``: the tokens of these texts and no new ones, if they are at hand; texts are
    then not tokenised again. Null or empty text: no tokens, 0.0 and null per_token. Very
    long texts are scored whole, in blocks. Repeated rows (ties) score alike; an empty
    table stays empty; columns named like the results are replaced, all others pass
    through, whatever their names.
    """
    sc = docs.sparkSession.sparkContext
    model = {"vocabulary": sc.broadcast(net.vocabulary), "flat": sc.broadcast(net.pack())}
    if encoded is None:
        out = wrap(docs).withColumn("_s", _scoring(**model)(text_or_empty(F.col("_doc")[text])))
        n, total = F.col("_s")["n"], F.col("_s")["total"]
    else:
        each = encoded.mapInArrow(partial(_score_rows, **model), "h1 long, h2 long, segment int, n int, total double")
        once = each.groupBy("h1", "h2", "segment").agg(F.first("n").alias("n"), F.min("total").alias("total"))
        per = write_table(once.groupBy("h1", "h2").agg(F.sum("n").alias("_n"), F.sum("total").alias("_total")), "scores")
        h1, h2 = hash128(column(docs, text))
        out = wrap(docs, h1.alias("h1"), h2.alias("h2")).join(redeal(per, "h1"), ["h1", "h2"], "left")
        n, total = F.coalesce("_n", F.lit(0)).cast("long"), F.coalesce("_total", F.lit(0.0))
    return unwrap(out, docs.columns, {"n_tokens": n, "log_likelihood": total, "per_token": F.when(n > 0, total / n)})


def fit(docs: DataFrame, text: str = "text", folder: str = TOKENIZERS, group_tokens: int = GROUP_TOKENS, seed: int = SEED) -> tuple[Network, DataFrame]:
    """The network of ``docs``, all rows and whole texts (null: none), and their tokens."""
    encoded = encode_documents(docs, text, folder)
    return train(encoded, build_vocabulary(encoded, folder), group_tokens, seed), encoded


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net, encoded = fit(docs)
    return score_documents(docs, net, encoded=encoded).select("doc_id", "n_tokens", "log_likelihood", "per_token")
