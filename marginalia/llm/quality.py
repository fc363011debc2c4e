"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (`most`, taken by hash of the identifier)
and flattened into arrays; every whole text is scored by walking all trees for many rows at once.

Null and empty texts have all statistics 0 and get the score of such a row. Labels that are null are
ignored; several labels of one document count by their mean. Without labels, or with one class only,
the score is the share of label 1 (0.5 without labels). Repeated rows are scored each; other columns
are ignored, and none of them is ever an input of the score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit
from .bpe import classes

FEATURES = (
    "log_chars", "letters", "upper", "digits", "spaces", "punctuation", "symbols", "exclamation", "bars", "brackets", "lines", "non_ascii", "log_words", "word_mean", "word_sd", "short_words", "long_words",
    "distinct_words", "same_as_last", "top_word", "distinct_shingles", "repeated_lines", "repeated_line_bytes", "line_mean", "ends", "symbol_words", "upper_words",
)
#: Fixed statistics of bytes: sentence ends, punctuation, symbols.
ENDS, PUNCT, SYMBOLS, BRACKETS = b".!?", b".,;:!?'\"-()", b"#$%&*@^~|<>=+_/\\`{}[]", b"{}[]<>()"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_T = {n: _table(c) for n, c in (("ends", ENDS), ("punct", PUNCT), ("symbols", SYMBOLS), ("brackets", BRACKETS))}


def _distinct(group: np.ndarray, keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the most frequent key) in each group."""
    if not len(keys):
        return np.zeros(groups), np.zeros(groups)
    order = np.lexsort((keys, group))
    g, k = group[order], keys[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(k)))
    top = np.zeros(groups)
    np.maximum.at(top, g[at], size)
    return np.bincount(g[at], minlength=groups).astype(float), top


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(off))

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[off[1:]] - c[off[:-1]]).astype(float)

    lead = (data & 0xC0) != 0x80
    chars = share(lead)
    c = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    k = np.zeros(len(data), np.uint8)
    k[lead] = classes()[c] + 1
    one = np.maximum(chars, 1)
    letters = share(k == 2)
    upper_byte = (data >= 65) & (data <= 90)
    start, end, words = textkit.word_spans(data, off)
    nw = np.diff(words).astype(float)
    per = np.maximum(nw, 1)
    wdoc = np.repeat(np.arange(n), np.diff(words))
    lead_sum = np.concatenate(([0], np.cumsum(lead)))
    wl = (lead_sum[end] - lead_sum[start]).astype(float)
    low = textkit.LOWER[data]
    h = textkit.span_hash(textkit.prefix_hash(low), start, end)
    mean = np.bincount(wdoc, wl, n) / per
    sd = np.sqrt(np.maximum(np.bincount(wdoc, wl * wl, n) / per - mean * mean, 0))
    distinct, top = _distinct(wdoc, h, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    _, so = textkit.shingle_sets(data, off)
    # lines
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    cut[1:] |= data == 10
    ls = np.flatnonzero(cut[:-1])
    le = np.append(ls[1:], len(data))
    ldoc = doc[ls]
    lh = textkit.span_hash(textkit.prefix_hash(data), ls, np.where(data[le - 1] == 10, le - 1, le))
    order = np.lexsort((lh, ldoc))
    again = np.zeros(len(ls), bool)
    again[order[1:]] = (lh[order[1:]] == lh[order[:-1]]) & (ldoc[order[1:]] == ldoc[order[:-1]])
    again &= le - ls > 1
    nl = np.bincount(ldoc, minlength=n).astype(float)
    size = np.maximum(np.diff(off), 1).astype(float)
    bad_end = _T["symbols"][data[end - 1]] | (data[end - 1] == 33) if len(end) else np.zeros(0, bool)
    up = np.concatenate(([0], np.cumsum(upper_byte)))
    uw = (up[end] - up[start]) > 1
    cols = (
        np.log1p(chars), letters / one, share(upper_byte) / np.maximum(letters, 1), share(k == 3) / one, share(k == 1) / one, share(_T["punct"][data]) / one, share(_T["symbols"][data]) / one, share(data == 33) / one, share(data == 124) / one, share(_T["brackets"][data]) / one, nl / one, share(data >= 128) / one, np.log1p(nw), mean, sd,
        np.bincount(wdoc, wl <= 2, n) / per, np.bincount(wdoc, wl >= 12, n) / per, distinct / per, np.bincount(wdoc, same, n) / per, top / per, np.diff(so) / np.maximum(nw - textkit.SHINGLE + 1, 1), np.bincount(ldoc, again, n) / np.maximum(nl, 1), np.bincount(ldoc, again * (le - ls), n) / size, nw / np.maximum(nl, 1), share(_T["ends"][data]) / per,
        np.bincount(wdoc, bad_end, n) / per, np.bincount(wdoc, uw, n) / per,
    )
    for j, x in enumerate(cols):
        out[:, j] = x
    out[chars == 0] = 0
    return out


class Trees:
    """Boosted trees for two classes by histograms; after fit() flat arrays only."""

    def __init__(self, trees: int = 80, depth: int = 5, rate: float = 0.12, bins: int = 64, least: int = 10, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        rows, cols = x.shape
        self.prior = 0.5 if not rows else float(y.mean())
        self.feature = np.zeros((0, 0), np.int16)
        if rows < 2 * self.least or self.prior in (0.0, 1.0):
            self.constant = self.prior
            return self
        self.constant = None
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(cols)]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
        nodes = (1 << (self.depth + 1)) - 1
        self.feature = np.zeros((self.n, nodes), np.int16)
        self.threshold = np.full((self.n, nodes), np.inf)
        self.value = np.zeros((self.n, nodes))
        self.bias = float(np.log(self.prior / (1 - self.prior)))
        f = np.full(rows, self.bias)
        width = self.bins
        flat = code + np.arange(cols) * width
        for t in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(rows, np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                for i in range(first, 2 * first + 1):
                    own = np.flatnonzero(node == i)
                    if len(own) < 2 * self.least:
                        continue
                    idx = flat[own].ravel()
                    hist = [np.bincount(idx, np.repeat(v, cols), cols * width).reshape(cols, width).cumsum(1) for v in (g[own], h[own], np.ones(len(own)))]
                    gl, hl, nl = hist
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(nl < self.least) | (len(own) - nl < self.least)] = -1
                    j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                        continue
                    self.feature[t, i], self.threshold[t, i] = j, edges[j][b]
                    go = code[own, j] > b
                    node[own] = 2 * i + 1 + go
            for i in np.unique(node):
                own = node == i
                self.value[t, i] = self.rate * g[own].sum() / (h[own].sum() + self.ridge)
            f += self.value[t, node]
        self._spread()
        return self

    def _spread(self) -> None:
        """A leaf above the last level passes its value down, so that all walks have the same length."""
        leaf = np.isinf(self.threshold)
        inner = (1 << self.depth) - 1
        for i in range(inner):
            for child in (2 * i + 1, 2 * i + 2):
                stop = leaf[:, i]
                self.value[stop, child] = self.value[stop, i]
                if child < inner:
                    self.threshold[stop, child] = np.inf
                    leaf[stop, child] = True

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        trees = np.arange(self.n)[None, :]
        node = np.zeros((len(x), self.n), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return 1 / (1 + np.exp(-(self.bias + self.value[trees, node].sum(1))))


def held_out(key, parts: int = 5, part: int = 0):
    return F.crc32(key.cast("string").cast("binary")) % parts == part


def with_statistics(docs: DataFrame, text: str, key: str) -> DataFrame:
    src = docs.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        for b in common.chunks(batches, "text"):
            x = statistics(*common.string_parts(common.readable(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["key", "x"])

    return common.map_arrow(src, run, f"key {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = 20_000) -> Trees:
    """Fits on at most `most` labelled documents outside the held-out fold. Identifiers may be of any type;
    of documents under one identifier the least text counts."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).cast("string").alias("key")).agg(F.avg(label).alias("y"))
    sample = known.orderBy(F.xxhash64("key"), "key").limit(most).collect()  # `most` pairs
    y = {r.key: float(r.y >= 0.5) for r in sample}
    got = []
    if sample:
        ids = docs.sparkSession.createDataFrame([(k,) for k in y], "__key string")
        own = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
        wanted = own.join(F.broadcast(ids), F.col("key") == F.col("__key"), "left_semi").groupBy("key").agg(F.min("text").alias("text"))  # `most` ids
        got = sorted((r.key, r.x) for r in with_statistics(wanted, "text", "key").toLocalIterator())
    x = np.array([x for _, x in got]) if got else np.zeros((0, len(FEATURES)))
    return Trees().fit(x, np.array([y[k] for k, _ in got]))


def score(docs: DataFrame, model: Trees, text: str = "text", key: str = "doc_id", cut: float = 0.3) -> DataFrame:
    """One row per row of docs: key, held_out, score, predicted. No shuffle."""
    src = docs.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    kind = src.schema["key"].dataType.simpleString()
    trees = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in common.chunks(batches, "text"):
            p = trees.value.predict(statistics(*common.string_parts(common.readable(b.column(1)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["key", "score"])

    out = common.map_arrow(src, run, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees, text: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows whose text scores `cut` at least, all columns as they were. Null and empty texts have
    the score of statistics 0; repeated rows are judged each; an empty table stays empty. Rows pass
    through in bounded slices of Arrow data, texts never become Python objects."""
    trees = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in common.chunks(batches, text):
            p = trees.value.predict(statistics(*common.string_parts(common.readable(b.column(text)))))
            yield b.filter(pa.array(p >= cut))

    return common.map_arrow(docs, run, docs.schema)
