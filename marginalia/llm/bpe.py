"""Byte-level BPE: encoding and decoding with a given rank file.

Two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are a token already
(one probe, then the bytes are compared); every other pre-token is merged with a heap over a linked
list of its bytes, O(n log n) for one of n bytes. Pre-tokens are found for many texts at once with
array operations over code-point classes, and each distinct one of a chunk is resolved once.

Null text counts as empty; an empty text has no ids and the digest of no bytes. Rows are never
dropped, repeated rows are encoded each, other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, textkit
from .textkit import U

SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Pre-tokens kept in a worker's memo; it is emptied when full.
MEMO = 300_000

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 any other."""
    global _classes
    if _classes is None:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.full(0x110000, 3, np.uint8)
        for code, name in ((1, r"\p{L}+"), (2, r"\p{N}+")):
            for m in regex.finditer(name, every):
                a, b = (ord(every[m.start()]), ord(every[m.end() - 1]))
                out[a : b + 1] = code
        out[0xD800:0xE000] = 3
        out[[ord(c) for c in SPACES]] = 0
        _classes = out
    return _classes


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte places of the starts of all pre-tokens and the end, pre-tokens before each text and in all).

    They are the matches of  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    c = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte place of each code point
    n = len(c)
    at = np.append(at, len(data))
    k = classes()[c]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(at, offsets)] = True
    fresh = head.copy()
    fresh[1:n] |= k[1:] != k[:-1]
    rs = np.flatnonzero(fresh[:n])
    re = np.append(rs[1:], n)
    rk = k[rs]
    space = rk == 0
    joined = np.zeros(len(rs), bool)
    joined[1:] = space[:-1] & ~space[1:] & (c[rs[1:] - 1] == 32) & ~head[rs[1:]]
    cut = np.zeros(n + 1, bool)
    cut[rs[~joined]] = True
    inner = space & ~head[re]
    cut[re[inner] - 1] = True
    # contractions: a lone apostrophe that starts a pre-token, letters right behind it
    lone = np.flatnonzero((rk == 3) & (re - rs == 1) & (c[rs] == 39) & ~joined)
    lone = lone[lone + 1 < len(rs)]
    lone = lone[(rk[lone + 1] == 1) & ~head[rs[lone + 1]]]
    if len(lone):
        p, size = rs[lone + 1], re[lone + 1] - rs[lone + 1]
        one = c[p]
        two = np.where(size >= 2, c[np.minimum(p + 1, n - 1)], 0)
        take = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        take = np.where(pair, 2, take)
        hit = take > 0
        cut[p[hit]] = False
        more = hit & (take < size)
        cut[(p + take)[more]] = True
    starts = np.flatnonzero(cut[:n])
    return np.append(at[starts], len(data)), np.searchsorted(at[starts], offsets)


class PerfectHash:
    """A minimal perfect hash: n keys to n slots, one pilot for every four keys."""

    def __init__(self, tokens: list[bytes]):
        n = self.n = len(tokens)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        keys = textkit.span_hash(textkit.prefix_hash(data), off[:-1], off[1:])
        if len(np.unique(keys)) != n:
            raise ValueError("equal tokens, or an unlucky hash")
        self.buckets = max(1, n // 4)
        b = (keys % U(self.buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        count = np.bincount(b, minlength=self.buckets)
        to = np.concatenate(([0], np.cumsum(count)))
        self.pilots = np.zeros(self.buckets, U)
        self.slots = np.zeros(n, np.int64)
        taken = np.zeros(n, bool)
        for i in np.argsort(-count, kind="stable"):
            if not count[i]:
                break
            own = order[to[i] : to[i + 1]]
            first = 0
            while True:
                p = np.arange(first, first + 256, dtype=U)
                s = self._slot(keys[own][None, :], p[:, None])
                ok = ~taken[s].any(1)
                if len(own) > 1:
                    t = np.sort(s, 1)
                    ok &= (t[:, 1:] != t[:, :-1]).all(1)
                j = np.argmax(ok)
                if ok[j]:
                    self.pilots[i] = p[j]
                    taken[s[j]] = True
                    self.slots[s[j]] = own
                    break
                first += 256

    def _slot(self, keys: np.ndarray, pilots: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (textkit.mix(keys ^ (pilots * U(0xD1B54A32D192ED03))) % U(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place in `tokens` of the only token that each key can be."""
        return self.slots[self._slot(keys, self.pilots[(keys % U(self.buckets)).astype(np.int64)])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of neighbours with the least rank is merged first, the leftmost of equals."""
    n = len(piece)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    get = ranks.get
    heap = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, end = pop(heap)
        m = nxt[i]
        if m < 0 or m >= n or nxt[m] != end:  # one of the two has been merged since
            continue
        nxt[i] = end
        nxt[m] = -1
        if end < n:
            prv[end] = i
            e = nxt[end]
            r = get(piece[i:e])
            if r is not None:
                push(heap, (r, i, e))
        p = prv[i]
        if p >= 0:
            r = get(piece[p:end])
            if r is not None:
                push(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : nxt[i]]])
        i = nxt[i]
    return out


#: The first bytes of eight, by their number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether each run of `size` bytes at a equals the one at b: eight bytes of all runs at once, and what very long
    runs have beyond that run by run."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    for _ in range(16):
        if not len(a):
            return True
        if ((eight[a] ^ eight[b]) & _FIRST[np.minimum(size, 8)]).any():
            return False
        rest = size > 8
        a, b, size = a[rest] + 8, b[rest] + 8, size[rest] - 8
    return all(np.array_equal(data[x : x + n], data[y : y + n]) for x, y, n in zip(a.tolist(), b.tolist(), size.tolist()))


def _told_apart(raw: bytes, bounds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first places, numbers) of the different pre-tokens by their bytes, where some of them share a hash."""
    seen: dict[bytes, int] = {}
    ends = bounds.tolist()
    inverse = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(ends, ends[1:])], np.int64)
    first = np.unique(inverse, return_index=True)[1]
    return keys[first], first, inverse


class Codec:
    """Ranks, the perfect hash over them, and the memo of merged pre-tokens. Every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], merge=None):
        self.ranks = ranks
        self.tokens = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.uint32, len(ranks))
        self.hash = PerfectHash(self.tokens)
        self.merge = merge or (lambda piece: heap_merge(piece, self.ranks))
        size = int(self.ids.max()) + 1
        order = [b""] * size
        for t, i in ranks.items():
            order[i] = t
        self.blob = np.frombuffer(b"".join(order), np.uint8)
        self.lens = np.array([len(t) for t in order], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lens)))[:-1]
        self.memo: dict[bytes, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "merge")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.memo = {}
        self.merge = lambda piece: heap_merge(piece, self.ranks)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text and in all)."""
        bounds, texts = pretokens(data, offsets)
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys = textkit.span_hash(textkit.prefix_hash(data), bounds[:-1], bounds[1:])
        uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        raw = data.tobytes()
        # pre-tokens with one hash are compared byte by byte with the first of them
        size, lead = np.diff(bounds), first[inverse]
        more = np.flatnonzero(lead != np.arange(len(lead)))
        if not np.array_equal(size[more], size[lead[more]]) or not equal_bytes(data, bounds[more], bounds[lead[more]], size[more]):
            uniq, first, inverse = _told_apart(raw, bounds, keys)
        tokens, place = self.tokens, self.hash.find(uniq)
        memo, packed = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        ids = self.ids
        for a, b, s in zip(bounds[first].tolist(), bounds[first + 1].tolist(), place.tolist()):
            piece = raw[a:b]
            if tokens[s] == piece:
                got = ids[s : s + 1].tobytes()
            else:
                got = memo.get(piece)
                if got is None:
                    got = np.array(self.merge(piece), np.uint32).tobytes()
                    if b - a < 64:
                        memo[piece] = got
            packed.append(got)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        table = np.frombuffer(b"".join(packed), "<u4")
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        per = size[inverse]
        out = table[textkit.ragged_index(begin[inverse], per)]
        before = np.concatenate(([0], np.cumsum(per)))
        return out, before[texts]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, bytes before each id and in all)."""
        n = self.lens[ids]
        return self.blob[textkit.ragged_index(self.starts[ids], n)], np.concatenate(([0], np.cumsum(n)))


def encode_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text; no shuffle, one pass over the texts."""
    spark = docs.sparkSession
    codec = spark.sparkContext.broadcast(Codec(read_ranks(path)))  # its size is the vocabulary's

    def run(batches):
        c = codec.value
        for b in common.chunks(batches, "text"):
            data, off = common.string_parts(common.readable(b.column(1)))
            ids, at = c.encode(data, off)
            raw, byte_at = c.decode(ids)
            raw, flat = memoryview(raw.tobytes()), memoryview(ids.astype("<u4").tobytes())
            cut = byte_at[at].tolist()
            at = at.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([y - x for x, y in zip(at, at[1:])], pa.int64()),
                    pa.array([hashlib.sha256(flat[4 * x : 4 * y]).hexdigest() for x, y in zip(at, at[1:])], pa.string()),
                    pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(cut, cut[1:])], pa.string()),
                ],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = docs.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    kind = src.schema["key"].dataType.simpleString()
    return common.map_arrow(src, run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
