"""Language-model scoring with a hierarchical Pitman-Yor model.

Three levels of restaurants, in each of which a dish is a word:

* one for each context, which is the word before (65,536 slots by its hash; the beginning of a text is a
  context too). Every training token is a customer of its context's restaurant;
* their shared parent, the word restaurant: each table of a context restaurant is a customer there;
* below it the base measure, which spells words out with restaurants over bytes: one for each pair of
  preceding bytes and slot of the two before those, which share parents (one for each pair), which share
  theirs (one for each byte), which share the root, over a uniform base. Each table of the word restaurant
  sends its word's bytes and the word's end there.

Seatings are sampled by Gibbs sweeps over the numbers of tables, the only part of a seating that
predictions depend on: the tables of a dish are drawn from their distribution given its customers, the
parent's current prediction and the tables of the other dishes (exactly, by generalised Stirling numbers,
up to EXACT customers; beyond, customers are seated one after the other and then in runs). In a sweep all
dishes are drawn at once, given the totals of the sweep before. Sweeps after BURN_IN are retained, and the
predictive probabilities that they give are averaged. So every word, seen or not, has a probability in
every context; a text's score is the sum of the logarithms of its tokens'.

Counts cover all training texts and the model is the same at any size. A task gathers a group of its texts
as one packed row. Each group sends its distinct words, with the contexts they stand in, to buckets by the
word's hash: one shuffle. A bucket holds all customers of its words and is written once; a sweep is a map
over the buckets, since contexts only need the totals of each slot, a vector of fixed size. Draws depend on
word, context and sweep alone, so a repeated task draws the same; the state is written after each sweep.
Probabilities go back to the groups in a second shuffle. The driver holds the totals and the
spelling counts, 16 bytes for each distinct code; a common word is one entry of a group however frequent.

Null text counts as empty: it has the end token only. A row with a null identifier is a training row.
Repeated rows count each. Other columns are ignored. Without training texts all words get the base
measure's probability. An empty table gives an empty table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit
from .textkit import U

S = 257  # 256 bytes, and the end of a word; as context the same number means its beginning
EDGE = 256
#: Bytes of text in a group, and for each bucket of words; the least number of buckets.
GROUP_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 32 << 20, 96
#: Context restaurants: the word before, by this many bits of its hash.
CONTEXT_BITS = 16
CONTEXTS = 1 << CONTEXT_BITS
#: Sweeps, and how many of the first are not retained.
SWEEPS, BURN_IN = 4, 1
#: Customers up to which the number of tables is drawn from its exact distribution.
EXACT = 48
#: Slots of the third and fourth preceding byte, for every size of input.
SLOTS = 64
STRENGTH = 1.0


# --- seating ----------------------------------------------------------------------------------


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers: seatings of c customers at t tables, in [c, t]."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(2, most + 1):
            t = np.arange(1, c + 1)
            out[c, 1 : c + 1] = np.logaddexp(out[c - 1, t - 1], np.log(np.maximum(c - 1 - discount * t, 0)) + out[c - 1, t])
    return out


def _uniform(key: np.ndarray, number: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the number only."""
    with np.errstate(over="ignore"):
        x = textkit.mix(key + U(number + 1) * U(0x9E3779B97F4A7C15))
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def draw_tables(count: np.ndarray, prob: np.ndarray, others: np.ndarray, discount: float, strength: float, key: np.ndarray) -> np.ndarray:
    """Tables of dishes with `count` customers and the parent's probability `prob`, in restaurants where
    the other dishes have `others` tables. P(t) is in proportion to S(count, t) * prob**t * the product of
    strength + discount * (others + i) for i < t."""
    out = (count > 0).astype(np.int64)
    table = log_stirling(discount)
    small = np.flatnonzero((count > 1) & (count <= EXACT))
    order = small[np.argsort(count[small], kind="stable")]
    sizes, at = np.unique(count[order], return_index=True)
    for c, a, b in zip(sizes.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]):
        for part in np.array_split(order[a:b], max(1, (b - a) * c // 2_000_000)):
            logs = np.log(strength + discount * (others[part][:, None] + np.arange(c)[None, :])) + np.log(prob[part])[:, None]
            weight = np.cumsum(logs, 1) + table[c, 1 : c + 1][None, :]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            out[part] = 1 + (weight < (_uniform(key[part], 0) * weight[:, -1])[:, None]).sum(1)
    large = np.flatnonzero(count > EXACT)
    if len(large):
        out[large] = _in_turn(count[large], (strength + discount * others[large]) * prob[large], discount, key[large])
    return out


def _in_turn(count: np.ndarray, mass: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables when customers are seated one after the other, from EXACT on in runs of a quarter of those
    seated; a run takes its mean, rounded up with the chance of its fraction."""
    tables = np.ones(len(count), np.int64)
    live = np.arange(len(count))
    j = 1
    while len(live):
        n = np.minimum(1 if j < EXACT else j // 4, count[live] - j)
        p = mass[live] / (mass[live] + np.maximum(j - discount * tables[live], 1e-9))
        tables[live] += np.floor(n * p + _uniform(key[live], j)).astype(np.int64)
        j += 1 if j < EXACT else j // 4
        live = live[count[live] > j]
    return np.minimum(tables, count)


class Speller:
    """Spelling restaurants, kept sparse: one for each pair of preceding bytes and slot of the two
    bytes before them; their parents for each pair; those' parents for each preceding byte; the root."""

    def __init__(self, code: np.ndarray, count: np.ndarray, slots: int = SLOTS, seed: int = 0, sweeps: int = 3, discounts=(0.4, 0.5, 0.6, 0.7), strength: float = 1.0):
        order = np.argsort(code)
        self.slots = slots
        self.code, c3 = code[order], count[order].astype(np.int64)
        ctx3, sym3 = self.code // S, self.code % S
        self.code2, up = np.unique((ctx3 // slots) * S + sym3, return_inverse=True)
        ctx2, sym2 = self.code2 // S, self.code2 % S
        par = (ctx2 % S) * S + sym2
        self.ctx3, at3 = np.unique(ctx3, return_inverse=True)  # contexts that were seen; others pass everything to their parent
        p2 = np.full(len(self.code2), 1.0 / S)
        self.p1 = np.full((S, S), 1.0 / S)
        t3, t2 = np.minimum(c3, 1), np.minimum(np.bincount(up, c3, len(self.code2)).astype(np.int64), 1)
        t1, t0 = np.zeros(S * S, np.int64), np.zeros(S, np.int64)
        flat = np.arange(S * S)
        for i in range(sweeps):
            salts = [U((((seed * 64 + i) * 8 + level + 1) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF) for level in range(4)]
            key = lambda x, level: textkit.mix(x.astype(U) + salts[level])  # noqa: B023, E731
            of = np.bincount(at3, t3, len(self.ctx3))
            t3 = draw_tables(c3, p2[up], of[at3] - t3, discounts[3], strength, key(self.code, 3))
            c2 = np.bincount(up, t3, len(self.code2)).astype(np.int64)
            t2 = np.minimum(t2, c2)
            of = np.bincount(ctx2, t2, S * S)
            t2 = draw_tables(c2, self.p1.ravel()[par], of[ctx2] - t2, discounts[2], strength, key(self.code2, 2))
            c1 = np.bincount(par, t2, S * S).astype(np.int64)
            t1 = np.minimum(np.maximum(t1, (c1 > 0).astype(np.int64)), c1)
            p0 = np.full(S, 1.0 / S)
            for _ in range(2):
                of = t1.reshape(S, S).sum(1)
                t1 = draw_tables(c1, np.tile(p0, S), np.repeat(of, S) - t1, discounts[1], strength, key(flat, 1))
                c0 = t1.reshape(S, S).sum(0)
                t0 = np.minimum(np.maximum(t0, (c0 > 0).astype(np.int64)), c0)
                t0 = draw_tables(c0, np.full(S, 1.0 / S), t0.sum() - t0, discounts[0], strength, key(flat[:S], 0))
                p0 = (c0 - discounts[0] * t0 + (strength + discounts[0] * t0.sum()) / S) / (strength + c0.sum())
            c1_, t1_ = c1.reshape(S, S), t1.reshape(S, S)
            self.p1 = (c1_ - discounts[1] * t1_ + (strength + discounts[1] * t1_.sum(1, keepdims=True)) * p0[None, :]) / (strength + c1_.sum(1, keepdims=True))
            all2 = strength + np.bincount(ctx2, c2, S * S)
            self.back2 = (strength + discounts[2] * np.bincount(ctx2, t2, S * S)) / all2
            self.own2 = (c2 - discounts[2] * t2) / all2[ctx2]
            p2 = self.own2 + self.back2[ctx2] * self.p1.ravel()[par]
        all3 = strength + np.bincount(at3, c3, len(self.ctx3))
        self.back3 = (strength + discounts[3] * np.bincount(at3, t3, len(self.ctx3))) / all3
        self.own3 = (c3 - discounts[3] * t3) / all3[at3]

    def log_prob(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each word's spelling, its end included."""
        code3, to = spelled(data, off, self.slots)
        codes, back = np.unique(code3, return_inverse=True)
        ctx3, sym = codes // S, codes % S
        ctx2 = ctx3 // self.slots
        p = self.back2[ctx2] * self.p1.ravel()[(ctx2 % S) * S + sym] + _look(self.code2, self.own2, ctx2 * S + sym, 0.0)
        p = p * _look(self.ctx3, self.back3, ctx3, 1.0) + _look(self.code, self.own3, codes, 0.0)
        total = np.concatenate(([0.0], np.cumsum(np.log(p)[back])))
        return total[to[1:]] - total[to[:-1]]


def _look(keys: np.ndarray, values: np.ndarray, want: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(want), other)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], other)


def spelled(data: np.ndarray, off: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Codes (pair of preceding bytes, slot of the two before, next) of all words' bytes and ends, and
    where each word's begin."""
    n = np.diff(off)
    to = off + np.arange(len(off))
    sym = np.full(to[-1], EDGE, np.int64)
    sym[np.arange(len(data)) + np.repeat(np.arange(len(n)), n)] = data
    place = np.arange(len(sym)) - np.repeat(to[:-1], n + 1)
    back = []
    for k in (1, 2, 3, 4):
        c = np.full(len(sym), EDGE)
        a = np.flatnonzero(place >= k)
        c[a] = sym[a - k]
        back.append(c)
    slot = (textkit.mix((back[2] * S + back[3]).astype(U)) % U(slots)).astype(np.int64)
    return ((back[1] * S + back[0]) * slots + slot) * S + sym, to


class Totals:
    """What a sweep needs of the one before: tables of each context, customers and tables of the word
    restaurant, and the number of the speller in use."""

    def __init__(self, context_tables: np.ndarray, customers: int, tables: int, speller: int):
        self.context_tables, self.customers, self.tables, self.speller = context_tables, customers, tables, speller


class Model:
    """Discounts, customers of each context, and the totals of each sweep."""

    def __init__(self, context_customers: np.ndarray, discounts: tuple[float, float], strength: float = STRENGTH):
        self.context_customers, self.discounts, self.strength = context_customers, discounts, strength
        self.totals: list[Totals] = []
        self.spellers: list[Speller] = []

    def start(self, words: "Words") -> tuple[np.ndarray, np.ndarray]:
        """(tables of each entry, of each word) before the first sweep: one for each dish."""
        t2 = np.minimum(words.c, 1)
        return t2, np.minimum(words.customers(t2), 1)

    def log_base(self, words: "Words", speller: int) -> np.ndarray:
        return self.spellers[speller].log_prob(words.data, words.off)

    def sweep(self, words: "Words", i: int, t2: np.ndarray, t1: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after sweep i + 1, given that after sweep i; base: logarithms by the speller of totals[i]."""
        g, (d1, d2) = self.totals[i], self.discounts
        p0 = np.maximum(np.exp(base), 1e-300)
        p1 = (words.customers(t2) - d1 * t1 + (self.strength + d1 * g.tables) * p0) / (self.strength + g.customers)
        key = textkit.mix(words.hash + U(2 * i + 1))
        some = words.several  # a single customer has one table whatever happens
        of, k = words.of[some], words.k[some]
        drawn = draw_tables(words.c[some], p1[of], g.context_tables[k] - t2[some], d2, self.strength, textkit.mix(key[of] + k.astype(U) + U(1)))
        t2 = np.minimum(words.c, 1)
        t2[some] = drawn
        c1 = words.customers(t2)
        return t2, draw_tables(c1, p0, np.maximum(g.tables - np.minimum(t1, c1), 0), d1, self.strength, key)

    def log_predicted(self, words: "Words", i: int, t2: np.ndarray, t1: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Logarithm of each entry's predictive probability by the state after sweep i."""
        g, (d1, d2) = self.totals[i], self.discounts
        with np.errstate(divide="ignore"):
            word = np.logaddexp(np.log(words.customers(t2) - d1 * t1), np.log(self.strength + d1 * g.tables) + base) - np.log(self.strength + g.customers)
            back = np.log(self.strength + d2 * g.context_tables[words.k]) + word[words.of]
            return np.logaddexp(np.log(words.c - d2 * t2), back) - np.log(self.strength + self.context_customers[words.k])


@dataclass
class State:
    """A bucket's words between two passes: tables, the logarithms of their spelling by `speller`, and the
    sum of the predictions of the sweeps retained so far, as a logarithm."""

    words: "Words"
    t2: np.ndarray | None = None
    t1: np.ndarray | None = None
    base: np.ndarray | None = None
    speller: int = -1
    total: np.ndarray | None = None

    def take_in(self, model: Model) -> None:
        """What the totals of the last sweep allow: its spelling, and its predictions if it is retained."""
        i = len(model.totals) - 1
        if self.speller != model.totals[i].speller:
            self.speller = model.totals[i].speller
            self.base = model.log_base(self.words, self.speller)
        if i > BURN_IN:
            p = model.log_predicted(self.words, i, self.t2, self.t1, self.base)
            self.total = p if self.total is None else np.logaddexp(self.total, p)

    def go_on(self, model: Model) -> None:
        """The next sweep."""
        if not model.totals:
            self.t2, self.t1 = model.start(self.words)
            return
        self.take_in(model)
        self.t2, self.t1 = model.sweep(self.words, len(model.totals) - 1, self.t2, self.t1, self.base)

    def averaged(self, model: Model) -> np.ndarray:
        """Logarithm of each entry's predictive probability, averaged over the retained sweeps."""
        self.take_in(model)
        return self.total - np.log(len(model.totals) - 1 - BURN_IN)


class Words:
    """The words of a bucket with their entries: (word, context) and training customers."""

    def __init__(self, blob: bytes, lens: np.ndarray, per: np.ndarray, k: np.ndarray, c: np.ndarray):
        self.data = np.frombuffer(blob, np.uint8)
        self.off = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
        self.n = len(lens)
        self.hash = textkit.span_hash(textkit.prefix_hash(self.data), self.off[:-1], self.off[1:])
        self.of = np.repeat(np.arange(self.n), per)
        self.k, self.c = k.astype(np.int64), c.astype(np.int64)
        self.several = np.flatnonzero(self.c > 1)

    def customers(self, t2: np.ndarray) -> np.ndarray:
        """Customers of each word in the word restaurant: the tables of its entries."""
        return np.bincount(self.of, t2, self.n).astype(np.int64)


# --- packing ----------------------------------------------------------------------------------


def _zip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.compress(raw, 3)


def _unzip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(raw)


def _pack(x: np.ndarray, up: bool = False) -> bytes:
    """Whole numbers (up: ascending ones) as zipped planes of bytes, four or, where they need them, eight;
    floats with four bytes."""
    if x.dtype.kind == "f":
        x = x.astype("<f4").view("<u4")
    elif up:
        x = np.diff(x.astype(np.int64), prepend=0)
    width = 4 if x.max(initial=0) < 1 << 32 else 8
    return bytes([width]) + _zip(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def _unpack(raw: bytes, up: bool = False, floats: bool = False) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(_unzip(raw[1:]), np.uint8).reshape(width, -1)
    x = np.ascontiguousarray(planes.T).view("<f4" if floats else f"<u{width}").ravel()
    return x if floats else np.cumsum(x.astype(np.int64)) if up else x.astype(np.int64)


def slot_of(h: np.ndarray) -> np.ndarray:
    """The context that a word is, by its hash."""
    return (textkit.mix(h + U(0x5107)) >> U(64 - CONTEXT_BITS)).astype(np.int64)


#: The context of a text's first token.
BEGIN = int(slot_of(np.array([1], U))[0])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(20)) % U(buckets)).astype(np.int64)


# --- gathering --------------------------------------------------------------------------------


def _gather(docs: DataFrame, text: str, key: str, parts: int, part: int, buckets: int) -> DataFrame:
    """One row for each group of texts: their keys, whether they are held out, sizes in tokens, and the
    tokens as numbers in order of frequency; place: each number's place among the group's distinct words
    in order of bucket and hash, in which words, lens and slots are. The end token is the empty word."""
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False)).alias("out"), F.col(text).cast("string").alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    schema = f"grp long, keys array<{kind}>, out array<boolean>, sizes binary, seq binary, place binary, slots binary, words binary, lens binary"
    names = common.arrow_schema(schema)

    def flush(grp, held):
        keys, out, sizes, hashes, starts, lens, raw = (list(x) for x in zip(*held))
        n = np.concatenate(sizes)
        base = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        h, start, size = np.concatenate(hashes), np.concatenate([s + b for s, b in zip(starts, base)]), np.concatenate(lens)
        data = np.concatenate(raw)
        uniq, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        order = np.lexsort((uniq, bucket_of(uniq, buckets)))  # by bucket and hash
        place = np.empty(len(uniq), np.int64)
        place[order] = np.arange(len(uniq))
        often = np.argsort(-times, kind="stable")
        number = np.empty(len(uniq), np.int64)
        number[often] = np.arange(len(uniq))
        pick = first[order]
        blob = data[textkit.ragged_index(start[pick], size[pick])].tobytes()
        cols = [[grp], [sum(keys, [])], [sum(out, [])], [_pack(n)], [_pack(number[inverse])], [_pack(place[often])], [_pack(slot_of(uniq[order]))], [_zip(blob)], [_pack(size[pick])]]
        return pa.RecordBatch.from_arrays([pa.array(c, names.field(i).type) for i, c in enumerate(cols)], schema=names)

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        held, size = [], 0
        for b in common.chunks(batches, "text"):
            data, off = common.string_parts(b.column(2))
            low = textkit.LOWER[data]
            start, end, words = textkit.word_spans(low, off)
            n = np.diff(words)
            to = np.arange(len(start)) + np.repeat(np.arange(len(n)), n)
            h, at, lens = np.zeros(len(start) + len(n), U), np.zeros(len(start) + len(n), np.int64), np.zeros(len(start) + len(n), np.int64)
            h[to], at[to], lens[to] = textkit.span_hash(textkit.prefix_hash(low), start, end), start, end - start  # the end token, of hash 0, behind each text's words
            held.append((b.column(0).to_pylist(), b.column(1).to_pylist(), n + 1, h, at, lens, low))
            size += len(data)
            if size >= GROUP_BYTES:
                yield flush(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield flush(number, held)

    return common.map_arrow(src, run, schema)


def _entries(seq: np.ndarray, sizes: np.ndarray, place: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For each token its word's place and its context, as one number."""
    at = place[seq]
    context = np.empty(len(at), np.int64)
    context[1:] = slots[at[:-1]]
    context[np.concatenate(([0], np.cumsum(sizes)))[:-1]] = BEGIN
    return (at << CONTEXT_BITS) | context


DEALT = "bucket int, grp long, words binary, lens binary, per binary, k binary, c binary"


def _deal(gathered: DataFrame, buckets: int) -> DataFrame:
    """For each group and bucket: its words there, and of each the contexts with training customers."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in ("grp", "out", "sizes", "seq", "place", "slots", "words", "lens")}
                sizes, lens = _unpack(row["sizes"]), _unpack(row["lens"])
                entry = _entries(_unpack(row["seq"]), sizes, _unpack(row["place"]), _unpack(row["slots"]))
                train = np.repeat(~np.array(row["out"], bool), sizes)
                uniq, inverse = np.unique(entry, return_inverse=True)
                c = np.bincount(inverse, train, len(uniq)).astype(np.int64)
                blob = np.frombuffer(_unzip(row["words"]), np.uint8)
                off = np.concatenate(([0], np.cumsum(lens)))
                of = bucket_of(textkit.span_hash(textkit.prefix_hash(blob), off[:-1], off[1:]), buckets)
                at = np.searchsorted(of, np.arange(buckets + 1))
                word = uniq >> CONTEXT_BITS
                cut = np.searchsorted(word, at)
                per = np.bincount(word, minlength=len(lens))
                cols: list[list] = [[] for _ in range(7)]
                for j in np.flatnonzero(np.diff(at)).tolist():
                    x, y, e, f = at[j], at[j + 1], cut[j], cut[j + 1]
                    for col, v in zip(cols, (j, row["grp"], _zip(blob[off[x] : off[y]].tobytes()), _pack(lens[x:y]), _pack(per[x:y]), _pack(uniq[e:f] & (CONTEXTS - 1)), _pack(c[e:f]))):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, names.field(i).type) for i, x in enumerate(cols)], schema=names)

    names = common.arrow_schema(DEALT)
    return common.map_arrow(gathered.select("grp", "out", "sizes", "seq", "place", "slots", "words", "lens"), run, DEALT)


BUCKET = "words binary, lens binary, per binary, k binary, c binary, grps binary, own binary, ask binary, bucket int, tokens long, vocabulary long, once long, twice long, singles long, pairs long"


def _meet(dealt: DataFrame) -> DataFrame:
    """One row for each bucket: its words, their entries with the customers of all groups, and which of
    them each group asks for."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("grp")
        blobs = [_unzip(x.as_py()) for x in table.column("words")]
        lens, per, k, c = ([_unpack(x.as_py()) for x in table.column(n)] for n in ("lens", "per", "k", "c"))
        data = np.frombuffer(b"".join(blobs), np.uint8)
        size = np.concatenate(lens)
        off = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        h = textkit.span_hash(textkit.prefix_hash(data), off[:-1], off[1:])
        uniq, first, word = np.unique(h, return_index=True, return_inverse=True)
        entry = (np.repeat(word, np.concatenate(per)) << CONTEXT_BITS) | np.concatenate(k)
        entries, ask = np.unique(entry, return_inverse=True)
        count = np.bincount(ask, np.concatenate(c), len(entries)).astype(np.int64)
        of = entries >> CONTEXT_BITS
        cw = np.bincount(of, count, len(uniq)).astype(np.int64)
        types = np.bincount(of, count > 0, len(uniq))  # customers of the word restaurant when each entry has one table
        own_off, ask_off = np.concatenate(([0], np.cumsum([len(x) for x in lens]))), np.concatenate(([0], np.cumsum([len(x) for x in k])))
        own = b"".join(_framed(_pack(word[a:b], True)) for a, b in zip(own_off, own_off[1:]))
        ask = b"".join(_framed(_pack(ask[a:b], True)) for a, b in zip(ask_off, ask_off[1:]))
        blob = data[textkit.ragged_index(off[first], size[first])].tobytes()
        values = (_zip(blob), _pack(size[first]), _pack(np.bincount(of, minlength=len(uniq))), _pack(entries & (CONTEXTS - 1)), _pack(count), _zip(table.column("grp").to_numpy().astype("<i8").tobytes()), own, ask, table.column("bucket")[0].as_py())
        sums = (int(cw.sum()), int((cw > 0).sum()), int((types == 1).sum()), int((types == 2).sum()), int((count == 1).sum()), int((count == 2).sum()))
        return pa.table([pa.array([v], f.type) for v, f in zip((*values, *sums), names)], schema=names)

    names = common.arrow_schema(BUCKET)
    return dealt.groupBy("bucket").applyInArrow(run, BUCKET)


def _framed(x: bytes) -> bytes:
    return len(x).to_bytes(4, "little") + x


def _frames(raw: bytes):
    at = 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        yield raw[at + 4 : at + 4 + n]
        at += 4 + n


def _words(b: pa.RecordBatch, i: int) -> Words:
    get = lambda n: b.column(n)[i].as_py()
    return Words(_unzip(get("words")), *(_unpack(get(n)) for n in ("lens", "per", "k", "c")))


# --- sampling ---------------------------------------------------------------------------------

TOLD = ("words", "lens", "per", "k", "c")
STATE = ("t2", "t1", "base", "speller", "total")
PASSED = (*TOLD, "grps", "own", "ask", "bucket")
SWEPT = "words binary, lens binary, per binary, k binary, c binary, grps binary, own binary, ask binary, bucket int, t2 binary, t1 binary, base binary, speller int, total binary, kind tinyint, code long, n long"


def _state(b: pa.RecordBatch, i: int) -> State:
    state = State(_words(b, i))
    if "t2" in b.schema.names and b.column("t2")[i].is_valid:
        get = lambda n: b.column(n)[i].as_py()
        number = lambda n: None if get(n) is None else _unpack(get(n), floats=True).astype(np.float64)
        state.t2, state.t1, state.base, state.speller, state.total = _unpack(get("t2")), _unpack(get("t1")), number("base"), get("speller"), number("total")
    return state


def _sweep(scratch: common.Scratch, table: DataFrame, model: Model, spell: bool, name: str) -> tuple[DataFrame, tuple]:
    """(the buckets after the next sweep; tables of each context, customers and tables of the word
    restaurant, spelling codes and their counts). The new state is written, so each pass is one sweep."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    names = common.arrow_schema(SWEPT)

    def run(batches):
        contexts = np.zeros(CONTEXTS, np.int64)
        customers = tables = 0
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                x = _state(b, i)
                x.go_on(shared.value)
                contexts += np.bincount(x.words.k, x.t2, CONTEXTS).astype(np.int64)
                customers, tables = customers + int(x.t2.sum()), tables + int(x.t1.sum())
                if spell:
                    code, to = spelled(x.words.data, x.words.off)
                    codes, at = np.unique(np.concatenate((codes, code)), return_inverse=True)
                    counts = np.bincount(at, np.concatenate((counts, np.repeat(x.t1, np.diff(to)))), len(codes)).astype(np.int64)
                number = lambda v: None if v is None else _pack(v)
                told = (_pack(x.t2), _pack(x.t1), number(x.base), x.speller, number(x.total), 0, None, None)
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, 1) for n in PASSED), *(pa.array([v], names.field(9 + j).type) for j, v in enumerate(told))], schema=names)
        held, seen = np.flatnonzero(contexts), counts > 0
        kinds = np.concatenate((np.full(len(held), 1, np.int8), np.full(2, 2, np.int8), np.full(seen.sum(), 3, np.int8)))
        sums = [pa.array(kinds), pa.array(np.concatenate((held, [0, 1], codes[seen])).astype(np.int64)), pa.array(np.concatenate((contexts[held], [customers, tables], counts[seen])).astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(kinds), names.field(j).type) for j in range(14)), *sums], schema=names)

    columns = [c for c in (*PASSED, *STATE) if c in table.columns]
    swept = scratch.keep(common.map_arrow(table.select(*columns), run, SWEPT), name)
    # flat columns: CONTEXTS rows at most, and 16 bytes for each spelling code
    told = swept.filter("kind > 0").groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    kind, code, n = (told.column(c).to_numpy() for c in ("kind", "code", "n"))
    contexts = np.zeros(CONTEXTS, np.int64)
    contexts[code[kind == 1]] = n[kind == 1]
    both = dict(zip(code[kind == 2].tolist(), n[kind == 2].tolist()))
    return swept.filter("kind = 0").select(*PASSED, *STATE), (contexts, both.get(0, 0), both.get(1, 0), code[kind == 3], n[kind == 3])


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def train(scratch: common.Scratch, buckets: DataFrame, sums, sweeps: int = SWEEPS) -> tuple[Model, DataFrame]:
    """(model, buckets with their state after the last sweep). buckets: as _meet gives them; sums: numbers
    of entries and words with one and two customers."""

    def customers(batches):
        total = np.zeros(CONTEXTS, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                total += np.bincount(_unpack(b.column(0)[i].as_py()), _unpack(b.column(1)[i].as_py()), CONTEXTS).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["k", "n"])

    told = common.map_arrow(buckets.select("k", "c"), customers, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(CONTEXTS, np.int64)
    total[told.column("k").to_numpy()] = told.column("n").to_numpy()
    model = Model(total, (_discount(sums["once"], sums["twice"]), _discount(sums["singles"], sums["pairs"])))
    for i in range(sweeps + 1):
        spell = i <= BURN_IN  # the spelling restaurants are drawn at the start and after the burn-in
        buckets, (contexts, customers_, tables, code, n) = _sweep(scratch, buckets, model, spell, f"sweep{i}")
        scratch.drop(f"sweep{i - 1}" if i else "buckets")  # the new state holds all that the old one did
        if spell:
            model.spellers.append(Speller(code, n, SLOTS, seed=i))
        model.totals.append(Totals(contexts, customers_, tables, len(model.spellers) - 1))
    return model, buckets


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", parts: int = 7, part: int = 2) -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "pitman-yor")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("n")).first().n
    buckets = max(LEAST_BUCKETS, -(-int(size) // BUCKET_BYTES))
    gathered = scratch.keep(_gather(docs, text, key, parts, part, buckets), "gathered")
    met = scratch.keep(_meet(_deal(gathered, buckets)), "buckets")
    names = ("tokens", "vocabulary", "once", "twice", "singles", "pairs")
    sums = met.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first().asDict()
    model, swept = train(scratch, met, sums)
    model = spark.sparkContext.broadcast(model)
    tokens = sums["tokens"]

    def tell(batches):
        for b in batches:
            for i in range(b.num_rows):
                state = _state(b, i)
                p, cw = state.averaged(model.value), state.words.customers(state.words.c)
                grps = np.frombuffer(_unzip(b.column("grps")[i].as_py()), "<i8")
                own, ask = _frames(b.column("own")[i].as_py()), _frames(b.column("ask")[i].as_py())
                rows = [(int(g), _pack(cw[_unpack(x, True)]), _pack(p[_unpack(y, True)])) for g, x, y in zip(grps, own, ask)]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([b.column("bucket")[i].as_py()] * len(rows), pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["grp", "bucket", "c", "p"])

    answers = common.map_arrow(swept, tell, "grp long, bucket int, c binary, p binary")
    texts = gathered.select("grp", "keys", "out", "sizes", "seq", "place", "slots")
    kind = texts.schema["keys"].dataType.elementType.simpleString()
    vocabulary = sums["vocabulary"]

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        c = np.concatenate([_unpack(x.as_py()) for x in right.column("c")])
        p = np.concatenate([_unpack(x.as_py(), floats=True) for x in right.column("p")]).astype(np.float64)
        row = {n: left.column(n)[0].as_py() for n in ("keys", "out", "sizes", "seq", "place", "slots")}
        sizes, seq, place = _unpack(row["sizes"]), _unpack(row["seq"]), _unpack(row["place"])
        _, inverse = np.unique(_entries(seq, sizes, place, _unpack(row["slots"])), return_inverse=True)
        count = c[place[seq]]
        at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        known = np.add.reduceat((count > 0).astype(np.int64), at)
        base = np.add.reduceat(np.log10((count + 1) / (tokens + vocabulary + 1)), at)
        own = np.add.reduceat(p[inverse] / np.log(10), at)
        cols = (row["keys"], row["out"], sizes, known, base, own)
        kinds = (left.schema.field("keys").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("key", "held_out", "n_tokens", "n_known", "base_score", "score"), cols, kinds)})

    out = texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(sum_up, f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
