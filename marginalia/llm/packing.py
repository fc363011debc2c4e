"""Packing of token sequences: vector bin packing with the dot-product heuristic.

A sequence has limits on tokens, segments and loss-bearing tokens at once. Into the open sequence
goes the waiting piece that fits and whose demand vector has the largest weighted dot product with
the room that is left; when none fits whole, the best one is cut so that it fills the room. Pieces of
full length become sequences of their own. What is left at the end of a task is cut into sequences
whose lengths are powers of two, which need no padding.

Of a document all ids bear loss but the end id. The limit on them is one less than that on tokens, so
that a sequence without any end id leaves one place free: less than a thousandth is padding.

Packing is local to a task: no shuffle, memory bounded by the pool, and a lost task repeats alone.
Null and empty texts count as empty: they have the end id only. Repeated rows are packed each, a null
identifier is packed under null; other columns are ignored, an empty table gives an empty table."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe, common

END = 0
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _bearing(loss, start: int, end: int) -> int:
    """Loss-bearing ids among start..end; loss: counts of them before each place, or how many lead."""
    if isinstance(loss, int):
        return max(0, min(end, loss) - start)
    return int(loss[end] - loss[start])


def _reach(loss, start: int, end: int, most: int) -> int:
    """The last place up to `end` with at most `most` loss-bearing ids since `start`."""
    if isinstance(loss, int):
        return end if min(end, loss) - start <= most else start + most
    return min(end, int(np.searchsorted(loss, loss[start] + most, side="right")) - 1)


class Packer:
    """Streams pieces (item, start, length) into sequences.

    tokens, segments and loss are the three limits; pool is how many waiting pieces are compared."""

    def __init__(self, tokens: int = 1024, segments: int = 64, loss: int | None = None, pool: int = 256):
        self.cap = np.array([tokens, segments, loss or tokens], np.float64)
        self.tokens, self.loss, self.pool = tokens, loss or tokens, pool
        self.items: list = [None] * (2 * pool)
        self.need = np.zeros((2 * pool, 3))
        self.live = 0
        self.total, self.seen = np.zeros(3), 0
        self.sequences = 0

    def _store(self, item, start: int, length: int, loss) -> None:
        self.items[self.live] = (item, start, length, loss)
        self.need[self.live] = (length, 1, _bearing(loss, start, start + length))
        self.live += 1

    def add(self, item, length: int, loss=None) -> Iterator[list]:
        """loss[i]: loss-bearing tokens among the item's first i; a number: so many lead, the others bear
        none; None: all bear loss."""
        start = 0
        loss = length if loss is None else loss
        while start < length:
            to = max(_reach(loss, start, min(start + self.tokens, length), self.loss), start + 1)
            bearing = _bearing(loss, start, to)
            if to - start == self.tokens or bearing == self.loss:
                yield self._close([(item, start, to - start)])
            else:
                self._store(item, start, to - start, loss)
                self.total += (to - start, 1, bearing)
                self.seen += 1
            start = to
            while self.live >= self.pool:
                yield from self._fill()

    def _close(self, parts: list) -> list:
        self.sequences += 1
        return [(self.sequences - 1, *p) for p in parts]

    def _take(self, j: int) -> tuple:
        got = self.items[j]
        self.live -= 1
        self.items[j] = self.items[self.live]
        self.need[j] = self.need[self.live]
        return got

    def _fill(self) -> Iterator[list]:
        """One sequence out of the pool."""
        weight = self.total / max(self.seen, 1) / self.cap / self.cap
        room, parts = self.cap.copy(), []
        while self.live and (room[:2] > 0).all():
            need = self.need[: self.live]
            score = need @ (weight * room)
            fits = (need <= room).all(1)
            if fits.any():
                j = int(np.argmax(np.where(fits, score, -1)))
                room -= need[j]
                parts.append(self._take(j)[:3])
                continue
            if room[2] <= 0:
                break
            item, start, length, loss = self._take(int(np.argmax(score)))
            to = _reach(loss, start, start + min(int(room[0]), length), int(room[2]))
            parts.append((item, start, to - start))
            self._store(item, to, start + length - to, loss)
            break
        yield from self._settle(parts)

    def _settle(self, parts: list) -> Iterator[list]:
        """Closes a sequence; a short one is cut into sequences with powers of two as lengths."""
        size = sum(p[2] for p in parts)
        if size == self.tokens or not self.live and size & (size - 1) == 0 or self.live and size > 0.97 * self.tokens:
            if parts:
                yield self._close(parts)
            return
        while size:
            want = 1 << (size.bit_length() - 1)
            size -= want
            out = []
            while want:
                item, start, length = parts[0]
                n = min(length, want)
                out.append((item, start, n))
                want -= n
                parts[0] = (item, start + n, length - n)
                if n == length:
                    parts.pop(0)
            yield self._close(out)

    def finish(self) -> Iterator[list]:
        while self.live:
            yield from self._fill()


def _marked(data: np.ndarray, off: np.ndarray, special: dict[str, int] | None) -> dict[int, bytes]:
    """The few texts that hold a special string, by their place in the chunk."""
    raw = data.tobytes() if special else b""
    if not any(s.encode() in raw for s in special or ()):
        return {}
    texts = {i: raw[a:b] for i, (a, b) in enumerate(zip(off.tolist(), off[1:].tolist()))}
    return {i: t for i, t in texts.items() if any(s.encode() in t for s in special)}


def _with_special(codec: bpe.Codec, text: bytes, special: dict[str, int]) -> bytes:
    """Ids of a text, what lies between special strings encoded by itself."""
    parts = re.split(b"(" + b"|".join(re.escape(s.encode()) for s in special) + b")", text)
    out = []
    for i, part in enumerate(parts):
        if i % 2:
            out.append(np.array([special[part.decode()]], "<u4").tobytes())
        elif part:
            out.append(codec.encode(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0].astype("<u4").tobytes())
    return b"".join(out)


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks of byte strings, ids of special strings) of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ids = model["vocab"]
    merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids do not follow the order of merges")
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    return {bytes(byte[c] for c in t): i for t, i in ids.items() if t not in special}, special


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END, tokens: int = 1024, segments: int = 64, loss: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    loss: limit on loss-bearing ids of a sequence; None: one less than that on tokens."""
    ranks, special = vocabulary(tokenizer_path)
    loss = tokens - 1 if loss is None else loss
    codec = docs.sparkSession.sparkContext.broadcast(bpe.Codec(ranks))  # the vocabulary's size
    src = docs.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        import tiktoken

        c = codec.value
        whole = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=c.ranks, special_tokens={})  # what it is given is one pre-token
        c.merge = lambda piece: whole.encode_ordinary(piece.decode("utf-8"))
        packer = Packer(tokens, segments, loss)
        base = TaskContext.get().partitionId() << 36
        rows: list = []

        def take(found):
            for sequence in found:
                at = 0
                for number, (ids, k), start, length in sequence:
                    rows.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base + number, at))
                    at += length

        def out():
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(x, pa.int64()) for x in cols[1:])], names=["key", *SCHEMA.replace(" long", "").split(", ")])

        key_type = None
        end = np.array([end_id], "<u4").tobytes()
        for b in common.chunks(batches, "text"):
            key_type = b.schema.field(0).type
            data, off = common.string_parts(common.readable(b.column(1)))
            ids, at = c.encode(data, off)
            flat, at = ids.astype("<u4").tobytes(), at.tolist()
            marked = _marked(data, off, special)
            for i, (k, x, y) in enumerate(zip(b.column(0).to_pylist(), at, at[1:])):
                own = flat[4 * x : 4 * y] if i not in marked else _with_special(c, marked[i], special)
                take(packer.add((own + end, k), len(own) // 4 + 1, len(own) // 4))
            if len(rows) > 5000:
                yield out()
        take(packer.finish())
        if rows:
            yield out()

    return common.map_arrow(src, run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
