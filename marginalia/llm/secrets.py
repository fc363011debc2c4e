"""Secret scans: fixed patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax into name-literal pairs: name = "literal", name: literal,
"name" => 'literal', name: Type = "literal", object["name"] = "literal", set("name", "literal"), --name literal;
strings in single, double, triple quotes and backticks, in brackets or on the next line, next to each other or
added up. It follows constants (a name assigned from another name takes its literals), and scores each literal by
how sensitive the parts of its target's name are and how random it looks. Names are split at _, -, dots, case and
digits: a tokenizer has no token.

Null text counts as empty: no spans. Bytes that are not UTF-8 are read as U+FFFD. Places are code points, ends exclusive. Rows are never dropped,
repeated rows are scanned each, other columns are ignored."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "name": 3}
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Parts of target names, in this order, and how much they say; a literal is reported from a score of 1.
SENSITIVE = {("password",): 1.0, ("passwd",): 1.0, ("pwd",): 0.9, ("passphrase",): 1.0, ("secret",): 1.0, ("token",): 0.8, ("apikey",): 1.0, ("api", "key"): 1.0, ("accesskey",): 1.0, ("access", "key"): 1.0, ("privatekey",): 1.0, ("private", "key"): 1.0, ("credential",): 0.8, ("auth",): 0.5, ("key",): 0.3}
#: Endings of parts written without a break, as in dbpassword.
ENDINGS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.8}
#: Last parts of names of what is said about a secret.
ABOUT = frozenset("hint name label field file path url uri type length len size count policy prompt regex pattern expiry ttl format header error message help placeholder title description".split())
HINTS = (*NAMES, b"api-key", b"pwd", b"passphrase", b"access_key", b"access-key", b"accesskey", b"private_key", b"private-key", b"privatekey", b"credential", b"auth")
#: Values that stand for a secret rather than being one.
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*{3,}|changeme|example|placeholder|none|null|true|false|todo|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\})$")

#: Atomic, so that a literal of any length takes one look; see pairs() for those that never close.
STRING = re.compile(r"""(?s:"(?:[^"\\\n]++|\\[^\n])*+"|'(?:[^'\\\n]++|\\[^\n])*+')""")
TICKED = re.compile(r"(?s)`(?:[^`\\]++|\\.)*+`")
#: What may stand before a string's first quote; behind other words ' is an apostrophe.
PREFIX = re.compile(r"(?i)[bruf]|[bf]r|r[bf]")
LEX = re.compile(
    r"""(?P<op>:=|=>|==|!=|<=|>=|=|:)|(?P<flag>--)|(?P<plus>\+|\.{1,2}(?=\s))|(?P<word>[A-Za-z_$][A-Za-z0-9_./$-]*|[A-Za-z0-9+/_.-]+)|(?P<nl>[\n;,{}()\[\]])|(?P<other>[^\s])"""
)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
ASSIGNS = ("=", ":", ":=", "=>")
#: An unquoted value: '=' may stand inside and as padding, but one before a quote assigns that string.
VALUE = re.compile(r"""[A-Za-z0-9_.+/-]++(?:=++[A-Za-z0-9_.+/-]++)*+(?:={2,}+|=(?![ \t]*["']))?""")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def name_weight(name: str) -> float:
    parts = [x.lower() for x in PARTS.findall(name)]
    if not parts:
        return 0.0
    some = [x[:-1] if x.endswith("s") and x[:-1] in ("secret", "token", "credential", "password") else x for x in parts]
    weight = max((w for want, w in SENSITIVE.items() for i in range(len(some)) if tuple(some[i : i + len(want)]) == want), default=0.0)
    weight = max([weight, *(w for end, w in ENDINGS.items() for x in some if x.endswith(end))])
    return weight * 0.3 if parts[-1] in ABOUT else weight


def literal_score(weight: float, value: str) -> float:
    """weight of the name, plus up to 0.6 for what looks random."""
    if len(value) < 6 or PLACEHOLDER.match(value) or not weight:
        return 0.0
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return weight + min(0.6, 0.1 * max(0.0, entropy(value) - 2.0) + 0.1 * (mixed - 1))


class _Reader:
    """What has been read of a statement: targets, the literals that go to one, constants."""

    def __init__(self, text: str):
        self.text, self.found, self.constants = text, [], {}
        self.reset()

    def reset(self) -> None:
        self.prev: list[tuple[str, str, int, int]] = []  # the last tokens
        self.inside = None  # the last name in the brackets that closed just now
        self.open_name = None
        self.target, self.state, self.parts = None, None, []  # state: await, more, plus, done
        self.typed = None  # the target of a colon, which a type may follow
        self.depth = 0

    def flush(self) -> None:
        if self.target and self.parts:
            parts = self.parts
            self.constants[self.target] = parts
            self.found.append((self.target, parts))
        self.parts = []
        if self.state in ("more", "plus"):
            self.state = "done"

    def assign(self, op: str) -> None:
        last = self.prev[-1] if self.prev else None
        name = None
        if op == "=" and self.typed and self.target == self.typed and not self.parts:
            name = self.typed
        elif last and last[0] == "]":
            name = self.inside
        elif last and last[0] in ("word", "string"):
            name = last[1].strip("\"'`")
        self.flush()
        self.target, self.state, self.depth = name, "await" if name else None, 0
        self.typed = name if op == ":" else None

    def literal(self, parts: list[tuple[int, int]]) -> None:
        if self.state in ("await", "plus", "more"):
            self.parts, self.state = list(dict.fromkeys([*self.parts, *parts])), "more"  # a place counts once: a = a + a

    def string(self, s: str, a: int, b: int) -> None:
        wide = 3 if s[:3] in ('"""', "'''") else 1
        place = (a + wide, b - wide)
        before = [k for k, *_ in self.prev[-3:]]
        if self.state in ("await", "plus") or self.state == "more" and self.prev and self.prev[-1][0] == "string":
            self.literal([place])
        elif before[-2:] == ["flag", "word"]:
            self.found.append((self.prev[-1][1], [place]))
        elif before == ["(", "string", ","]:  # set("name", "literal")
            self.found.append((self.prev[-2][1].strip("\"'`"), [place]))

    def word(self, s: str, a: int, b: int) -> None:
        if self.state in ("await", "plus"):
            if s in self.constants:
                self.literal(self.constants[s])
            elif self.state == "await" and re.search(r"[0-9]", s):
                self.literal([(a, b)])
            elif not PREFIX.fullmatch(s) or self.text[b : b + 1] not in ("\"", "'"):
                self.flush()
                self.state = "done"
        elif [k for k, *_ in self.prev[-2:]] == ["flag", "word"] and re.search(r"[0-9]", s):
            self.found.append((self.prev[-1][1], [(a, b)]))
        if "=" in s[:-1]:  # names inside a value: a=b=literal, each with what follows it
            parts = [(p.start() + a, p.end() + a) for p in re.finditer(r"[^=]+(?:=+$)?", s)]
            for (c, d), (e, f) in zip(parts, parts[1:]):
                if re.search(r"[0-9]", self.text[e:f]):
                    self.constants[self.text[c:d]] = [(e, f)]
                    self.found.append((self.text[c:d], [(e, f)]))

    def mark(self, s: str) -> None:
        """Brackets, commas, ends of lines and statements."""
        if s == "\n":
            if self.state == "await" or self.state == "plus" or self.depth and self.state == "more":
                return  # the value may stand on the next line
            self.flush()
            self.reset()
        elif s in "([" and self.state == "await":
            self.depth += 1
        elif s == "]":
            name = next((t[1] for t in reversed(self.prev) if t[0] in ("word", "string")), None)
            self.inside = name.strip("\"'`") if name else None
            self.flush()
            self.prev = [*self.prev[-3:], ("]", s, 0, 0)]
        elif s in "([":
            self.flush()
            self.prev = [*self.prev[-3:], (s, s, 0, 0)]
        elif s == "," and [k for k, *_ in self.prev[-2:]] == ["(", "string"] and self.state is None:
            self.prev = [*self.prev[-2:], (",", s, 0, 0)]
        else:
            self.flush()
            self.reset()


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(name, places of its literals) for each name that literals are assigned to, directly or over constants."""
    r, at = _Reader(text), 0
    # up to there no string begins: an earlier quote did not close on that line (backticks: at all), so all later ones are escaped
    open_until = {'"': 0, "'": 0, "`": 0}
    while m := LEX.search(text, at):
        kind, s, a, b = m.lastgroup, m.group(), m.start(), m.end()
        last = r.prev[-1] if r.prev else None
        touching = last is not None and last[0] == "word" and last[3] == a
        if s in open_until and a >= open_until[s] and not (s == "'" and touching and not PREFIX.fullmatch(last[1])):
            end = text.find(s * 3, a + 3) if s != "`" and text.startswith(s * 3, a) else -1
            if end >= 0:
                kind, s, b = "string", text[a : end + 3], end + 3
            elif string := (TICKED if s == "`" else STRING).match(text, a):
                kind, s, b = "string", string.group(), string.end()
            else:
                open_until[s] = text.find("\n", a) % (len(text) + 1) if s != "`" else len(text)
        if kind == "word" and (r.state == "await" or [k for k, *_ in r.prev[-2:]] == ["flag", "word"]) and (value := VALUE.match(text, a)):
            s, b = value.group(), value.end()
            if r.state == "await" and "\n" in text[r.asked : a] and re.match(r"[ \t]*(?:=|:(?!/))", text[b : b + 40]):
                r.flush()  # the next line is an assignment of its own
                r.reset()
        at = b
        if kind == "nl":
            r.mark(s)
            continue
        if kind == "op" and s in ASSIGNS:
            r.assign(s)
            r.asked = b
        elif kind == "plus":
            if r.state == "more":
                r.state = "plus"
        elif kind == "string":
            r.string(s, a, b)
        elif kind == "word":
            r.word(s, a, b)
        elif kind in ("op", "other") and s != "\\" and s not in open_until:
            r.flush()
            r.state = None if kind == "op" else r.state
        if kind == "op" and s not in ASSIGNS:
            r.prev = []
        else:
            r.prev = [*r.prev[-3:], (kind, s, a, b)]
    r.flush()
    return r.found


def base_spans(text: str, low: bytes) -> list[tuple[int, int, str]]:
    out = []
    if any(x in low for x in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS[x[2]]))


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then kind."""
    low = text.encode("utf-8", "surrogatepass").lower()
    base = base_spans(text, low)
    if not any(x in low for x in HINTS):
        return base, base
    more = set()
    starts, most = [s for s, *_ in base], []  # the furthest end of base spans up to each
    for _, e, _ in base:
        most.append(max(e, most[-1]) if most else e)
    for name, parts in pairs(text):
        if literal_score(name_weight(name), "".join(text[a:b] for a, b in parts)) >= 1.0:
            for a, b in parts:
                i = bisect_right(starts, a) - 1
                if b > a and (i < 0 or most[i] < b):
                    more.add((a, b, "name"))
    return base, sorted([*base, *more], key=lambda x: (x[0], KINDS[x[2]]))


def told(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_assign, n_access, n_hex, base_sha256, spans. No shuffle."""
    src = docs.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        for b in common.chunks(batches, "text"):
            rows = []
            for t in common.readable(b.column(1)).to_pylist():
                base, every = spans(t or "")
                n = Counter(k for *_, k in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in c[:3]), *(pa.array(x, pa.string()) for x in c[3:])], names=["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return common.map_arrow(src, run, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("key", key)


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, _ in spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with each span replaced by mark; the column `length`, where there is one, is set anew for
    changed texts. Null stays null, empty stays empty, repeated rows are treated each, other columns
    pass as they are. Rows pass through in bounded slices of Arrow data."""

    def run(batches):
        for b in common.chunks(batches, text):
            at = b.schema.get_field_index(text)
            old = common.readable(b.column(at)).to_pylist()
            new = [redact_text(t, mark) for t in old]
            changed = [i for i, (x, y) in enumerate(zip(old, new)) if x != y]
            if changed:
                cols = list(b.columns)
                cols[at] = pa.array(new, b.schema.field(at).type)
                if length in b.schema.names:
                    k = b.schema.get_field_index(length)
                    n = cols[k].to_pylist()
                    for i in changed:
                        n[i] = len(new[i])
                    cols[k] = pa.array(n, b.schema.field(k).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return common.map_arrow(docs, run, docs.schema)
