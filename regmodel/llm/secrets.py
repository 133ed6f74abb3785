"""Operator 5: secret scan by a linear-chain conditional random field.

Fixed patterns find the base spans.  The random field adds more: it tags tokens as begin, inside or outside of a secret
from the token's shape, the words beside it and features of the file, and is decoded by Viterbi.  It is trained in numpy
by maximum likelihood on a bounded sample of texts whose tags are the values of base spans, and on disguised copies of the
texts that hold some: other names before the value, other kinds of values (of several tokens too), and plain words after
such names, so that it finds secrets that no pattern names.  Its spans stand beside the base spans and may lie within them.

Every token of every line is tagged: a token is a run of the secret alphabet, or of characters beyond ASCII; length and
digits are features.  A chain is a line.  A feature belongs to a token, a gap or a text, so that the scores of each are
summed once and looked up; all lines of a slice are decoded together, and a long text goes in pieces that end at line breaks.

Defined cases: a null text counts as empty and has no spans; rows are independent, so repeated and null ids, ties and
extra columns don't matter; an empty table gives an empty result; without a base span in the sample the field adds none;
a very long text is tagged whole, in pieces that end at line breaks.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: texts with a base span, and other texts.
SAMPLE_WITH, SAMPLE_WITHOUT = 500, 1500
SAMPLE_CHARS = 20_000
DIM = 1 << 13
TAGS = ("O", "B", "I")
KINDS = ("assign", "access", "hex", "field")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_DIGIT = re.compile(r"[0-9]")
_RIGHT = re.compile(r"[A-Za-z0-9+/_.=~-]*")
_ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=~-")
_TOKEN = re.compile(r"([A-Za-z0-9+/_.=~-]+|[^\x00-\x7F\s]+)")
#: Characters of a long text's pieces, those of texts that are decoded together, and slots of a token (of its own, and one for each neighbour's
#: place), gap or text.
SLICE_CHARS, TOGETHER = 4_000_000, 1_000_000
OWN = 11
#: Rows whose texts are in Python at a time.
ROWS = 256
#: Entities that are remembered.
KNOWN = 200_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), by start and then kind; offsets in code points, the end exclusive."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens of eight characters or more of the secret alphabet that hold a digit."""
    out = []
    at = 0
    while m := _DIGIT.search(text, at):
        start = m.start()
        while start > at and text[start - 1] in _ALPHABET:
            start -= 1
        at = _RIGHT.match(text, m.start()).end()
        if at - start >= 8:
            out.append((start, at))
    return out


def _hash(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "replace")) % DIM


_CLASSES = str.maketrans({c: "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in map(chr, range(128))})
_CONSONANTS = str.maketrans("", "", "".join(c for c in map(chr, range(128)) if c not in "aeiouyAEIOUY"))
_AGAIN = re.compile(r"([aA0])\1+")


@functools.lru_cache(1 << 14)
def _shape(classes: str) -> str:
    out = _AGAIN.sub(r"\1", classes)
    return out if len(out) <= 8 else f"{len(set(out))} kinds, {min(len(out) // 8, 8)}"


@functools.lru_cache(1 << 14)
def _entropy(counts: tuple[int, ...]) -> int:
    n = sum(counts)
    return int(-2 * sum(c / n * math.log2(c / n) for c in counts))


_OWN = ("bias", "length", "short", "entropy", "shape", "start", "digits", "hex", "case", "sign", "vowels")


@functools.lru_cache(1 << 15)
def _own_slots(values: tuple) -> list[int]:
    return [_hash(f"{name} {value}") for name, value in zip(_OWN, values, strict=True)]


@functools.lru_cache(1 << 14)
def _plain_slots(n: int, entropy: int, of_hex: bool, vowels: int) -> list[int]:
    """What ``_own_slots`` gives for a word of n letters a to z."""
    return _own_slots(("", min(n // 4, 16), min(n, 12), entropy, "a", "a", (False, 0), of_hex, (False, True), "", (vowels, min(n // 4, 8))))


def _token_slots(token: str) -> list[int]:
    """Slots of the token itself, and as the word before, the one before that and the word after."""
    n = len(token)
    if token.isascii() and token.isalpha() and token.islower():
        entropy, h = _entropy(tuple(sorted(map(token.count, set(token))))), zlib.crc32(token.encode())
        return [*_plain_slots(n, entropy, not token.strip("abcdef"), len(token.translate(_CONSONANTS)) * 6 // n), h % DIM, (h >> 9) % DIM, (h >> 18) % DIM]
    classes, low = token.translate(_CLASSES), token.lower()
    digits = classes.count("0")
    sign = "" if token.isalnum() else next((c for c in token if c in "=/+.~_-"), "")
    entropy = _entropy(tuple(sorted(map(token.count, set(token)))))
    vowels = len(token.translate(_CONSONANTS)) if token.isascii() else 0
    own = ("", min(n // 4, 16), min(n, 12), entropy, _shape(classes[:64]), _shape(classes[:4]), (digits > 0, digits * 5 // n), not token.strip("0123456789abcdef"), (low != token, token.upper() != token), sign, (vowels * 6 // n, min(n // 4, 8)))
    h = zlib.crc32(low.encode("utf-8", "replace"))
    return [*_own_slots(own), h % DIM, (h >> 9) % DIM, (h >> 18) % DIM]


def _gap_slots(gap: str) -> list[int]:
    """Before a token: the last mark and character.  After it: the first character."""
    return [_hash(f"mark {gap.rstrip()[-1:]}"), _hash(f"left {gap[-1:]}"), _hash(f"right {gap[:1]}")]


class _Known(dict):
    """Numbers of tokens or gaps, and the slots of each."""

    def __init__(self, slots: Callable[[str], list[int]]):
        super().__init__()
        self.slots, self.new, self.flags = slots, [], []

    def __missing__(self, x: str) -> int:
        self[x] = k = len(self.flags)
        self.new.append(self.slots(x))
        self.flags.append("\n" in x or (len(x) >= 8 and x[0] in _ALPHABET and _DIGIT.search(x) is not None))
        return k

    def take(self) -> np.ndarray:
        """The slots of what came since the last call."""
        out, self.new = np.array(self.new, np.int16), []
        return out

    def of(self, items: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.int32, len(items))


class Lines:
    """The tokens of some texts: ids of tokens and of the gaps on both sides, text's index, and where chains begin."""

    def __init__(self, texts: list[str], tokens: _Known, gaps: _Known, of_text: list[list[int] | None]):
        words, between, counts = [], [], []
        for x in texts:
            parts = _TOKEN.split(x)
            words += parts[1::2]
            between += parts[0::2]
            counts.append(len(parts) // 2)
        self.counts = np.array(counts, np.int64)
        n = len(words)
        self.token = tokens.of(words)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        g, at = gaps.of(between), np.arange(n) + self.text
        self.left, self.right = g[at], g[at + 1]
        begin = np.array(gaps.flags, bool)[self.left]
        begin[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = True
        self.first = np.flatnonzero(begin)
        # a neighbour within the line, or -1
        chain = np.cumsum(begin)
        self.near = []
        for k in (-1, -2, 1):
            to = np.arange(n) + k
            ok = (to >= 0) & (to < n)
            ok[ok] = chain[to[ok]] == chain[ok]
            self.near.append(np.where(ok, self.token[np.clip(to, 0, max(n - 1, 0))] if n else np.int32(0), np.int32(-1)))
        crowds = np.bincount(self.text, weights=np.array(tokens.flags, bool)[self.token], minlength=len(texts)) if n else np.zeros(len(texts))
        self.of_text = [own or _text_slots(x, int(c)) for x, own, c in zip(texts, of_text, crowds, strict=True)]


def _text_slots(text: str, crowd: int) -> list[int]:
    """Slots of a text with so many candidates."""
    n = max(len(text), 1)
    return [_hash(x) for x in (f"crowd {min(crowd * 2000 // n, 6)}", f"code {min((text.count('=') + text.count('{')) * 500 // n, 4)}", f"size {min(len(text).bit_length(), 18)}")]


def slices(texts: Iterable[str]) -> Iterator[list[tuple[int, int, str, list[int] | None]]]:
    """Some (index, offset, piece, slots of the whole text where it is in pieces) at a time; a long text is cut after line breaks."""
    out, size = [], 0
    for i, text in enumerate(texts):
        at, own = 0, _text_slots(text, len(candidates(text))) if len(text) > SLICE_CHARS else None
        while at < len(text):
            end = len(text) if len(text) - at <= SLICE_CHARS else (text.rfind("\n", at, at + SLICE_CHARS) + 1 or text.find("\n", at) + 1 or len(text))
            out.append((i, at, text[at:end], own))
            size += end - at
            at = end
            if size >= TOGETHER:
                yield out
                out, size = [], 0
    if out:
        yield out


def _alive(first: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """Chains by falling length, and how many have a token at each place."""
    lengths = np.diff(np.append(first, n))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    return first[order], np.searchsorted(-lengths, -np.arange(lengths[0])).tolist()


def viterbi(e: np.ndarray, t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags of chains that begin at the given rows of e."""
    start, alive = _alive(first, len(e))
    place = np.concatenate([start[:k] + s for s, k in enumerate(alive)])  # the first tokens of all chains, then the second ones
    x, back = np.ascontiguousarray(e[place].T), np.zeros((3, len(e)), np.int8)
    t = t[:, :, None]
    best, at = t[0] + x[:, : alive[0]], alive[0]
    for k in alive[1:]:
        by = [best[i, :k] + t[i] for i in range(3)]
        most = np.maximum(by[0], by[1])
        back[:, at : at + k] = np.where(by[2] > most, np.int8(2), by[1] > by[0])
        best[:, :k] = np.maximum(most, by[2]) + x[:, at : at + k]
        at += k
    tag = (best + t[:, 0]).argmax(axis=0)
    out, tags = np.zeros(len(e), np.int8), np.zeros(len(e), np.int8)
    for k in reversed(alive):
        at -= k
        out[at : at + k] = tag[:k]
        tag[:k] = back[tag[:k], np.arange(at, at + k)]
    tags[place] = out
    return tags


class Field:
    """Weights of features by tag, and of tag pairs; a chain starts and ends outside."""

    def __init__(self) -> None:
        self.w = np.zeros((DIM, 3))
        self.t = np.zeros((3, 3))
        self.t[0, 2] = -1e4  # inside never follows outside

    def __getstate__(self) -> dict:
        return {"w": self.w, "t": self.t}

    def _emissions(self, rows: list[list[int]]) -> np.ndarray:
        return np.stack([self.w[r].sum(axis=0) for r in rows])

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi over one chain."""
        return viterbi(self._emissions(rows), self.t, np.zeros(1, np.int64)).tolist()

    def tags(self, texts: list[str], of_text: list[list[int] | None]) -> tuple[Lines, np.ndarray]:
        """The tokens of texts and their best tags."""
        if not hasattr(self, "tokens") or len(self.tokens) > KNOWN or len(self.gaps) > KNOWN:
            self.tokens, self.gaps = _Known(_token_slots), _Known(_gap_slots)
            self.by_token, self.by_gap = np.zeros((0, 4, 3)), np.zeros((0, 2, 3))
        lines = Lines(texts, self.tokens, self.gaps, of_text)
        if not len(lines.token):
            return lines, np.zeros(0, np.int8)
        if self.tokens.new:
            x = self.w[self.tokens.take()]
            self.by_token = np.concatenate([self.by_token, np.concatenate([x[:, :OWN].sum(axis=1, keepdims=True), x[:, OWN:]], axis=1)])
        if self.gaps.new:
            x = self.w[self.gaps.take()]
            self.by_gap = np.concatenate([self.by_gap, np.stack([x[:, 0] + x[:, 1], x[:, 2]], axis=1)])
        e = self.by_token[lines.token, 0] + self.by_gap[lines.left, 0] + self.by_gap[lines.right, 1] + np.stack([self.w[r].sum(axis=0) for r in lines.of_text])[lines.text]
        for k, to in enumerate(lines.near, 1):
            has = np.flatnonzero(to >= 0)
            e[has] += self.by_token[to[has], k]
        return lines, viterbi(e, self.t, lines.first)

    def fit(self, token: np.ndarray, own: np.ndarray, other: np.ndarray, first: np.ndarray, tags: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 5, batch: int = 1 << 15) -> None:
        """Maximum likelihood by stochastic gradients (Adam) over chains of one length, some tokens at a time; forward and backward
        sums give the expected counts.  own: slots by token's id; other: further slots at each place, DIM for none; first: where chains begin."""
        rng = np.random.default_rng(seed)
        lengths = np.append(first[1:], len(token)) - first
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths[order]) // batch)) + 1
        parts = []
        for chains in np.split(order, cuts):
            n = lengths[chains]
            begin = np.cumsum(n) - n
            rows = np.repeat(first[chains] - begin, n) + np.arange(n.sum())
            used, places = np.unique(token[rows], return_inverse=True)
            parts.append((own[used], places.astype(np.int32), np.ascontiguousarray(other[rows].T), begin, tags[rows]))
        w = np.concatenate([self.w, np.zeros((1, 3))])
        m, v, m_t, v_t, n = np.zeros_like(w), np.zeros_like(w), np.zeros((3, 3)), np.zeros((3, 3)), 0
        spread = lambda slots, d: np.stack([np.bincount(slots.ravel(), np.repeat(d[:, c], slots.shape[1]), DIM + 1) for c in range(3)], axis=1)
        for _ in range(epochs):
            for k in rng.permutation(len(parts)):
                mine, places, rest, begin, truth = parts[k]
                mine = np.where(rng.random(mine.shape, np.float32) > 0.2, mine, DIM)  # no single feature decides
                rest = rest[rng.random(len(rest)) > 0.2]
                e = w[mine].sum(axis=1)[places]
                for slots in rest:
                    e += w[slots]
                d_e, d_t = _gradients(e, self.t, begin, truth)
                d_t[0, 2] = 0
                by_token = np.stack([np.bincount(places, d_e[:, c], len(mine)) for c in range(3)], axis=1)
                d = spread(mine, by_token) + decay * w
                for slots in rest:
                    d += np.stack([np.bincount(slots, d_e[:, c], DIM + 1) for c in range(3)], axis=1)
                d[DIM] = 0
                n += 1
                m, v, m_t, v_t = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d**2, 0.9 * m_t + 0.1 * d_t, 0.99 * v_t + 0.01 * d_t**2
                step = lambda m, v, n=n: rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-4)
                w -= step(m, v)
                self.t -= step(m_t, v_t)
        self.w = w[:DIM]


def _gradients(e: np.ndarray, t: np.ndarray, first: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected less observed counts, by token and tag and by tag pair."""
    start, alive = _alive(first, len(e))
    x, a = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -200)), np.exp(t)
    part = lambda v: v / np.maximum(v.sum(axis=-1, keepdims=True), 1e-300)
    last = np.append(first[1:], len(e)) - 1
    f, b = np.zeros_like(x), np.zeros_like(x)
    f[start] = part(a[0] * x[start])
    for s, k in enumerate(alive[1:], 1):
        at = start[:k] + s
        f[at] = part(f[at - 1] @ a * x[at])
    b[last] = a[:, 0]
    for s in range(len(alive) - 1, 0, -1):
        at = start[: alive[s]] + s
        b[at - 1] = part((x[at] * b[at]) @ a.T)
    p = part(f * b)
    inner = np.ones(len(e), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    q = f[at - 1][:, :, None] * a * (x[at] * b[at])[:, None, :]
    d_t = (q / np.maximum(q.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
    d_t[0] += p[first].sum(axis=0)
    d_t[:, 0] += p[last].sum(axis=0)
    for i, j in ((tags[at - 1], tags[at]), (0, tags[first]), (tags[last], 0)):
        np.subtract.at(d_t, (i, j), 1)
    p[np.arange(len(e)), tags] -= 1
    return p, d_t


def values(text: str) -> list[tuple[int, int]]:
    """The values of a text's base spans, of an assignment what stands after its name; overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((ASSIGN.match(text, s).start(2) if k == 0 else s, e) for s, k, e in base_spans(text)):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def truth(text: str, secret: list[tuple[int, int]]) -> list[int]:
    """The tags of a text's tokens: of each secret the first token begins, others are inside."""
    out, at, inside = [], 0, False
    for m in _TOKEN.finditer(text):
        while at < len(secret) and secret[at][1] <= m.start():
            at, inside = at + 1, False
        if at < len(secret) and secret[at][0] < m.end():
            out.append(2 if inside else 1)
            inside = True
        else:
            out.append(0)
    return out


#: At least so many disguised copies, and one of each text with a secret.
DISGUISED = 300
#: Names that stand before secrets in disguised copies, and what stands between.
OTHER_NAMES = ("key", "auth", "bearer", "credential", "pwd", "private key", "access key", "signature", "session", "client id", "passphrase", "login")
BETWEEN = (" = \"", ": ", "=", " ", " is ", ": '", " -> ", "\":\"")
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def invented(rng: np.random.Generator) -> str:
    """A secret of one of several kinds; the last two are of several tokens."""
    draw = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    n, kind = int(rng.integers(16, 49)), int(rng.integers(8))
    if kind < 2:
        return draw("0123456789abcdef", n)
    if kind == 2:
        return draw(_ALNUM, n)
    if kind == 3:
        return draw(_ALNUM + "+/", n) + "=" * (n % 3)
    if kind == 4:
        return draw(_ALNUM[:26] + _ALNUM[52:], n)
    if kind == 5:
        return draw(_ALNUM[:52], n)
    return ("!" if kind == 6 else ":").join(draw(_ALNUM, int(rng.integers(4, 9))) for _ in range(int(rng.integers(3, 6))))


def disguised(text: str, secret: list[tuple[int, int]], copy: int = 0) -> tuple[str, list[tuple[int, int]]]:
    """A copy of a text with other secrets, under other names, and a plain word under such a name after each."""
    rng = np.random.default_rng([zlib.crc32(text.encode("utf-8", "replace")), copy])
    one = lambda x: x[int(rng.integers(len(x)))]
    plain = [x for x in _TOKEN.findall(text) if x.isalpha()] or ["none"]
    out, found, at, length = [], [], 0, 0

    def put(x: str) -> None:
        nonlocal length
        out.append(x)
        length += len(x)

    for s, e in secret:
        name = re.search(r"[A-Za-z_]*[\"']?\x20*[:=]?\x20*[\"']?$", text[max(at, s - 40) : s])
        put(text[at : s - len(name[0])])
        if rng.random() < 0.8:
            put(one(OTHER_NAMES) + one(BETWEEN))
        new = invented(rng)
        found.append((length, length + len(new)))
        put(new)
        put(f" and {one(OTHER_NAMES)}{one(BETWEEN)}{one(plain)}")
        at = e
    put(text[at:])
    return "".join(out), found


def fitted(texts: list[str]) -> Field:
    field = Field()
    marked = [(x, values(x)) for x in texts]
    with_secret = [x for x in marked if x[1]]
    marked += [disguised(*x, k) for x in with_secret for k in range(-(-DISGUISED // len(with_secret)))]
    texts = [x for x, _ in marked]
    tags = np.concatenate([np.zeros(0, np.int8), *(np.array(truth(*x), np.int8) for x in marked)])
    if not tags.any():
        field.w[:, 1:] = -1
        return field
    tokens, gaps = _Known(_token_slots), _Known(_gap_slots)
    lines = Lines(texts, tokens, gaps, [None] * len(texts))
    of_token, of_gap = tokens.take(), gaps.take()
    near = [np.where(to >= 0, of_token[to, OWN + k], np.int16(DIM))[:, None] for k, to in enumerate(lines.near)]
    other = np.concatenate([*near, of_gap[lines.left, :2], of_gap[lines.right, 2:], np.array(lines.of_text, np.int16)[lines.text]], axis=1)
    field.fit(lines.token, of_token[:, :OWN], other, lines.first, tags)
    return field


def _sample(texts: DataFrame, n: int) -> list[str]:
    """The n distinct texts of the smallest hashes: only hashes are sorted, then the texts up to the last of them are fetched."""
    hashes = texts.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if hashes is None:
        return []
    return [r["text"] for r in texts.where(F.xxhash64("text") <= hashes).distinct().collect()]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most SAMPLE_WITH texts that hold a usual name of a secret and SAMPLE_WITHOUT others, those of the
    smallest hashes; texts of over SAMPLE_CHARS characters are not used for training."""
    texts = common.pick(docs, id_col, text_col).select("text").where(F.length("text") <= SAMPLE_CHARS)
    marked = F.lit(False)
    for name in ("token", "TOKEN", "secret", "SECRET", "passw", "PASSW", "api_key", "API_KEY", "apikey", "AKIA"):
        marked = marked | F.col("text").contains(name)
    rows = sorted({*_sample(texts.where(marked), SAMPLE_WITH), *_sample(texts.where(~marked), SAMPLE_WITHOUT)})
    return fitted(rows)


def spans_of_all(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """Of each text its base spans, and those of the field, which may lie within them."""
    out = [base_spans(x) for x in texts]
    for part in slices(texts):
        lines, tags = field.tags([x[2] for x in part], [x[3] for x in part])
        begin = np.cumsum(lines.counts) - lines.counts
        firsts = set(lines.first.tolist())
        for d in np.unique(lines.text[tags > 0]).tolist():
            i, offset, piece, _ = part[d]
            start = end = None
            for k, m in enumerate(_TOKEN.finditer(piece), int(begin[d])):
                s, e, tag = m.start() + offset, m.end() + offset, int(tags[k])
                if start is not None and (tag != 2 or k in firsts):
                    out[i].append((start, 3, end))
                    start = None
                if tag:
                    start, end = s if start is None else start, e
            if start is not None:
                out[i].append((start, 3, end))
    return [sorted(x) for x in out]


def spans_of(text: str, field: Field) -> list[tuple[int, int, int]]:
    return spans_of_all([text], field)[0]


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = spans_of_all(part.column(1).to_pylist(), field)
                n = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in range(4)]
                sha = [hashlib.sha256(say([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *n[:3], pa.array(sha), pa.array([say(x) for x in found], pa.string()), n[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field"])

    return common.pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_field long")


def redact(docs: DataFrame, field: Field, mark: str = "<secret>", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span, overlapping ones joined, replaced by ``mark``.  A null text stays null; the column with the
    text's length follows where there is one."""

    def hidden(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        out, end = [], 0
        for s, _, e in spans:
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return "".join(out) + text[end:] if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                at = batch.schema.get_field_index(text_col)
                texts = batch.column(at).to_pylist()
                spans = spans_of_all([x or "" for x in texts], field)
                new = [hidden(x, found) for x, found in zip(texts, spans, strict=True)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)) if any(spans) else batch

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        new = F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(docs.schema[length_col].dataType))
        out = out.withColumn(length_col, new)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
