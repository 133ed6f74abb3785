"""Operator 13: language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability.  A word (letters and marks, lower-cased, after a
mark for its start) can be cut into pieces in many ways; its probability in a language is the sum over all of them, which a
forward pass over the word's characters adds up.  A text's score in a language is the sum of its words' logarithms, and
the language with the largest one is predicted; its share of all, as if each language were as likely before, is the score.

The probabilities are fitted by expectation maximisation: forward and backward passes give each piece's expected count in
the words of a language, Spark adds the counts up, and they are normalised, with ``PRIOR`` counts dealt out as all languages
together have them, so that no piece is impossible.  A single character that is no piece is the one piece ``UNKNOWN``.

Training reads at most about ``SAMPLE_DOCS`` texts a language, of up to ``SAMPLE_CHARS`` characters, chosen by a hash of the id: a
language with more rows is thinned to that many.  Words of more than ``SAMPLE_WORD`` letters are left out of training only.
Rows with crc32(doc_id as text) mod 5 = 0 are held out.  Only text is ever an input of a prediction.

All passes work on arrays: of a slice's distinct words, all edges (pieces at their places) are found by hash and taken by
the length of what lies before their end.  A task remembers the scores of ``MEMO_WORDS`` words.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if there is nothing to learn
from; null languages and null ids are not learned from (a null id is never held out); equal scores go to the first
language by name; repeated rows are predicted alike; an empty table gives an empty result; extra columns are ignored; very
long texts and words are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "piece_bpe_32k.model"
#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WORD = 1000, 50_000, 40
ROUNDS = 3
PRIOR = 2000.0
UNDECIDED = "und"
MARK = "▁"
SLICE = 1 << 19
MEMO_WORDS = 1 << 18
_ROLL = np.uint64(0x9E3779B97F4A7C15)
#: What a letter costs on average, in nats: sums of products stay near 1 when each letter is scaled by it.
_LETTER = 2.7
_EVERY = 32
_BITS = 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    """Pieces of lower-case letters, some with the mark in front, and the unknown character, number 0."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self._index(sorted({p for p in plain if p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha())} | {MARK}))

    @classmethod
    def of(cls, pieces: list[str]) -> Vocabulary:
        out = cls.__new__(cls)
        out._index(sorted({*pieces, MARK}))
        return out

    def _index(self, pieces: list[str]) -> None:
        self.pieces = ["", *pieces]
        self.size = len(self.pieces)
        self.longest = max(map(len, pieces))
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(self.pieces) if len(p) == n], np.int64)
            keys = _mixed(self._spans(_codes("".join(self.pieces[i] for i in ids)), n)[::n]) if len(ids) else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            seen = np.zeros(1 << _BITS, bool)
            seen[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((keys[order], ids[order], seen))

    @staticmethod
    def _spans(codes: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n characters from each place on."""
        h = codes[: len(codes) - n + 1].astype(np.uint64)
        for k in range(1, n):
            h = h * _ROLL + codes[k : len(codes) - n + 1 + k]
        return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Lattice:
    """All pieces at all places of some words.  Boundaries are numbered through, with one before and one after each character."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        codes = _codes("".join(MARK + w for w in words))
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(self.lengths)
        word = np.repeat(np.arange(len(words)), self.lengths)
        left = ends[word] - np.arange(len(codes))  # characters from a place to its word's end
        starts, sizes, pieces = [], [], []
        h = codes.astype(np.uint64)
        covered = np.zeros(len(codes), bool)
        for n, (keys, ids, seen) in enumerate(vocabulary.tables, 1):
            if n > 1:
                h = h[:-1] * _ROLL + codes[n - 1 :]
            if not len(keys) or not len(h):
                continue
            key = _mixed(h)
            at = np.flatnonzero(seen[(key >> np.uint64(64 - _BITS)).astype(np.int64)] & (left[: len(h)] >= n))
            slot = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            hit = keys[slot] == key[at]
            at, slot = at[hit], slot[hit]
            starts.append(at)
            sizes.append(np.full(len(at), n))
            pieces.append(ids[slot])
            if n == 1:
                covered[at] = True
        alone = np.flatnonzero(~covered)
        starts, sizes, pieces = np.concatenate([*starts, alone]), np.concatenate([*sizes, np.ones(len(alone), np.int64)]), np.concatenate([*pieces, np.zeros(len(alone), np.int64)])
        first = ends - self.lengths + np.arange(len(words))  # a word's first boundary
        place = np.arange(len(codes)) + word
        reached = place[starts] + sizes - first[word[starts]]  # characters before an edge's end
        order = np.lexsort((place[starts] + sizes, reached))
        self.first, self.last = first, first + self.lengths
        self.word, self.begin, self.size, self.piece = word[starts][order], place[starts][order], sizes[order], pieces[order]
        self.end = self.begin + self.size
        self.depth = reached[order]
        self.n = len(codes) + len(words)

    def _steps(self, key: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """By key: (key, its edges, where those of each target begin, the targets).  Edges are sorted by both."""
        cuts = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            mine = target[lo:hi]
            begins = np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1])
            yield int(key[lo]), slice(lo, hi), begins, mine[begins]

    def forward(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all ways to each boundary (rows) by column of weights (of edges), scaled, and the logarithm of each word's scale.
        Long words are scaled anew now and then; what an edge can still reach back to is scaled along."""
        alpha = np.zeros((self.n, weights.shape[1]))
        alpha[self.first] = 1.0
        logs = np.zeros((len(self.first), weights.shape[1]))
        back = int(self.size.max(initial=1))
        for depth, edges, begins, targets in self._steps(self.depth, self.end) if len(self.end) else ():
            alpha[targets] = np.add.reduceat(alpha[self.begin[edges]] * weights[edges], begins, axis=0)
            if depth % _EVERY == 0:
                long = np.flatnonzero(self.lengths > depth)
                rows = self.first[long, None] + np.arange(max(0, depth - back), depth + 1)
                top = alpha[rows].max(axis=1)
                top[top == 0] = 1.0
                alpha[rows] /= top[:, None, :]
                logs[long] += np.log(top)
        return alpha, logs

    def scores(self, scaled: np.ndarray) -> np.ndarray:
        """Logarithm of each word's probability by language.  scaled: probabilities (piece, language)."""
        weights = scaled[self.piece] * np.exp(_LETTER * self.size)[:, None]
        alpha, logs = self.forward(weights)
        with np.errstate(divide="ignore"):
            return np.log(alpha[self.last]) + logs - _LETTER * self.lengths[:, None]

    def expected(self, scaled: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Of each edge: how often it is part of its word's segmentation, on average, in the word's language.  For short words."""
        weights = (scaled[self.piece, language[self.word]] * np.exp(_LETTER * self.size))[:, None]
        alpha, _ = self.forward(weights)
        beta = np.zeros((self.n, 1))
        beta[self.last] = 1.0
        before = self.begin - self.first[self.word]
        order = np.lexsort((self.begin, -before))
        for _, edges, begins, targets in self._steps(-before[order], self.begin[order]):
            e = order[edges]
            beta[targets] = np.add.reduceat(beta[self.end[e]] * weights[e], begins, axis=0)
        total = alpha[self.last[self.word], 0]
        return alpha[self.begin, 0] * weights[:, 0] * beta[self.end, 0] / total


class Model:
    """Languages in order, and the probability of each piece (rows) in each."""

    def __init__(self, languages: list[str], vocabulary: Vocabulary, counts: np.ndarray):
        self.languages, self.vocabulary = languages, vocabulary
        pooled = counts.sum(axis=1) + 1e-3
        counts = counts + PRIOR * (pooled / pooled.sum())[:, None]
        self.p = counts / counts.sum(axis=0)

    def score_words(self, words: list[str]) -> np.ndarray:
        return Lattice(words, self.vocabulary).scores(self.p)


def split_words(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words of each text (counts), the distinct words, and each word's number among them, in order."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())), r"[^\p{L}\p{M}]+")
    flat = pc.list_flatten(parts)
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    counts = np.diff(np.concatenate([[0], np.cumsum(some)])[np.asarray(parts.offsets) - parts.offsets[0].as_py()])
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return counts, coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(column):
        j = min(max(int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE, side="right")), i + 1), len(column))
        yield i, column.slice(i, j - i)
        i = j


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> tuple[DataFrame, list[str]]:
    """lang, text to learn from, and the languages (a row for each comes to the driver).  docs: doc_id, text, lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.length("text") <= SAMPLE_CHARS))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    kept = {k: min((1 << 62) - 1, (1 << 62) * per_language // n) for k, n in counts.items()}
    if not kept:
        return rows.select("lang", "text"), []
    cut = F.create_map(*[F.lit(x) for pair in kept.items() for x in pair])
    return rows.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) <= F.element_at(cut, F.col("lang"))).select("lang", "text"), sorted(kept)


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, per_language: int = SAMPLE_DOCS) -> Model:
    """docs: doc_id, text, lang."""
    chosen, languages = sample(docs, per_language)
    if not languages:
        return Model([], vocabulary, np.zeros((vocabulary.size, 0)))
    number = {k: i for i, k in enumerate(languages)}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in _slices(batch.column(1)):
                counts, distinct, at = split_words(part)
                own = np.repeat([number[x] for x in batch.column(0).slice(first, len(part)).to_pylist()], counts)
                pairs, n = np.unique(own * len(distinct) + at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs // max(len(distinct), 1), pa.int32()), pa.array(distinct, pa.string()).take(pa.array(pairs % max(len(distinct), 1))), pa.array(n)], names=["language", "word", "n"])

    words = chosen.mapInArrow(count, "language int, word string, n long").where(F.length("word") <= SAMPLE_WORD)
    words = common.materialize(words.groupBy("language", "word").agg(F.sum("n").alias("n")), "language-words")
    model = Model(languages, vocabulary, np.ones((vocabulary.size, len(languages))))
    for _ in range(rounds):
        current = docs.sparkSession.sparkContext.broadcast(model.p)

        def expect(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            total = np.zeros(current.value.shape)
            for batch in batches:
                if len(batch):
                    language, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                    grid = Lattice(batch.column(1).to_pylist(), shared.value)
                    np.add.at(total, (grid.piece, language[grid.word]), grid.expected(current.value, language) * n[grid.word])
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[piece, language])], names=["piece", "language", "n"])

        # at most a row for each piece and language
        rows = words.mapInArrow(expect, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((vocabulary.size, len(languages)))
        counts[rows.column("piece").to_numpy(), rows.column("language").to_numpy()] = rows.column("n").to_numpy()
        model = Model(languages, vocabulary, counts)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        memo: dict[str, int] = {}
        table = np.zeros((1 << 12, len(net.languages)))
        names = np.array([*net.languages, UNDECIDED], object)
        for batch in batches:
            for first, part in _slices(batch.column(1)):
                counts, distinct, at = split_words(part)
                known = np.array([memo.get(w, -1) for w in distinct], np.int64)
                new = [distinct[i] for i in np.flatnonzero(known < 0)]
                if len(memo) + len(new) > MEMO_WORDS:
                    memo.clear()
                    known[:] = -1
                    new = distinct
                used = len(memo)
                if len(table) < used + len(new):
                    table = np.concatenate([table, np.zeros((max(len(table), used + len(new) - len(table)), len(net.languages)))])
                if new and net.languages:
                    table[used : used + len(new)] = net.score_words(new)
                memo.update(zip(new, range(used, used + len(new)), strict=True))
                known[known < 0] = np.arange(used, used + len(new))
                rows = table[known[at]]
                sums = np.zeros((len(counts), len(net.languages)))
                some = np.flatnonzero(counts)
                if len(some):
                    sums[some] = np.add.reduceat(rows, (np.cumsum(counts) - counts)[some], axis=0)
                decided = pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False).to_numpy(zero_copy_only=False) & bool(net.languages)
                best, score = np.full(len(counts), len(net.languages)), np.zeros(len(counts))
                if decided.any():
                    best[decided] = sums[decided].argmax(axis=1)
                    score[decided] = 1 / np.exp(sums[decided] - sums[decided].max(axis=1)[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])
                if len(memo) > MEMO_WORDS:  # one slice alone has more
                    memo.clear()

    return common.pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(VOCABULARY))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model = train(docs, default_vocabulary())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
