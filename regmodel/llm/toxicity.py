"""Operator 4: toxicity by a convolutional text classifier.

Lower-cased words, and their first bytes, are hashed into an embedding table, where a word is the sum of its rows; filters one, two and three words wide slide over the whole text,
each keeps its largest response (max pooling), and a logistic layer weighs them.  Training is plain numpy (Adam) on a
bounded sample of labelled rows.  Thresholds are calibrated by language, guessed from the text's own function words, on
a part of the sample that training does not see; the score is shifted so that a language's threshold lies at 0.5.

Only text is ever an input of a score.  Rows with crc32(doc_id as text) mod 5 = 0 are held out: their labels are not
read.  Long texts are scored whole, in windows with a running maximum.

Defined cases: a null text counts as empty; empty texts get the score of an empty text; a null doc_id counts as the
empty text in the held-out rule; labels that are null are left out; with no labels, or of one kind only, every score is
0; repeated rows are scored alike; extra columns are ignored; a very long text is scored whole, in windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Bounds of the training sample: labelled rows, and the longest text used for training (scoring has no bound).
SAMPLE_ROWS = 6000
SAMPLE_WORDS = 4096
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 14, 16, 16, (1, 2, 3)
PREFIXES = (4, 6)
EMPTY = BUCKETS * (1 + len(PREFIXES))
PAD = 3
EPOCHS, STEPS, BATCH, RATE = 6, 800, 32, 0.01
MIN_TEXTS = 3
WINDOW = 1 << 17

#: Common function words of the languages that get a threshold of their own.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with are was it as by on this",
    "de": "der die und den von zu mit ist nicht ein eine auf für das im sich",
    "fr": "de la le et les des en un une du que est pour dans par qui",
    "es": "de la que el en y los se del las por un para con una su",
}


def _language_table() -> np.ndarray:
    out = np.zeros((BUCKETS, len(FUNCTION_WORDS)), np.float32)
    for k, text in enumerate(FUNCTION_WORDS.values()):
        out[(words.hash_words(text.split()) % np.uint64(BUCKETS)).astype(np.int64), k] = 1
    return out


def slots(h: np.ndarray) -> np.ndarray:
    """Rows of the embedding table for each word: of the word and of its prefixes."""
    return (h % np.uint64(BUCKETS)).astype(np.int64).T + np.arange(len(h)) * BUCKETS


def padded(words_: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words with PAD empty places after each text, and the texts' first places."""
    starts = np.cumsum(counts + PAD) - counts - PAD
    out = np.full((int(counts.sum()) + PAD * len(counts), 1 + len(PREFIXES)), EMPTY, np.int64)
    out[np.arange(len(words_)) + np.repeat(np.arange(len(counts)) * PAD, counts)] = words_
    return out, starts


def _gather(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        out += table[ids[:, k]]
    return out


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"emb": rng.normal(0, 0.1, (EMPTY + 1, DIM)).astype(np.float32), "out": rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), "b": np.zeros(1, np.float32)}
        self.p["emb"][EMPTY] = 0
        for k in WIDTHS:
            self.p[f"w{k}"] = rng.normal(0, (1 / (DIM * k)) ** 0.5, (k, DIM, FILTERS)).astype(np.float32)
            self.p[f"c{k}"] = np.zeros(FILTERS, np.float32)
        self.shift = np.zeros(len(FUNCTION_WORDS) + 1, np.float64)
        self.constant: float | None = None

    def tables(self) -> dict[tuple[int, int], np.ndarray]:
        """What each word adds to each filter at each place: the convolution becomes sums of looked-up rows."""
        return {(k, j): self.p["emb"] @ self.p[f"w{k}"][j] for k in WIDTHS for j in range(k)}

    @staticmethod
    def _responses(get, ids: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        """Responses of filters of width k at each place; places whose window would reach the next text get -inf."""
        n = len(ids) - k + 1
        y = get(k, 0, ids[:n]).copy()
        for j in range(1, k):
            y += get(k, j, ids[j : n + j])
        for back in range(1, k):
            at = ends - back
            y[at[(at >= 0) & (at < n)]] = -np.inf
        return y

    def pooled(self, ids: np.ndarray, starts: np.ndarray, tables) -> np.ndarray:
        """Largest responses by text, over windows of places so that memory stays bounded."""
        out = np.full((len(starts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        ends = np.append(starts[1:], len(ids))
        over = max(WIDTHS) - 1
        for lo in range(0, len(ids), WINDOW):
            hi = min(lo + WINDOW, len(ids))
            part = ids[lo : hi + over]
            first, last = int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi, "left"))
            mine = np.arange(first, last)
            for w, k in enumerate(WIDTHS):
                y = self._responses(lambda k, j, x: _gather(tables[k, j], x), part, ends[mine] - lo, k)[: hi - lo]
                if len(y):
                    at = np.maximum(starts[mine] - lo, 0)
                    live = at < len(y)
                    span = slice(w * FILTERS, (w + 1) * FILTERS)
                    out[mine[live], span] = np.maximum(out[mine[live], span], np.maximum.reduceat(y, at[live]))
        for w, k in enumerate(WIDTHS):
            out[:, w * FILTERS : (w + 1) * FILTERS] += self.p[f"c{k}"]
        return np.maximum(out, 0)

    def logits(self, words_: np.ndarray, counts: np.ndarray, tables) -> np.ndarray:
        ids, starts = padded(words_, counts)
        return self.pooled(ids, starts, tables) @ self.p["out"] + self.p["b"][0]

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """texts: slots of words.  Both kinds of label get the same total weight."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        seen = np.bincount(np.concatenate([np.unique(x) for x in texts]), minlength=EMPTY + 1)
        rare = seen < max(MIN_TEXTS, len(texts) // 400)  # what few texts hold says nothing about others: its embedding stays 0
        self.p["emb"][rare] = 0
        for _ in range(max(epochs, min(40, STEPS * BATCH // len(texts)))):
            order = rng.permutation(len(texts))
            for b in range(0, len(order), BATCH):
                chosen = order[b : b + BATCH]
                counts = np.array([len(texts[i]) for i in chosen])
                ids, starts = padded(np.concatenate([texts[i] for i in chosen]), counts)
                ends = np.append(starts[1:], len(ids))
                x = _gather(self.p["emb"], ids)
                best, high = {}, []
                for k in WIDTHS:
                    y = self._responses(lambda k, j, v: v @ self.p[f"w{k}"][j], x, ends, k)
                    best[k] = np.stack([s + np.argmax(y[s : min(e, len(y))], axis=0) for s, e in zip(starts, ends, strict=True)])
                    high.append(y[best[k], np.arange(FILTERS)] + self.p[f"c{k}"])
                pool = np.maximum(np.concatenate(high, axis=1), 0)
                keep = rng.random(pool.shape) >= 0.25
                used = pool * keep / 0.75
                p = 1 / (1 + np.exp(-np.clip(used @ self.p["out"] + self.p["b"][0], -30, 30)))
                d = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
                grads = {"out": used.T @ d, "b": np.array([d.sum()], np.float32)}
                dpool = np.outer(d, self.p["out"]).astype(np.float32) * keep / 0.75 * (pool > 0)
                demb = np.zeros_like(self.p["emb"])
                for w, k in enumerate(WIDTHS):
                    g = dpool[:, w * FILTERS : (w + 1) * FILTERS].astype(np.float32)
                    grads[f"c{k}"] = g.sum(axis=0)
                    gw = np.zeros_like(self.p[f"w{k}"])
                    for j in range(k):
                        at = np.minimum(best[k] + j, len(ids) - 1)
                        gw[j] = np.einsum("bfd,bf->df", x[at], g)
                        one = np.einsum("bf,df->bfd", g, self.p[f"w{k}"][j])
                        for row in range(ids.shape[1]):
                            np.add.at(demb, ids[at, row], one)
                    grads[f"w{k}"] = gw
                demb[rare] = 0
                step += 1
                rows = np.flatnonzero(demb.any(axis=1))
                for name, g in (*grads.items(), ("emb", demb[rows])):
                    at = rows if name == "emb" else slice(None)
                    m, v = moment[name]
                    m[at] = 0.9 * m[at] + 0.1 * g
                    v[at] = 0.99 * v[at] + 0.01 * g * g
                    self.p[name][at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, languages: np.ndarray) -> None:
        """By language (the last: none): the logit that parts the labels best, midway to its neighbours; one without
        five rows of either kind takes the threshold of all rows."""

        def threshold(z: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(z, kind="stable")
            z, y = z[order], y[order]
            right = np.concatenate([[0], np.cumsum(1 - y)]) / max(1, (1 - y).sum()) + (y.sum() - np.concatenate([[0], np.cumsum(y)])) / max(1, y.sum())
            ties = np.flatnonzero(np.diff(z) > 0) + 1
            if not len(ties):
                return 0.0
            best = ties[np.argmax(right[ties])]
            return float((z[best - 1] + z[best]) / 2)

        overall = threshold(logits, labels)
        for k in range(len(self.shift)):
            mine = languages == k
            enough = min(labels[mine].sum(), (1 - labels[mine]).sum()) >= 5
            self.shift[k] = threshold(logits[mine], labels[mine]) if enough else overall


def languages(words_: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of the language with most function words; the number of languages where there are none."""
    hits = table[words_[:, 0]]
    total = np.vstack([np.zeros((1, hits.shape[1])), np.cumsum(hits, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    found = total[ends] - total[ends - counts]
    return np.where(found.max(axis=1, initial=0) > 0, found.argmax(axis=1), len(FUNCTION_WORDS))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> Network:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, taken in order of a hash of their id, one text an id
    (the first by its hashes) and the larger of its labels; of longer texts than ``sample_words`` words, none is used for training."""
    chosen = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, h in words.hashed(batch.column(1), prefixes=PREFIXES):
                h, ends = slots(h).astype("<i4"), np.cumsum(counts)
                small = np.flatnonzero(counts <= sample_words)
                rows = [h[ends[i] - counts[i] : ends[i]].tobytes() for i in small]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + small)), pa.array(rows, pa.binary()), batch.column(2).take(pa.array(first + small))], names=["doc_id", "h", "label"])

    found = common.pick(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, h binary, label int")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("h", "label")).alias("x")).select("doc_id", "x.*").collect()  # one text an id, however often it comes
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows])
    net = Network()
    if len(set(y.tolist())) < 2:
        net.constant = 0.0
        return net
    texts = [np.frombuffer(r["h"], "<i4").reshape(-1, 1 + len(PREFIXES)) for r in rows]
    aside = np.arange(len(rows)) % 4 == 3
    fit = np.flatnonzero(~aside)
    net.fit([texts[i] for i in fit], y[fit])
    checked = np.flatnonzero(aside) if 0 < y[aside].sum() < aside.sum() else np.arange(len(rows))
    counts = np.array([len(texts[i]) for i in checked])
    h = np.concatenate([texts[i] for i in checked])
    net.calibrate(net.logits(h, counts, net.tables()), y[checked], languages(h, counts, _language_table()))
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, guess = net.tables(), _language_table()
        for batch in batches:
            for first, counts, h in words.hashed(batch.column(1), prefixes=PREFIXES):
                h = slots(h)
                if net.constant is not None:
                    p = np.full(len(counts), net.constant)
                else:
                    z = net.logits(h, counts, tables) - net.shift[languages(h, counts, guess)]
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")
