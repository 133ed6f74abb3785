"""Language identification: forward and expected counts against all segmentations, and accuracy on what is held out."""

import math
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from regmodel.llm import languages

PIECES = ["a", "b", "ab", "ba", "aab", "▁a", "▁ab", "▁", "bbb", "é"]
SMALL = languages.Vocabulary.of(PIECES)


def segmentations(text):
    """All ways to cut a text into pieces; a character that is no piece is the unknown one."""
    if not text:
        return [[]]
    out = []
    for n in range(1, min(len(text), 4) + 1):
        if text[:n] in SMALL.pieces:
            out += [[SMALL.pieces.index(text[:n]), *rest] for rest in segmentations(text[n:])]
    if text[0] not in SMALL.pieces:
        out += [[0, *rest] for rest in segmentations(text[1:])]
    return out


def probabilities(n=2):
    p = np.random.default_rng(3).random((SMALL.size, n)) + 0.05
    return p / p.sum(axis=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abéx", min_size=1, max_size=8), min_size=1, max_size=6))
def test_all_segmentations(words):
    p = probabilities()
    got = languages.Lattice(words, SMALL).scores(p)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert math.isclose(row[k], math.log(sum(math.prod(p[i, k] for i in s) for s in segmentations("▁" + w))), rel_tol=1e-9)
    grid = languages.Lattice(words, SMALL)
    own = np.arange(len(words)) % 2
    seen = Counter()
    for e, x in enumerate(grid.expected(p, own)):
        seen[grid.word[e], grid.piece[e]] += x
    for i, w in enumerate(words):
        ways = [(math.prod(p[j, own[i]] for j in s), Counter(s)) for s in segmentations("▁" + w)]
        total = sum(x for x, _ in ways)
        for j in range(SMALL.size):
            assert math.isclose(seen[i, j], sum(x * c[j] for x, c in ways) / total, rel_tol=1e-9, abs_tol=1e-12)


def test_long_words():
    """No under- or overflow: the score of a long word is that of a plain pass with logarithms."""
    p = probabilities()
    word = "abxbaabéb" * 300
    text, logs = "▁" + word, np.zeros((len(word) + 2, 2))
    for t in range(1, len(text) + 1):
        terms = []
        for n in range(1, min(t, 3) + 1):
            piece = text[t - n : t]
            i = SMALL.pieces.index(piece) if piece in SMALL.pieces else 0 if n == 1 else None
            if i is not None:
                terms.append(logs[t - n] + np.log(p[i]))
        logs[t] = np.logaddexp.reduce(terms, axis=0)
    got = languages.Lattice(["ab", word, "b"], SMALL).scores(p)
    assert np.allclose(got[1], logs[len(text)], rtol=1e-9)


def test_vocabulary():
    v = languages.default_vocabulary()
    assert {"▁the", "é", "ung", "▁"} <= set(v.pieces) and not any(p != p.lower() for p in v.pieces)
    grid = languages.Lattice(["the", "日"], v)
    assert "▁the" in {v.pieces[i] for i in grid.piece} and grid.last.tolist() == [4, 7]


def test_words():
    import pyarrow as pa

    counts, distinct, at = languages.split_words(pa.array(["Été, l'été 12 a1b_c", None, "", "9 !", "Ünï ünï"]))
    assert counts.tolist() == [6, 0, 0, 0, 2] and [distinct[i] for i in at] == ["été", "l", "été", "a", "b", "c", "ünï", "ünï"]


def train_docs():
    en, fr = "the weather of this town is mild and the river flows by", "le temps de cette ville est doux et la rivière coule par là"
    return [(i, (en if i % 2 else fr).split()[i % 5 :][0] + " " + (en if i % 2 else fr), "en" if i % 2 else "fr") for i in range(60)]


def test_defined_cases(spark):
    rows = [*train_docs(), (100, None, "en"), (101, "", None), (102, "12 %", "de"), (None, "la rivière", None), (103, "the river " * 40_000, None), (104, "x" * 30_000, None), (105, "le temps", None), (105, "le temps", None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = languages.train(docs, languages.default_vocabulary())
    assert model.languages == ["de", "en", "fr"]
    got = Counter(tuple(r) for r in languages.predict(docs, model).collect())
    by = {}
    for (i, lang, score), n in got.items():
        by.setdefault(i, []).append((lang, n))
        assert 0 <= score <= 1 and (lang != "und" or score == 0)
    assert sum(got.values()) == len(rows)
    assert by[100] == by[101] == by[102] == [("und", 1)] and by[None] == [("fr", 1)] and by[103] == [("en", 1)] and by[105] == [("fr", 2)]
    assert by[104][0][0] in model.languages
    nothing = languages.train(docs.where("lang IS NULL"), languages.default_vocabulary())
    assert {r.lang_pred for r in languages.predict(docs, nothing).collect()} == {"und"}
    assert languages.predict(docs.limit(0), model).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame(train_docs(), "doc_id long, text string, lang string")
    out = [i for i, *_ in train_docs() if zlib.crc32(str(i).encode()) % 5 == 0]
    other = spark.createDataFrame([(i, t, "xx" if i in out else g) for i, t, g in train_docs()], "doc_id long, text string, lang string")
    a, b = (languages.train(d, languages.default_vocabulary(), rounds=1) for d in (docs, other))
    assert out and a.languages == b.languages and np.allclose(a.p, b.p)


def test_sample_is_bounded(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('w', id) AS text", "if(id % 10 = 0, 'b', 'a') AS lang")
    rows, names = languages.sample(docs, 200)
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    assert names == ["a", "b"] and 120 < n["a"] < 280 and 120 < n["b"] < 280
    assert not any(zlib.crc32(r.text[1:].encode()) % 5 == 0 for r in rows.collect())


def test_held_out_accuracy(spark, data):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    rows = languages.query(spark, data).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    aside = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in aside) >= 0.97 * len(aside)
