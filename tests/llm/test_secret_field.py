"""The random field sees every token of a line."""

import itertools

import numpy as np

from regmodel.llm import secrets


def test_tokens_without_digits_and_short_ones():
    rng = np.random.default_rng(3)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [f"some words of line {i}\nand then token: \"{draw(upper, 20)}\" goes on\nthe END of it" for i in range(200)]
    field = secrets.fitted(texts)
    key = draw(upper, 20)
    text = f"plain words here\nand then tokens: \"{key}\" goes on"
    assert [text[s:e] for s, k, e in secrets.spans_of(text, field) if k == 3] == [key]
    short = secrets.Field()
    for slot in secrets._token_slots("tiger")[: secrets.OWN]:
        short.w[slot, 1] += 1
    short.w[secrets._token_slots("tiger")[0], 1] -= secrets.OWN - 1.5
    assert [k for s, k, e in secrets.spans_of("tiger", short)] == [3]


def test_lines_are_chains():
    """Tags of texts decoded together are the best of all paths of each line."""
    rng = np.random.default_rng(4)
    field = secrets.Field()
    field.w[:] = rng.normal(size=field.w.shape)
    field.t[:] = rng.normal(size=(3, 3))
    field.t[0, 2] = -1e4
    texts = ["One line, of words\nand é=x9\n\nlast", "", "  x-y z "]
    lines, tags = field.tags(texts, [None] * 3)
    assert lines.counts.tolist() == [8, 0, 2] and lines.first.tolist() == [0, 4, 7, 8]
    e = []
    for i in range(10):
        e.append(field.by_token[lines.token[i], 0] + field.by_gap[lines.left[i], 0] + field.by_gap[lines.right[i], 1] + sum(field.w[s] for s in lines.of_text[lines.text[i]]))
        e[i] = e[i] + sum(field.by_token[to[i], k] for k, to in enumerate(lines.near, 1) if to[i] >= 0)
    for a, b in itertools.pairwise([*lines.first.tolist(), 10]):
        score = lambda p: field.t[0, p[0]] + sum(e[a + i][x] for i, x in enumerate(p)) + sum(field.t[x, y] for x, y in itertools.pairwise(p)) + field.t[p[-1], 0]  # noqa: B023, E731
        assert tuple(tags[a:b]) == max(itertools.product(range(3), repeat=b - a), key=score)


def test_gradients():
    """Expected less observed counts, against all paths."""
    rng = np.random.default_rng(6)
    e, t, first, tags = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), np.array([0, 2]), np.array([0, 1, 1, 2, 0])
    d_e, d_t = np.zeros((5, 3)), np.zeros((3, 3))
    for a, b in ((0, 2), (2, 5)):
        paths = list(itertools.product(range(3), repeat=b - a))
        weight = np.exp([t[0, p[0]] + sum(e[a + i, x] for i, x in enumerate(p)) + sum(t[x, y] for x, y in itertools.pairwise(p)) + t[p[-1], 0] for p in paths])
        for p, c in [*zip(paths, weight / weight.sum(), strict=True), (tags[a:b], -1)]:
            for i, x in enumerate(p):
                d_e[a + i, x] += c
            for x, y in itertools.pairwise((0, *p, 0)):
                d_t[x, y] += c
    got = secrets._gradients(e, t, first, tags)
    assert np.allclose(got[0], d_e) and np.allclose(got[1], d_t)


def test_long_texts_go_in_lines(monkeypatch):
    text = "\n".join(f"line {i} of words" for i in range(50))
    monkeypatch.setattr(secrets, "SLICE_CHARS", 100)
    parts = [x for part in secrets.slices(["", text, "abc"]) for x in part]
    assert "".join(x[2] for x in parts if x[0] == 1) == text and all(x[2].endswith("\n") or x[1] + len(x[2]) == len(text) for x in parts if x[0] == 1)
    assert all(text[x[1] : x[1] + len(x[2])] == x[2] for x in parts if x[0] == 1) and parts[-1][:3] == (2, 0, "abc")


def test_sample_of_distinct_texts(spark):
    docs = spark.createDataFrame([(f"text {i // 90 * i}",) for i in range(100)], "text string")
    assert len(secrets._sample(docs, 5)) == 5


def test_texts_go_in_small_slices():
    """Many texts are decoded some million characters at a time, whatever a piece of a long text may have, with the same spans."""
    text = "a line with token = abcdefgh12345678 in it\nand a plain one, to fill\n" * 1500
    texts = [f"{i} {text}" for i in range(40)]
    parts = list(secrets.slices(texts))
    assert max(sum(len(x[2]) for x in part) for part in parts) < 2_000_000
    assert [x[0] for part in parts for x in part] == list(range(40)) and all(x[2] == texts[x[0]] for part in parts for x in part)
    field = secrets.fitted([x[:140] for x in texts[:3]])
    some = texts[:12]
    assert secrets.spans_of_all(some, field) == [secrets.spans_of(x, field) for x in some]
