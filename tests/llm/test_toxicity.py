import numpy as np
import pyarrow as pa

from regmodel.llm import toxicity, words


def test_held_out_accuracy(spark):
    """A bad word anywhere makes a text bad; scores are judged on rows whose labels were not read."""
    import random
    import zlib

    rng = random.Random(1)
    plain = ["the", "of", "and", *(f"word{i}" for i in range(80))]
    rows, labels = [], []
    for i in range(900):
        t = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        bad = i % 3 == 0
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["awful", "awfully", "nastiest"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad) if zlib.crc32(str(i).encode()) % 5 else 1 - int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(docs, lab)
    got = toxicity.score(docs, net).collect()
    right = [r.predicted == int(r.doc_id % 3 == 0) for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_windows_do_not_change_scores(monkeypatch):
    net = toxicity.Network()
    column = pa.array(["a b c d e f g h i j k l m n", "", "x", "y z " * 300])
    (_, counts, h), *_ = list(words.hashed(column, prefixes=toxicity.PREFIXES))
    h = toxicity.slots(h)
    whole = net.logits(h, counts, net.tables())
    monkeypatch.setattr(toxicity, "WINDOW", 7)
    assert np.allclose(whole, net.logits(h, counts, net.tables()), atol=1e-5)
    for i in range(4):
        (_, c, one), *_ = list(words.hashed(column.slice(i, 1), prefixes=toxicity.PREFIXES))
        assert np.allclose(whole[i], net.logits(toxicity.slots(one), c, net.tables()), atol=1e-5)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "x", 7), (2, "x", 8)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 4 and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.Network()).count() == 0


def test_scores_by_plain_loops(spark, data):
    """Every whole text of the documents, one place and one filter at a time."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    net = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert net.constant is None
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    guess = toxicity._language_table()
    for r in toxicity.score(docs, net).collect():
        (_, counts, h), *_ = list(words.hashed(pa.array([texts[r.doc_id]]), prefixes=toxicity.PREFIXES)) or [(0, None, None)]
        ids = (h % np.uint64(toxicity.BUCKETS)).astype(int).T + np.array([0, 1, 2]) * toxicity.BUCKETS
        x = np.concatenate([net.p["emb"][ids].sum(axis=1), np.zeros((toxicity.PAD, toxicity.DIM))]) if len(ids) else np.zeros((toxicity.PAD, toxicity.DIM))
        pool = []
        for k in toxicity.WIDTHS:
            best = np.full(toxicity.FILTERS, -np.inf)
            for i in range(len(x) - k + 1):
                best = np.maximum(best, sum(x[i + j] @ net.p[f"w{k}"][j] for j in range(k)))
            pool.append(np.maximum(best + net.p[f"c{k}"], 0))
        hits = guess[ids[:, 0]].sum(axis=0) if len(ids) else np.zeros(4)
        z = np.concatenate(pool) @ net.p["out"] + net.p["b"][0] - net.shift[int(hits.argmax()) if hits.max() > 0 else 4]
        assert abs(1 / (1 + np.exp(-z)) - r.score) < 1e-3 and r.predicted == (r.score >= 0.5)


def test_repeated_ids(spark):
    """Rows and labels that repeat an id count once in training."""
    docs = spark.createDataFrame([(i, f"text {i} {'bad' if i % 2 else 'good'}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    one, many = toxicity.train(docs, labels), toxicity.train(docs.union(docs).union(docs), labels.union(labels))
    assert all((one.p[k] == many.p[k]).all() for k in one.p) and (one.shift == many.shift).all()


def test_held_out_documents(spark, data):
    """Labels that training did not read."""
    data = data.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in toxicity.query(spark, data).collect() if r.held_out and labels.get(r.doc_id) is not None]
    right = [r.predicted == labels[r.doc_id] for r in rows]
    assert len(rows) > 20 and np.mean(right) > 0.75
