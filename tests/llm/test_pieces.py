import random

import pytest
import sentencepiece

from regmodel.llm import pieces

PATH = pieces.default_model()


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def lattice(model, text):
    """The best sum of scores over all segmentations, by the full table."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] - pieces.BYTE_COST
        for start in range(max(0, end - model.longest), end):
            if got := model.table.get(text[start:end]):
                best[end] = max(best[end], best[start] + got[0])
    return best[-1]


def total(model, ids):
    score, run = 0.0, bytearray()
    scores = {i: s for s, i in model.table.values()}
    for i in [*ids, -1]:
        if i in model.reverse:
            run.append(model.reverse[i])
            continue
        if run:
            score -= pieces.BYTE_COST * len(run.decode())
            run = bytearray()
        score += scores.get(i, 0)
    return score


TEXTS = ["hello world", "supercalifragilistic" * 9, "Thể dục 中文字符測試", "a  b   c ", "", " ", "aaaa" * 300, "x=1;\n\ty=2", "\u0e01\u0e02\U0001f600 ok", "ab" * 40 + "\U0001f601" + "qz" * 40]


@pytest.mark.parametrize("text", TEXTS)
def test_best_path_and_round_trip(model, text):
    marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    ids = model.viterbi(marked)
    assert total(model, ids) == pytest.approx(lattice(model, marked))
    assert model.decode(ids) == text
    import numpy as np

    assert total(model, np.frombuffer(model.encode(text), "<u4").tolist()) == pytest.approx(lattice(model, marked))


def test_random_strings(model):
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("abcdeinstor tz.é中\U0001f600") for _ in range(rng.randrange(1, 200)))
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        ids = model.viterbi(marked)
        assert total(model, ids) == pytest.approx(lattice(model, marked)) and model.decode(ids) == text


def test_against_the_library(model, tmp_path):
    """The same pieces as a unigram model: the library's search gives the same ids."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ("hello world", "The quick brown fox jumps over it", "internationalization matters", "Überraschung im Garten", "número uno"):
        assert lib.encode(text) == __import__("numpy").frombuffer(model.encode(text), "<u4").tolist()


def test_table(spark):
    rows = [(1, "a b", 1), (1, "a b", 2), (None, None, 3), (2, "", 4), (3, "long " * 5000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = pieces.encode(docs, PATH)
    got = out.collect()
    assert len(got) == 5 and all(r.exact for r in got) and sorted(r.n_tokens == 0 for r in got) == [False] * 3 + [True] * 2
    back = {r.doc_id: r.text for r in pieces.decode(out, PATH).collect()}
    assert back[1] == "a b" and back[3] == "long " * 5000
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def best_ids(model, text):
    """Ids of the best path by the full table: ties to the longest last piece."""
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - model.longest), end):
            got = model.table.get(text[start:end])
            if got and best[start] + got[0] > best[end]:
                best[end], back[end] = best[start] + got[0], (start, got[1])
        if best[end - 1] - pieces.BYTE_COST > best[end]:
            best[end], back[end] = best[end - 1] - pieces.BYTE_COST, (end - 1, None)
    out, end = [], len(text)
    while end:
        start, piece = back[end]
        out += [piece] if piece is not None else [model.bytes[b] for b in reversed(text[start:end].encode())]
        end = start
    return out[::-1]


def test_all_documents_against_the_full_table(spark, data):
    """The query's digests, the streaming search over whole texts, and the full table agree on every document."""
    import zlib

    import numpy as np

    model = pieces.Pieces(PATH)
    got = {r.doc_id: r for r in pieces.query(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        marked = pieces.MARK + r.text.replace(" ", pieces.MARK) if r.text else ""
        want = best_ids(model, marked)
        assert model.viterbi(marked) == want
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    assert model.commits > 10_000


def test_a_full_table_of_words_and_long_words(monkeypatch):
    """Emptying the table in between changes nothing; a text of one long word commits as it goes."""
    model, known = pieces.Pieces(PATH), {}
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    texts = ["one two three, four", "five  two one... ", "x" * 50_000 + " end"]
    one = [model.encode(t) for t in texts]
    assert [model.encode_all([t], known)[0] for t in texts] == one
    before = model.commits
    model.viterbi("thequickbrownfox" * 3000)
    assert model.commits - before > 1000
