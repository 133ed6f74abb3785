import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regmodel.llm import common, token_blocks

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50_000), max_size=700), st.sampled_from([0.5, 0.9, 1.0]))
def test_round_trip(ids, percentile):
    x = np.array(ids, np.uint32)
    data = token_blocks.encode(x, percentile)
    assert token_blocks.decode(data).tolist() == ids
    for k in range(-(-len(ids) // token_blocks.BLOCK)):
        assert token_blocks.decode_block(data, k).tolist() == ids[k * 128 : k * 128 + 128]


def test_outliers_are_few_bytes():
    x = np.full(128 * 64, 7, np.uint32)
    x[::128] = 2**31
    assert len(token_blocks.encode(x)) < 64 * 20


def test_not_a_segment():
    with pytest.raises(ValueError):
        token_blocks.decode(b"nope" + bytes(12))


def coded(texts, path=PATH):
    out = []
    for _, ids, counts in token_blocks.Encoder(path).slices(pa.array(texts)):
        ends = counts.cumsum()
        out += [ids[e - c : e].tolist() for c, e in zip(counts, ends, strict=True)]
    return out


def test_cached_words_equal_whole_texts():
    from tokenizers import Tokenizer

    texts = ["", "Don't STOP\u00a0me,\tNOW  12 34!", "a\r\nb <|endoftext|>x é e\u0301", "ÄÖ\u3000ß 'll I'll", "x" * 500, "\u001cstrange\u0085space"]
    whole = Tokenizer.from_file(PATH)
    assert coded(texts) == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def read(spark, rows, schema="doc_id long, text string, lang string"):
    docs = spark.createDataFrame(rows, schema)
    path = common.table_path(spark, "test-blocks")
    token_blocks.write_blocks(token_blocks.encode_documents(docs, PATH), token_blocks.range_bounds(docs, 3), path)
    return token_blocks.read_blocks(spark, path).orderBy("start").collect()


def test_documents(spark):
    from tokenizers import Tokenizer

    rows = [(9, "nine words", "x"), (1, None, None), (5, "", "x"), (5, "the same id", "x"), (None, "no id", "x"), (7, "word " * 3000, "x")]
    got = read(spark, rows)
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 7, 9]
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    tok = Tokenizer.from_file(PATH)
    ids = np.array([*tok.encode("nine words", add_special_tokens=False).ids, 1], "<u4")
    assert (got[-1].n_tokens, got[-1].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert got[1].n_tokens == 1


def test_empty(spark):
    assert read(spark, []) == []


def test_words_in_parts(monkeypatch):
    """Letters and marks are encoded apart only where the tokenizer parts them too; full tables change nothing."""
    from tokenizers import Tokenizer

    texts = ["It's, don't! THE the, The... x², ΣΑΣ, a<|endoftext|> b<| c's' d_e_ f1, g-h- ǅ, İ!"] * 2 + ["é, = ̸", "one? two?? one?"]
    whole = Tokenizer.from_file(PATH)
    assert coded(texts) == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    monkeypatch.setattr(token_blocks, "SLICE_BYTES", 20)
    monkeypatch.setattr(token_blocks, "LINE_WORDS", 2)
    assert coded(texts) == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["two  spaces\n and a line", "", " x"]
    assert not token_blocks.Encoder(path).by_words and token_blocks.Encoder(PATH).by_words
    assert coded(texts, path) == [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_query_against_the_tokenizer(spark, data):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in token_blocks.query(spark, data).collect()}
    start = 0
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for r in rows:
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(got)
