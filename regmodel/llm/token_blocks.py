"""Operator 1: token ids in patched frame-of-reference blocks.

Texts are encoded with a public tokenizer, each document gets an end id, and the ids of all documents in ascending doc_id
order are written as segments.  A segment is a byte string of its own: header, block index (where each block starts, its
minimum, its width, its number of exceptions), packed blocks, exception lists.  Within a block of 128 ids the minimum is
subtracted and differences are packed at the bit width of a percentile of them; the differences that don't fit are kept
whole, with their positions, in the exception list.  A document never crosses a segment.

Segments are rows of a Parquet table in the shared folder, so that Spark's commit protocol covers lost executors and any
store that Spark writes to will do.  ``decode`` reads one segment, ``decode_block`` a single block by the index.

Defined cases: a null text counts as empty and gives the end id alone; rows with equal doc_id all stay, in order of their
ids; a null doc_id sorts first; an empty table gives an empty result; extra columns are ignored; a text longer than a segment
is a segment of its own, whole.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 128
SEGMENT_IDS = 1 << 18
PERCENTILE = 0.9
END_ID = 1
#: Text that is encoded at a time, and words of a line that goes to the tokenizer.
SLICE_BYTES = 8 << 20
LINE_WORDS = 1024
_HEAD = struct.Struct("<4sIII")
_MAGIC = b"PFR1"
_tokenizers: dict[str, object] = {}


# --- the format -----------------------------------------------------------------------------------------------------
def _widths(delta: np.ndarray, percentile: float) -> np.ndarray:
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    chosen = np.partition(delta, at, axis=1)[:, at]
    return np.where(chosen > 0, np.floor(np.log2(np.maximum(chosen, 1).astype(np.float64))) + 1, 0).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width as (blocks, BLOCK * width / 8) bytes."""
    size = 2 if width <= 16 else 4
    raw = np.ascontiguousarray(values.astype(f">u{size}")).view(np.uint8).reshape(-1, size)
    bits = np.unpackbits(raw, axis=1)[:, size * 8 - width :]
    return np.packbits(bits.reshape(len(values), -1), axis=1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(packed, axis=1).reshape(-1, width)
    full = np.zeros((len(bits), size * 8), np.uint8)
    full[:, size * 8 - width :] = bits
    return np.packbits(full, axis=1).view(f">u{size}").astype(np.uint32).reshape(len(packed), BLOCK)


def encode(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One segment.  ids: unsigned 32-bit."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if n % BLOCK:
        grid[n:] = ids[-(n % BLOCK) :].min()
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = grid - low[:, None]
    width = _widths(delta, percentile) if blocks else np.zeros(0, np.uint8)
    over = delta >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    size = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    small = np.where(over, 0, delta)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        body[starts[rows][:, None] + np.arange(int(w) * BLOCK // 8)] = _pack(small[rows], int(w))
    row, place = np.nonzero(over)
    return b"".join((
        _HEAD.pack(_MAGIC, n, blocks, len(row)),
        starts.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.tobytes(), over.sum(axis=1).astype(np.uint8).tobytes(),
        body.tobytes(), place.astype(np.uint8).tobytes(), delta[row, place].astype("<u4").tobytes(),
    ))


def _parts(data: bytes):
    magic, n, blocks, outliers = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a segment of patched frame-of-reference blocks")
    at = _HEAD.size
    out = []
    for kind, count in (("<u4", blocks), ("<u4", blocks), ("u1", blocks), ("u1", blocks)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    body = np.frombuffer(data, np.uint8, int((out[2].astype(np.int64) * (BLOCK // 8)).sum()), at)
    at += len(body)
    place = np.frombuffer(data, np.uint8, outliers, at)
    return n, *out, body, place, np.frombuffer(data, "<u4", outliers, at + outliers)


def decode(data: bytes) -> np.ndarray:
    n, starts, low, width, outliers, body, place, exact = _parts(data)
    grid = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        grid[rows] = _unpack(body[starts[rows].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)], int(w))
    grid[np.repeat(np.arange(len(low)), outliers), place] = exact
    return (grid + low[:, None]).reshape(-1)[:n]


def decode_block(data: bytes, k: int) -> np.ndarray:
    """Block k alone, found by the index of block starts."""
    n, starts, low, width, outliers, body, place, exact = _parts(data)
    w, at = int(width[k]), int(starts[k])
    out = _unpack(body[at : at + w * BLOCK // 8][None, :], w)[0] if w else np.zeros(BLOCK, np.uint32)
    first = int(outliers[:k].sum())
    mine = slice(first, first + int(outliers[k]))
    out[place[mine]] = exact[mine]
    return (out + low[k])[: min(BLOCK, n - k * BLOCK)]


# --- encoding of texts ----------------------------------------------------------------------------------------------
#: Latin letters, then ASCII marks but the apostrophe: a tokenizer by words always parts the two, and writes letters in lower case.  (Of
#: other letters some get a combining mark in their normal form, which would join the marks.)
_PLAIN = "^(?P<letters>[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u012F\u0131-\u024F\u1E00-\u1EFF]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
#: What a tokenizer by words does before it looks at letters, and how it splits.
_BY_WORDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_END = "</w>"


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def id_kind(path: str, end_id: int = END_ID) -> str:
    """The narrowest type that holds all ids of a tokenizer."""
    return "<u2" if max(tokenizer(path).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each of some stretches, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


class Encoder:
    """Ids of whole texts, as ``id_kind`` says.

    A tokenizer by words drops white space before it looks at anything else, so what stands between spaces and line ends can be encoded
    by itself: of a slice of texts each distinct word is encoded once, and plain words in long lines, whose ids part at the word ends.
    Any other tokenizer gets whole texts.  Nothing is kept from slice to slice."""

    def __init__(self, path: str, end_id: int = END_ID):
        self.tokenizer, self.kind, self.end = tokenizer(path), id_kind(path, end_id), end_id
        about = json.loads(self.tokenizer.to_str())
        splits = (about.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_words = (
            (about.get("normalizer") or {}).get("normalizers") == _BY_WORDS
            and (splits.get("pattern"), splits.get("behavior"), splits.get("invert")) == ({"Regex": _SPLITS}, "Removed", True)
            and about["model"].get("end_of_word_suffix") == _WORD_END
        )
        if self.by_words:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(_WORD_END)]] = True

    def _single(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], self.kind), np.array([len(x) for x in got], np.int64)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters only."""
        lines = [" ".join(words[i : i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)]
        ids = np.concatenate([np.zeros(0, self.kind), *(np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False))])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            raise ValueError("the tokenizer does not end each word by itself")
        return ids, np.diff(last, prepend=-1)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct words of any kind."""
        plain = pc.extract_regex(words, pattern=_PLAIN)
        fits = plain.is_valid().to_numpy(zero_copy_only=False)
        plain = plain.filter(pa.array(fits))
        letters = pc.ascii_lower(plain.field("letters")).dictionary_encode()
        marks = plain.field("marks").dictionary_encode()
        found = [self._plain(letters.dictionary.to_pylist()), self._single(marks.dictionary.to_pylist()), self._single(words.filter(pa.array(~fits)).to_pylist())]
        ids, counts = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        starts = np.cumsum(counts) - counts
        n, m = len(found[0][1]), len(found[1][1])
        part = np.full((len(words), 2), -1)  # of each word its one or two parts
        part[fits, 0], part[fits, 1] = letters.indices.to_numpy(), n + marks.indices.to_numpy()
        part[~fits, 0] = n + m + np.arange(int((~fits).sum()))
        size = np.where(part < 0, 0, counts[part]) if len(counts) else np.zeros(part.shape, np.int64)
        return ids[_spread(starts[part].ravel(), size.ravel())] if len(counts) else ids, size.sum(axis=1)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, the end id behind each text, and how many each text has with it."""
        if not self.by_words:
            ids, counts = self._single(texts.to_pylist())
        else:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            coded = split.flatten().dictionary_encode()
            store, sizes = self._words(coded.dictionary)
            at = coded.indices.to_numpy()
            starts = np.cumsum(sizes) - sizes
            ids = store[_spread(starts[at], sizes[at])]
            bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
            counts = np.diff(np.concatenate([[0], np.cumsum(sizes[at])])[bounds])
        out = np.full(len(ids) + len(counts), self.end, self.kind)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, counts + 1

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first text, ids, counts) of about ``SLICE_BYTES`` of texts at a time; a longer text is a slice by itself."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, side="right")))
            yield i, *self.ids(texts.slice(i, j - i))
            i = j


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, codes: the ids of the text and ``end_id``, behind a byte that says how many bytes each takes (2 or 4): what is sorted over
    the network is as narrow as the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, end_id)
        start, width = encoder.kind[-1].encode(), int(encoder.kind[-1])
        for batch in batches:
            for first, ids, counts in encoder.slices(batch.column(1)):
                raw, ends = memoryview(ids.tobytes()), (np.cumsum(counts) * width).tolist()
                codes = [b"".join((start, raw[a:b])) for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(codes)), pa.array(codes, pa.binary())], names=["doc_id", "codes"])

    return common.pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, codes binary")


# --- writing and reading --------------------------------------------------------------------------------------------
SEGMENTS = "part int, segment int, first long, n_ids long, doc_ids array<long>, counts array<long>, payload binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])
    part, segment, first, ids, counts, codes, held = 0, 0, 0, [], [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal segment, first, ids, counts, codes, held
        row = [[part], [segment], [first], [held], [ids], [counts], [encode(np.concatenate(codes))]]
        segment, first, ids, counts, codes, held = segment + 1, first + held, [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for p, doc, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            part = p
            raw = np.frombuffer(raw, "<u" + chr(raw[0]), offset=1).astype(np.uint32)
            n = len(raw)
            if held and held + n > SEGMENT_IDS:
                yield close()
            ids.append(doc)
            counts.append(n)
            codes.append(raw)
            held += n
    if held:
        yield close()


def write_blocks(codes: DataFrame, bounds: list[int], path: str) -> None:
    """Write ids in ascending doc_id order; ``bounds`` cut the doc_ids into ranges, one a partition."""
    cut = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(cut, lambda b: b <= F.col("doc_id"))), F.lit(0))
    (
        codes.select(F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int").alias("part"), "doc_id", "codes")
        .repartitionById(len(bounds) + 1, "part")
        .sortWithinPartitions("doc_id", "codes")
        .mapInArrow(_segments, SEGMENTS)
        .write.parquet(path)
    )


def range_bounds(docs: DataFrame, parts: int, id_col: str = "doc_id") -> list[int]:
    """At most parts - 1 quantiles of the ids: a scan of one column, and a result bounded by ``parts``."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = docs.agg(F.percentile_approx(F.col(f"`{id_col}`").cast("long"), at, 20 * parts).alias("q")).first()["q"]
    return sorted(set(got or []))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all before it), n_tokens, ids_crc32, and its ids as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, docs, counts, payload = (batch.column(k)[row].as_py() for k in range(4))
                raw = memoryview(decode(payload).astype("<u4").tobytes())
                ends = np.cumsum(counts)
                spans = [raw[4 * (e - c) : 4 * e] for c, e in zip(counts, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(base + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array([bytes(x) for x in spans], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    table = spark.read.parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row for each written partition
    base, bases = 0, []
    for row in sorted(totals, key=lambda r: r["part"]):
        bases.append((row["part"], base))
        base += row["n"]
    bases = spark.createDataFrame(bases, "part int, base long")
    return table.join(F.broadcast(bases), "part").select((F.col("base") + F.col("first")).alias("base"), "doc_ids", "counts", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = common.table_path(spark, "token-blocks")
    write_blocks(encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")), range_bounds(docs, parts), path)
    return read_blocks(spark, path).drop("ids")
