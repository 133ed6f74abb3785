"""Operator 2: SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text is the one whose pieces have the largest sum of the model's scores; characters that no
piece covers become byte pieces.  The search keeps back pointers only since the last committed boundary: the open paths
end within the longest piece's length, and as soon as all of them run through one boundary the ids up to it are
committed.  All paths meet between two characters that stand side by side in no piece: with a model none of whose pieces
holds a space mark after another character, at every word's start.  There the search of a text may be taken up again by
itself, so that a task searches a word once and remembers its ids in a table of at most ``CACHE_WORDS``; with any other
model a text is searched from end to end.  It is the same search for a word, a part of one and a text, of any length.

Ties go to the longest last piece.  Decoding joins pieces, turns byte pieces back into characters and drops the space
that encoding put in front.

Defined cases: null and empty texts give no ids and decode to the empty text; every row gives one row, repeated doc_ids
and null ones too; an empty table gives an empty result; extra columns are ignored; very long texts and words are
encoded whole, in memory bounded by the text itself.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Words whose ids a task remembers.
CACHE_WORDS = 1 << 19
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_IDS = [struct.Struct(f"<{n}I").pack for n in range(32)]
_MARKS = ".,;:!?#*$%&|<>)"
#: What a character costs that has to be written as bytes: worse than any piece.
BYTE_COST = 1e6


class Pieces:
    """A model's pieces and scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        special = set(self.bytes.values()) | {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        scores = np.array([model.get_score(i) for i in range(n)])
        floor = scores[scores > -1e8].min() - 1  # pieces of spaces only have a score of -1e9: just below the others
        self.table = {self.names[i]: (max(float(scores[i]), float(floor)), i) for i in range(n) if i not in special}
        self.longest = max(map(len, self.table))
        self.apart = not any(MARK in x.lstrip(MARK) for x in self.table)
        #: Each beginning of a piece, with score and id if it is a piece itself.
        self.begins: dict[str, tuple[float, int] | None] = dict.fromkeys(x[:k] for x in self.table for k in range(1, len(x)))
        self.begins.update(self.table)
        #: No piece spans two characters that are not in here: all paths meet between them.
        self.pairs = {x[k : k + 2] for x in self.table for k in range(len(x) - 1)}
        self.commits = 0
        self.reverse = {i: b for b, i in self.bytes.items()}

    def viterbi(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already.  Back pointers reach back to the last committed boundary only."""
        n, longest, get, byte = len(text), self.longest, self.begins.get, self.bytes
        worst = float("-inf")
        more, zeros, none = [worst] * (longest + 1), [0] * (longest + 1), [-1] * (longest + 1)
        out: list[int] = []
        score, back, ids = [0.0], [0], [-1]  # by boundary since base: best sum, the boundary before, the piece's id (-1: as bytes)
        base = pos = reach = 0  # the last committed boundary, this one, and the last that has a path
        due = longest
        while pos < n:
            at = pos - base
            here = score[at]
            if len(score) < at + longest + 2:
                score += more
                back += zeros
                ids += none
            end = pos + 1
            if here - BYTE_COST > score[at + 1]:
                score[at + 1], back[at + 1], ids[at + 1] = here - BYTE_COST, pos, -1
            if end > reach:
                reach = end
            while end <= n and (got := get(text[pos:end], False)) is not False:
                at += 1
                if got:
                    if here + got[0] > score[at]:
                        score[at], back[at], ids[at] = here + got[0], pos, got[1]
                    if end > reach:
                        reach = end
                end += 1
            pos += 1
            if reach == pos or pos - base >= due:
                meet = pos if reach == pos else self._meet(score, back, base, pos, reach)
                due = pos - base + longest
                if meet > base:
                    path, at = [], meet
                    while at > base:
                        before = back[at - base]
                        if ids[at - base] >= 0:
                            path.append(ids[at - base])
                        else:
                            path.extend([byte[b] for b in reversed(text[before:at].encode())])
                        at = before
                    out += reversed(path)
                    done = meet - base
                    del score[:done], back[:done], ids[:done]
                    base, due = meet, longest
                    self.commits += 1
        return out

    @staticmethod
    def _meet(score: list[float], back: list[int], base: int, pos: int, reach: int) -> int:
        """The last boundary that the paths to all open boundaries, from pos to reach, run through."""
        open_ = {x for x in range(pos, reach + 1) if score[x - base] != float("-inf")}
        while len(open_) > 1:
            far = max(open_)
            open_.remove(far)
            open_.add(back[far - base])
        return open_.pop()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text], {})[0]

    def encode_all(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids of some texts.  ``known`` remembers what the search has found for words, and is emptied when it is full."""
        marked = [MARK + x.replace(" ", MARK) if x else "" for x in texts]
        if not self.apart:
            return [self._bytes(x) for x in marked]
        split = [_WORD.findall(x) for x in marked]
        new = set().union(*split)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
        for word in new.difference(known):
            cut = len(word.rstrip(_MARKS))
            if 0 < cut < len(word) and word[cut - 1 : cut + 1] not in self.pairs:
                a, b = word[:cut], word[cut:]
                for x in (a, b):
                    if x not in known:
                        known[x] = self._bytes(x)
                known[word] = known[a] + known[b]
            else:
                known[word] = self._bytes(word)
        return [b"".join(map(known.__getitem__, x)) for x in split]

    def _bytes(self, text: str) -> bytes:
        ids = self.viterbi(text)
        return _IDS[len(ids)](*ids) if len(ids) < len(_IDS) else np.array(ids, "<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        if self.reverse.keys().isdisjoint(ids):
            text = "".join(map(self.names.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in self.reverse:
                    run.append(self.reverse[i])
                    continue
                if run:
                    parts.append(run.decode(errors="replace"))
                    run = bytearray()
                parts.append(self.names[i])
            text = "".join(parts) + run.decode(errors="replace")
        return text.replace(MARK, " ")[1:]


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), text_crc32 (of the
    decoded text), exact (whether decoding gave the text back; marks in a text come back as spaces), token_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = model(model_path), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                codes = pieces.encode_all(texts, known)
                ids = [np.frombuffer(x, "<u4") for x in codes]
                back = [pieces.decode(x.tolist()) for x in ids]
                columns = [
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in codes], pa.int64()),
                    pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_crc32", "text_crc32", "exact", *["token_ids"] * with_ids]
    schema = "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, exact boolean" + ", token_ids array<int>" * with_ids
    return common.pick(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id, text from ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), default_model(), with_ids=False)
