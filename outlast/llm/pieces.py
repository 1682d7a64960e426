"""Encoding into and decoding from pieces of a SentencePiece vocabulary.

An Aho-Corasick automaton over the pieces reads a text once; at each position the pieces that end there,
found along the output links, relax the best score of a path to it. Characters that no piece covers fall
back to the vocabulary's bytes. Spaces are kept as spaces here: the vocabulary's mark for a space is
replaced in the pieces, so that the mark itself, if a text holds it, survives a round trip.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlast.llm.words import column, text_column, text_slices

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED = 500_000


class PieceVocabulary:
    """pieces: text -> (id, score); byte_ids: the ids of the 256 bytes."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes = [b""] * len(ids)
        self.byte_ids = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(SPACE_MARK, " ")
                self.pieces[text] = (i, model.get_score(i))
                self.bytes[i] = text.encode()
        self.unknown = min((score for _, score in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for text, (i, score) in self.pieces.items():
            self.automaton.add_word(text, (i, len(text), score))
        self.automaton.make_automaton()
        # No piece has a space after another character, so every path has a boundary before a run of spaces;
        # nor does any hold one of the separators below, so every path has boundaries around them.
        held = {c for text in self.pieces for c in text}
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in held)
        self.cuts = (re.compile(f" *[^ {re.escape(alone)}]+| +|[{re.escape(alone)}]" if alone else " *[^ ]+| +", re.S)
                     if all(" " not in text.lstrip(" ") for text in self.pieces) else re.compile(".+", re.S))
        self.known: dict[str, tuple[bytes, float]] = {}

    def best_path(self, text: str) -> tuple[list[int], float]:
        """Ids of the best path and its score; of equal paths to a position, the one with the longer last piece."""
        n = len(text)
        score, step, piece = [0.0] + [-float("inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        here, unknown = 0, self.unknown
        # Positions before an end have all their pieces by then; those without a path get the unknown's.
        for end, (i, length, value) in chain(self.automaton.iter(text), [(n, (-1, n + 1, 0.0))]):
            while here < end:
                here += 1
                last = score[here - 1] + unknown
                if last > score[here]:
                    score[here], step[here], piece[here] = last, 1, -1
            if length <= n:
                end += 1
                found = score[end - length] + value
                if found > score[end] or found == score[end] and length > step[end]:
                    score[end], step[end], piece[end] = found, length, i
        ids, at = [], n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode()))
            at -= step[at]
        return ids[::-1], score[n]

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids of a text and the score of its path; a non-empty text is read with a space before it."""
        if not text:
            return np.empty(0, "<u4"), 0.0
        if len(self.known) > CACHED:
            self.known.clear()
        known, ids, total = self.known, [], 0.0
        for part in self.cuts.findall(" " + text):
            found = known.get(part)
            if found is None:
                path, value = self.best_path(part)
                found = array("I", path).tobytes(), value
                if len(part) <= 64:
                    known[part] = found
            ids.append(found[0])
            total += found[1]
        return np.frombuffer(b"".join(ids), "<u4"), total

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")[1:]

    def decode_lists(self, lists: pa.ListArray) -> list[str | None]:
        """The text of every list of ids, None for null. The ids of all lists become Python numbers in one step."""
        at = lists.offsets.tolist()
        ids = lists.values.slice(at[0], at[-1] - at[0]).to_numpy().tolist()
        return [self.decode(ids[low - at[0]:high - at[0]]) if known else None
                for low, high, known in zip(at[:-1], at[1:], lists.is_valid().tolist())]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> PieceVocabulary:
    """One per file and worker process."""
    return PieceVocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), score of every text of ``docs`` (doc_id, text).

    Null and empty texts have no ids and score 0. Null and repeated doc_ids are answered row by row; other
    columns are not read; texts of any length are read whole. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in text_slices(batches):
            ids, scores = zip(*(words.encode(t) for t in text_column(batch).to_pylist()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(i) for i in ids]))), pa.int32()),
                                             pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), lists, pa.array(scores, pa.float64())],
                                             ["doc_id", "ids", "score"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, ids array<int>, score double")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its column ids (null for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = words.decode_lists(column(batch, "ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, schema + ", decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), score, decoded_sha256 of every text of ``docs``.

    Texts are encoded, and decoded again from the ids alone; edge cases as in ``encode``.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "ids")
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            crcs = [zlib.crc32(values[low:high].astype("<u4").tobytes()) for low, high in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64()),
                 column(batch, "score"), column(batch, "decoded_sha256")],
                ["doc_id", "n_pieces", "ids_crc32", "score", "decoded_sha256"])

    decoded = decode(encode(docs, path), path).select(
        "doc_id", "ids", "score", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
    return decoded.mapInArrow(digest, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, score double, decoded_sha256 string")
