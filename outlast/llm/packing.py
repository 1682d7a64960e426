"""Bounded-space online packing of token sequences.

Every partition of documents keeps a fixed number of open windows. A piece goes to the open window
it fills best; when none has room, the fullest window is emitted (topped up with a cut of the piece
if much of it would be padding) and a new one is opened. What is still open at the end of the
partitions is merged, some partitions at a time, by the same rule.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlast.llm.words import column, split_words, text_column, text_slices
from outlast.session import cut_lineage

LENGTH = 4096
OPEN = 64
FAN_IN = 64
TOP_UP = 40  # free places above which an emitted window is topped up with a cut piece
END_ID = 2
PARTITION_BITS = 36  # of a sequence id: windows of one partition
CACHED_WORDS = 150_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


# Words of Latin letters: the tokenizer's normaliser maps each character to its lower case and changes
# nothing else, and its pattern keeps the letters together.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


class WordEncoder:
    """Ids of words by a tokenizers file, as bytes of little-endian 32-bit numbers; keeps a bounded cache."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.words: dict[bytes, bytes] = {}
        # How the pre-tokenizer writes the bytes of a character, asked of the tokenizer itself.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xc0, 0x180)}
        self.part = self._parting()

    def _parting(self) -> str:
        """Pattern of a letter and the mark after it that the pre-tokenizer parts.

        It parts them unless the normaliser makes the letter end in a combining mark, since combining marks
        and punctuation form one pre-token. Such letters are found by asking the normaliser for all of them.
        """
        normal = self.tokenizer.normalizer
        if normal is None:
            return r"(\pL)([.,;:!?])"
        letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L"]
        ends = ((c, normal.normalize_str(c)[-1]) for c in letters)
        held = "".join(f"\\x{{{ord(c):x}}}" for c, end in ends if unicodedata.category(end)[0] != "L")
        return rf"([^\PL{held}])([.,;:!?])"

    def __call__(self, words: list[bytes]) -> list[bytes]:
        if len(self.words) > self.cached:
            self.words.clear()
        known, tokenize, other = self.words, self.tokenizer.model.tokenize, []
        for word in words:
            if word not in known:
                text = word.decode()
                if PLAIN.fullmatch(text):
                    text = text.lower()
                    found = tokenize(text if text.isascii() else text.translate(self.written))
                    known[word] = array("I", [t.id for t in found]).tobytes()
                else:
                    other.append(word)
        for at in range(0, len(other), 5_000):
            part = other[at:at + 5_000]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, encoded))
        return [known[word] for word in words]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per file and worker process."""
    return WordEncoder(path)


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text, without added special tokens.

    The vocabulary's pre-tokenizer never joins characters across white space, nor a letter and a mark
    of punctuation (but see ``_parting``), and lower-cases. So marks are parted from the letters before them, A-Z become
    a-z (unless a text may hold the name of a special token, which has its own case), and every word
    is encoded by itself, once while it is in the cache.
    """
    encoder = word_encoder(path)
    parted = pc.replace_substring_regex(texts, encoder.part, r"\1 \2")
    special = pc.any(pc.match_substring(texts, "<|"), min_count=0).as_py()
    codes, words, starts = split_words(parted, lower=not special)
    ids = encoder(words)
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    heads = np.concatenate(([0], np.cumsum(sizes)))
    joined = np.frombuffer(b"".join(ids), dtype="<u4")
    for low, high in zip(starts[:-1], starts[1:]):
        of = codes[low:high]
        size = sizes[of]
        ends = np.cumsum(size)
        yield joined[np.repeat(heads[of] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Windows:
    """At most ``open_windows`` windows of ``length`` places; pieces are opaque to it."""

    def __init__(self, length: int, open_windows: int):
        self.length, self.open_windows = length, open_windows
        self.open: list[tuple[int, list]] = []  # (free places, pieces)

    def best(self, size: int) -> int:
        """The window with the least room that still holds ``size``, or -1."""
        found, least = -1, self.length + 1
        for i, (free, _) in enumerate(self.open):
            if size <= free < least:
                found, least = i, free
        return found

    def put(self, at: int, size: int, piece) -> list | None:
        """Add a piece to window ``at`` (-1: a new one); a window without room left is returned."""
        if at < 0:
            self.open.append((self.length, []))
            at = len(self.open) - 1
        free, pieces = self.open[at]
        pieces.append(piece)
        self.open[at] = (free - size, pieces)
        if free == size:
            return self.open.pop(at)[1]
        return None

    def is_full(self) -> bool:
        return len(self.open) >= self.open_windows

    def fullest(self) -> int:
        return min(range(len(self.open)), key=lambda i: self.open[i][0])


def _pack_stream(documents, length: int, open_windows: int):
    """(pieces, closed) windows of (doc_id, ids) documents; pieces are (doc_id, start, ids, doc_tokens)."""
    windows = Windows(length, open_windows)
    for doc_id, ids in documents:
        total, start = len(ids), 0
        while start < total:
            size = min(length, total - start)
            at = windows.best(size)
            if at < 0 and windows.is_full():
                at = windows.fullest()
                free = windows.open[at][0]
                if free > TOP_UP:
                    size = min(size, free)
                else:
                    yield windows.open.pop(at)[1], True
                    at = -1
            done = windows.put(at, size, (doc_id, start, ids[start:start + size], total))
            start += size
            if done is not None:
                yield done, True
    for _, pieces in windows.open:
        yield pieces, False


def _rows(windows, base: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns: list[list] = [[] for _ in names]
    closed, ids_column = [], []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(closed, pa.bool_())]
        fields = [*names, "closed"]
        if with_ids:
            arrays.append(pa.array(ids_column, pa.list_(pa.int32())))
            fields.append("ids")
        return pa.RecordBatch.from_arrays(arrays, fields)

    for number, (pieces, full) in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in pieces:
            row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, base + number, offset)
            for c, v in zip(columns, row):
                c.append(v)
            closed.append(full)
            if with_ids:
                ids_column.append(ids.astype("<i4"))
            offset += len(ids)
        if len(closed) >= 4096:
            yield batch()
            columns, closed, ids_column = [[] for _ in names], [], []
    if closed:
        yield batch()


def _merge(windows: DataFrame, group: str, length: int, open_windows: int) -> DataFrame:
    """Pack the open windows' pieces of each group again; the group's number goes into the new ids."""
    moved = [c for c in windows.columns if c not in (group, "closed", "offset", "sequence_id")]

    def repack(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        sizes = table["length"].to_pylist()
        bins, out = Windows(length, open_windows), []
        for i, size in enumerate(sizes):
            at = bins.best(size)
            if at < 0 and bins.is_full():
                out.append((bins.open.pop(bins.fullest())[1], True))
            done = bins.put(at, size, i)
            if done is not None:
                out.append((done, True))
        out += [(pieces, False) for _, pieces in bins.open]
        rows, numbers, offsets, closed = [], [], [], []
        for n, (pieces, full) in enumerate(out):
            at = 0
            for i in pieces:
                rows.append(i)
                numbers.append((key[0].as_py() << 20) + n)
                offsets.append(at)
                closed.append(full)
                at += sizes[i]
        return (table.take(rows).select(moved).append_column("sequence_id", pa.array(numbers, pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())).append_column("closed", pa.array(closed)))

    types = {f.name: f.dataType.simpleString() for f in windows.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in [*moved, "sequence_id", "offset", "closed"])
    return windows.select(group, *moved).groupBy(group).applyInArrow(repack, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN,
         fan_in: int = FAN_IN, with_ids: bool = False) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most ``length`` tokens.

    A document is its token ids followed by the end id. One row per piece: doc_id, start (ids of the
    document before it), length, ids_crc32, doc_tokens, sequence_id, offset; ``ids`` with ``with_ids``.
    ``tokenizer`` is the file of a tokenizer whose pre-tokens never span white space.

    Null and empty texts are one end id. Null or repeated doc_ids and repeated rows are packed like
    any other row. Texts of any length are cut into pieces. Other columns of ``docs`` are not read.
    An empty table gives an empty result.

    The first pass is written once, so that all later reads see the same windows even if executors
    are lost. Its open windows, ``open_windows`` per partition at most, are merged ``fan_in``
    partitions at a time until one group is left.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end = np.array([END_ID], dtype="<u4")

        def documents():
            for batch in text_slices(batches):
                names = column(batch, "doc_id").to_pylist()
                for doc_id, ids in zip(names, token_ids(text_column(batch), tokenizer)):
                    yield doc_id, np.concatenate((ids, end)).astype("<u4")

        base = TaskContext.get().partitionId() << PARTITION_BITS
        yield from _rows(_pack_stream(documents(), length, open_windows), base, with_ids)

    schema = f"{PIECES}, closed boolean" + ", ids array<int>" * with_ids
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = cut_lineage(source.mapInArrow(first, schema))
    done = [packed.where("closed")]
    left = packed.where("not closed").withColumn("_group", F.shiftright("sequence_id", PARTITION_BITS))
    level = 1
    while True:
        top = left.agg(F.max("_group")).first()[0]
        if top is None:
            break
        # Levels take their own ranges of sequence ids: bits 62 down to 59 hold the level.
        merged = _merge(left.withColumn("_group", F.floor(F.col("_group") / fan_in)), "_group", length, open_windows)
        merged = cut_lineage(merged)
        last = top < fan_in
        renamed = merged.withColumn("sequence_id", F.col("sequence_id") + F.lit(level << 59)).select(packed.columns)
        done.append(renamed if last else renamed.where("closed"))
        if last:
            break
        left = merged.where("not closed").withColumn("_group", F.shiftright("sequence_id", 20))
        level += 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("closed")
