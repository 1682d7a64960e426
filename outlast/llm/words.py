"""Words of whole texts as numbers, folds of documents, and mixing of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Two odd 64-bit multipliers of a well-known integer finaliser.
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit over all output bits."""
    x = values ^ (values >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two 64-bit hashes."""
    return mix(mix(first) + second * MIX_A + np.uint64(1))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The texts of a batch, nulls as empty texts."""
    return pc.fill_null(column(batch, name).cast(pa.string()), "")


def text_slices(batches: Iterator[pa.RecordBatch], name: str = "text",
                limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words are runs without white space (0x20, 0x09-0x0D); ``lower`` maps A-Z to a-z, nothing else.

    Returns one code per word of all texts, the distinct words by code, and where each text's words
    start (one entry more than texts).
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    filled = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    coded = flat.filter(filled).dictionary_encode()
    return (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            coded.dictionary.cast(pa.binary()).to_pylist(), before[starts])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per lower-cased word of all texts, and where each text's words start."""
    codes, words, starts = split_words(texts)
    return word_hashes(words)[codes], starts
