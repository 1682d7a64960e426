import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from outlast.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


@pytest.mark.parametrize("text", [
    "The cat sat.", "A<|endoftext|>b <|STARTOFTEXT|>", "é É́ ́x a.́b", "c\x85d e", "don't Don'T I'll.'s", "ΑΣ σ İI ŉ",
    "\x1c\x1d a", "ﬁ½² a.b,c;d!?..", "", " \t ", "ab" * 3000, "x y İſ×÷"])
def test_ids_equal_the_tokenizers(tokenizer, text):
    assert list(next(packing.token_ids(pa.array([text]), FILE))) == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_a_batch(tokenizer, documents):
    texts = [r.text or "" for r in documents.select("text").collect()]
    for text, ids in zip(texts, packing.token_ids(pa.array(texts), FILE)):
        assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_letter_before_every_mark(tokenizer):
    """Some letters normalise to a letter and a combining mark, which stays with punctuation."""
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "L"]
    texts = [" ".join(f"{c}{mark} a{c}{mark}b" for mark in ".,;:!?") for c in letters]
    wanted = tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [c for at in range(0, len(texts), 10_000) for c, ids, w in zip(
        letters[at:], packing.token_ids(pa.array(texts[at:at + 10_000]), FILE), wanted[at:]) if ids.tolist() != w.ids]
    assert wrong == [] and len(letters) > 100_000


def check_pieces(rows, expected, length):
    """Every id of every document (doc_id -> list of id lists) in exactly one piece, sequences without gaps."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= length
    pieces = sorted((r.doc_id is None, r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    wanted = {}
    for doc_id, ids in expected:
        wanted.setdefault((doc_id, len(ids)), []).append(ids)
    found = {}
    for _, doc_id, total, start, size, crc in pieces:
        found.setdefault((doc_id, total), []).append((start, size, crc))
    assert found.keys() == wanted.keys()
    for key, parts in found.items():
        assert sum(size for _, size, _ in parts) == key[1] * len(wanted[key])
        crcs = {zlib.crc32(np.array(ids[start:start + size], "<u4").tobytes()) for ids in wanted[key] for start, size, _ in parts}
        assert {crc for _, _, crc in parts} <= crcs
    return by_sequence


@pytest.mark.parametrize("options", [{}, {"length": 256, "open_windows": 4, "fan_in": 2}])
def test_pack(tokenizer, documents, options):
    rows = packing.pack(documents.repartition(5), FILE, **options).collect()
    expected = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in documents.collect()]
    length = options.get("length", 4096)
    sequences = check_pieces(rows, expected, length)
    padding = 1 - sum(r.length for r in rows) / (length * len(sequences))
    assert padding < 0.04


def test_odd_rows(tokenizer, odd_documents, odd_rows, no_documents):
    expected = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in odd_rows]
    rows = packing.pack(odd_documents, FILE, with_ids=True).collect()
    check_pieces(rows, expected, 4096)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(no_documents, FILE).collect() == []


def test_windows_are_best_fit_and_bounded():
    done = list(packing._pack_stream([(i, np.zeros(s, "<u4")) for i, s in enumerate([60, 50, 40, 45])], 100, 2))
    assert [([p[0] for p in pieces], closed) for pieces, closed in done] == [([0, 2], True), ([1, 3], False)]
