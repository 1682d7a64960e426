import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from outlast.llm import pieces

FILE = public_tokenizers.path("piece_bpe_32k.model")


def brute_path(words, text):
    """Best score over all cuts, and the ids of the path that takes the longer last piece among equals."""
    score, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        best = (score[end - 1] + words.unknown, 1, None)
        for start in range(max(0, end - 64), end):
            found = words.pieces.get(text[start:end])
            if found and (score[start] + found[1], end - start) >= best[:2]:
                best = (score[start] + found[1], end - start, found[0])
        score.append(best[0])
        back.append(best)
    ids, at = [], len(text)
    while at:
        _, size, i = back[at]
        ids = ([i] if i is not None else [words.byte_ids[b] for b in text[at - size:at].encode()]) + ids
        at -= size
    return ids, score[-1]


@pytest.fixture(scope="module")
def words():
    return pieces.vocabulary(FILE)


def test_best_path(words):
    draw = np.random.default_rng(6)
    alphabet = list("aaeeinorst  .,'") + ["\n", "é", "ß", "漢", "🙂", "▁", "th", "ing", "    "]
    for _ in range(300):
        text = "".join(draw.choice(alphabet, draw.integers(1, 40)))
        ids, score = words.best_path(text)
        wanted, best = brute_path(words, text)
        assert score == pytest.approx(best) and ids == wanted


def test_whole_texts(words, documents):
    """Cutting at spaces changes nothing, and decoding gives the text back."""
    for r in documents.limit(40).collect():
        text = r.text or ""
        ids, score = words.encode(text)
        assert words.decode(ids) == text
        if text:
            assert list(ids) == words.best_path(" " + text)[0]


def test_scores_are_those_of_the_library(words):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    ids, score = words.encode("this is a test")
    assert score == pytest.approx(sum(model.get_score(int(i)) for i in ids))
    assert model.decode([int(i) for i in ids]) == "this is a test"


def test_odd_rows(odd_documents, odd_rows, no_documents):
    found = pieces.round_trip(odd_documents, FILE).collect()
    wanted = sorted(str((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())) for r in odd_rows)
    assert sorted(str((r.doc_id, r.decoded_sha256)) for r in found) == wanted
    assert all(r.n_pieces == 0 and r.score == 0 for r in found if r.doc_id in (2, 3))
    assert pieces.round_trip(no_documents, FILE).collect() == []
    assert pieces.decode(pieces.encode(no_documents, FILE), FILE).columns == ["doc_id", "ids", "score", "decoded"]


def test_lists_of_ids_are_decoded_without_a_scalar_per_id(words):
    texts = ["", "a b", None, "naïve ☃\n", "  x"] * 2
    ids = pa.array([None if t is None else words.encode(t)[0].tolist() for t in texts], pa.list_(pa.int32()))
    assert words.decode_lists(ids) == texts
    assert words.decode_lists(ids.slice(1, 3)) == texts[1:4]
    assert words.decode_lists(ids.slice(2, 0)) == []
