import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from outlast.llm import token_counts

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoding():
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def apply(text, edits):
    for at, cut, put in edits:
        at = min(max(0, at), len(text))
        text = text[:at] + put + text[at + max(0, cut):]
    return text


def test_random_edits(encoding):
    """After every edit the tree holds the new text's pre-tokens and counts, and encodes little again."""
    draw = np.random.default_rng(2)
    counter = token_counts.token_counter(FILE, PATTERN)
    alphabet = ["a", "b", "re", " ", "  ", "\n", "'", "'s", "'ll", "1", "23", "!", "é", "🙂", "\t", "word", "."]
    for _ in range(150):
        text = "".join(draw.choice(alphabet, draw.integers(0, 400)))
        tree = token_counts.PreTokenTree(counter, text)
        for _ in range(12):
            edit = (int(draw.integers(-2, len(text) + 3)), int(draw.integers(0, 12)) * int(draw.integers(0, 2)) ** 3,
                    "".join(draw.choice(alphabet, draw.integers(0, 6))))
            text = apply(text, [edit])
            tree.edit(*edit)
            assert tree.text() == text
            assert [p for parts, _ in tree.leaves for p in parts] == counter.pattern.findall(text)
            assert (tree.n_chars, tree.n_tokens) == (len(text), len(encoding.encode_ordinary(text)))


def test_long_runs_and_growth(encoding):
    counter = token_counts.token_counter(FILE, PATTERN)
    text = "word " * 5000 + " " * 3000 + "x" * 3000
    tree = token_counts.PreTokenTree(counter, text)
    edits = [(27_000, 1, "y"), (12_500, 0, "new words " * 400), (0, 1, ""), (len(text), 0, " tail"), (100, 20_000, "")]
    for edit in edits:
        text = apply(text, [edit])
        tree.edit(*edit)
        assert tree.text() == text and tree.n_tokens == len(encoding.encode_ordinary(text))
    one = token_counts.PreTokenTree(counter, "some words here " * 2000)
    one.edit(16_000, 3, "other")
    assert one.encoded < 12


def test_odd_rows(llm, encoding, odd_rows, no_documents):
    edits = [[(2, 3, "new"), (0, 0, "start ")], None, [], [None, (None, 1, "x"), (1, None, None)], [(10**6, 5, "end")], [(-3, 10**6, None)]]
    rows = [(r[0], r[1], edits[i % len(edits)], 1, "x") for i, r in enumerate(odd_rows)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, edits array<struct<at:int,cut:int,put:string>>, n_tokens int, place string")
    found = token_counts.edited_counts(docs, FILE, PATTERN).collect()
    wanted = []
    for doc_id, text, some, _, _ in rows:
        new = apply(text or "", [(e[0], e[1] or 0, e[2] or "") for e in some or [] if e is not None and e[0] is not None])
        wanted.append((doc_id, len(encoding.encode_ordinary(text or "")), len(encoding.encode_ordinary(new)), len(new)))
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r.n_tokens, r.edited_tokens, r.edited_chars)) for r in found)
    assert token_counts.edited_counts(docs.where("false"), FILE, PATTERN).collect() == []


def test_query_edits(encoding, documents):
    from outlast.llm.queries import edits_of

    edited = edits_of(documents)
    texts = {r.doc_id: (r.text or "", apply(r.text or "", [(e["at"], e["cut"], e["put"]) for e in r.edits])) for r in edited.collect()}
    for r in token_counts.edited_counts(edited, FILE, PATTERN).collect():
        old, new = texts[r.doc_id]
        assert (r.n_tokens, r.edited_tokens) == (len(encoding.encode_ordinary(old)), len(encoding.encode_ordinary(new)))
