import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from outlast.llm import lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


def learns(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def is_held(doc_id):
    return learns(doc_id) and zlib.crc32(str(doc_id).encode()) // 7 % 8 == 0


def counted(rows):
    words, pairs = Counter(), Counter()
    for t in rows:
        words.update(t)
        pairs.update(zip(["<s>"] + t[:-1], t))
    starts = len(rows)
    return words, pairs, starts


def brute(rows):
    """Scores by dictionaries: expectation-maximisation over single tokens, then the mixture."""
    texts = [(i, tokens(t)) for i, t in rows]
    w, p, s = counted([t for i, t in texts if learns(i) and not is_held(i)])
    total, distinct = sum(w.values()), len(w)
    bucket = lambda c: c.bit_length()
    held = []
    for _, t in (x for x in texts if is_held(x[0])):
        for before, word in zip(["<s>"] + t[:-1], t):
            c = s if before == "<s>" else w[before]
            held.append((bucket(c), p[before, word] / c if c else 0.0, w[word] / max(1, total), 1 / (distinct + 1)))
    weights = {}
    for _ in range(lm.STEPS):
        sums = {}
        for b, *probs in held:
            now = weights.get(b, (1 / 3,) * 3)
            parts = [x * y for x, y in zip(now, probs)]
            old = sums.setdefault(b, [0.0] * 4)
            for i in range(3):
                old[i] += parts[i] / sum(parts)
            old[3] += 1
        new = {b: tuple(x / v[3] for x in v[:3]) for b, v in sums.items()}
        moved = max((abs(x - y) for b, v in new.items() for x, y in zip(v, weights.get(b, (1, 1, 1)))), default=0)
        weights = new
        if moved < lm.ENOUGH:
            break
    table = lm.weight_table(weights)
    w, p, s = counted([t for i, t in texts if learns(i)])
    total, distinct = sum(w.values()), len(w)
    out = []
    for i, t in texts:
        base = sum(math.log10((w[x] + 1) / (total + distinct + 1)) for x in t)
        score = 0.0
        for before, word in zip(["<s>"] + t[:-1], t):
            c = s if before == "<s>" else w[before]
            a, b, u = table[bucket(c)]
            score += math.log10(a * (p[before, word] / c if c else 0) + b * w[word] / total + u / (distinct + 1)) if total else 0
        out.append((i, len(t), sum(w[x] > 0 for x in t), total, base, score))
    return out


def compare(found, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=key)
    for one, two in zip(found, sorted(brute(rows), key=key), strict=True):
        assert one[:4] == two[:4]
        assert one[4:] == pytest.approx(two[4:], rel=1e-6, abs=1e-9)


def test_documents(documents):
    found = lm.score_documents(documents, range_bytes=10_000).collect()
    compare(found, [(r.doc_id, r.text) for r in documents.collect()])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd_documents, odd_rows, no_documents, llm):
    compare(lm.score_documents(odd_documents).collect(), [r[:2] for r in odd_rows])
    assert lm.score_documents(no_documents).collect() == []
    unlearned = next(i for i in range(1000) if not learns(i))
    row = lm.score_documents(llm.createDataFrame([(unlearned, "a b")], "doc_id bigint, text string")).first()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)


def test_packed_numbers():
    draw = np.random.default_rng(0)
    for hashes in ([], [5], [0, 2**64 - 1], draw.integers(0, 1 << 64, 1000, dtype=np.uint64)):
        hashes = np.unique(np.array(hashes, np.uint64))
        assert (lm.unpack_hashes(lm.pack_hashes(hashes)) == hashes).all()
    one, two = draw.integers(0, 1 << 40, 50), draw.integers(0, 3, 50)
    assert (lm.unpack_counts(lm.pack_counts(one, two), 2) == np.stack((one, two))).all()
    sorted_hashes = np.sort(draw.integers(0, 1 << 64, 500, dtype=np.uint64))
    cuts = lm._ranges_of(sorted_hashes, 7)
    assert cuts[0] == 0 and cuts[-1] == 500 and (np.diff(cuts) >= 0).all()
