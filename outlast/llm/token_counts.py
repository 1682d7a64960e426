"""Edit-aware token counts: a segment tree over the pre-tokens of a document.

Leaves hold a few dozen pre-tokens with their token counts, inner nodes the sums of characters and tokens
below them. An edit scans again from the pre-token a few characters before it until a pre-token boundary
of the old text comes back, encodes only what it scanned, and updates the sums on the leaves' paths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlast.llm.words import column, text_slices

LEAF = 32
LOOK = 3  # a match of the pattern depends on at most two characters after its end
CACHED = 200_000


class TokenCounter:
    """Pre-tokens of texts by a pattern and the number of tokens of each, by a rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        for part in parts:
            if part not in known:
                known[part] = len(self.encode(part))
        return [known[part] for part in parts]


@lru_cache(maxsize=2)
def token_counter(path: str, pattern: str) -> TokenCounter:
    """One per file and worker process."""
    return TokenCounter(path, pattern)


class PreTokenTree:
    def __init__(self, counter: TokenCounter, text: str):
        self.counter, self.encoded = counter, 0
        self._build(counter.pattern.findall(text))

    def _build(self, parts: list[str], counts: list[int] | None = None) -> None:
        counts = self.counter.counts(parts) if counts is None else counts
        self.leaves = [(parts[i:i + LEAF], counts[i:i + LEAF]) for i in range(0, len(parts), LEAF)] or [([], [])]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(len(self.leaves)):
            self._measure(i)
        for node in range(self.size - 1, 0, -1):
            self._add_up(node)

    def _measure(self, leaf: int) -> None:
        parts, counts = self.leaves[leaf]
        self.chars[self.size + leaf], self.tokens[self.size + leaf] = sum(map(len, parts)), sum(counts)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _update(self, leaf: int) -> None:
        self._measure(leaf)
        node = (self.size + leaf) // 2
        while node:
            self._add_up(node)
            node //= 2

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join("".join(parts) for parts, _ in self.leaves)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and first character of the pre-token that holds character ``at`` < n_chars."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        leaf = node - self.size
        for place, part in enumerate(self.leaves[leaf][0]):
            if at < before + len(part):
                return leaf, place, before
            before += len(part)
        raise IndexError(at)

    def _from(self, leaf: int, place: int) -> Iterator[tuple[int, int, str]]:
        while leaf < len(self.leaves):
            parts = self.leaves[leaf][0]
            while place < len(parts):
                yield leaf, place, parts[place]
                place += 1
            leaf, place = leaf + 1, 0

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replace ``cut`` characters from ``at`` on by ``put``; both are held within the text."""
        at = min(max(0, at), self.n_chars)
        cut = min(max(0, cut), self.n_chars - at)
        if not cut and not put:
            return
        if not self.n_chars:
            self._build(self.counter.pattern.findall(put))
            self.encoded += sum(len(parts) for parts, _ in self.leaves)
            return
        leaf, place, start = self._find(min(max(0, at - LOOK), self.n_chars - 1))
        old = self._from(leaf, place)
        taken, bounds, read = [], {}, start  # bounds: old boundary -> the pre-token that starts there
        want = at + cut + 64
        while True:
            for l, p, part in old:
                bounds[read] = (l, p)
                taken.append(part)
                read += len(part)
                if read >= want:
                    break
            whole = read >= self.n_chars
            if whole:
                bounds[read] = (len(self.leaves), 0)
            joined = "".join(taken)
            fresh = joined[:at - start] + put + joined[at - start + cut:]
            shift, done = len(put) - cut, at - start + len(put)
            parts, end = [], None
            for match in self.counter.pattern.finditer(fresh):
                if match.start() >= done and match.start() + start - shift in bounds:
                    end = bounds[match.start() + start - shift]
                    break
                if not whole and match.end() + LOOK > len(fresh):
                    break
                parts.append(match.group())
            else:
                end = bounds[read] if whole else None
            if end is not None:
                break
            want = read + 2 * (read - start)
        self._replace((leaf, place), end, parts)

    def _replace(self, low: tuple[int, int], high: tuple[int, int], parts: list[str]) -> None:
        counts = self.counter.counts(parts)
        self.encoded += len(parts)
        (first, i), (last, j) = low, high
        after = self.leaves[last] if last < len(self.leaves) else ([], [])
        before = self.leaves[first]
        if first == last:
            self.leaves[first] = before[0][:i] + parts + before[0][j:], before[1][:i] + counts + before[1][j:]
        else:
            self.leaves[first] = before[0][:i] + parts, before[1][:i] + counts
            for middle in range(first + 1, min(last, len(self.leaves))):
                self.leaves[middle] = [], []
                self._update(middle)
            if last < len(self.leaves):
                self.leaves[last] = after[0][j:], after[1][j:]
                self._update(last)
        if len(self.leaves[first][0]) > 4 * LEAF:
            self._build([p for ps, _ in self.leaves for p in ps], [c for _, cs in self.leaves for c in cs])
        else:
            self._update(first)


def edited_counts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Token counts of every text of ``docs`` (doc_id, text, edits) before and after its edits.

    edits: array of (at, cut, put), applied in order, each to the text as it then stands; places are code
    points and are held within the text. Columns: doc_id, n_tokens, n_pretokens, edited_tokens,
    edited_chars, encoded_again (pre-tokens that the edits had to encode).

    Null texts are empty; null edits, and edits with a null place, change nothing; a null put inserts
    nothing. Null and repeated doc_ids are answered row by row; other columns are not read. Texts of
    any length are read whole. An empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(ranks, pattern)
        for batch in text_slices(batches):
            rows = []
            for text, edits in zip(column(batch, "text").to_pylist(), column(batch, "edits").to_pylist()):
                tree = PreTokenTree(counter, text or "")
                before = tree.n_tokens, sum(len(parts) for parts, _ in tree.leaves)
                for edit in edits or []:
                    if edit is not None and edit["at"] is not None:
                        tree.edit(edit["at"], edit["cut"] or 0, edit["put"] or "")
                rows.append((*before, tree.n_tokens, tree.n_chars, tree.encoded))
            numbers = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *numbers], names)

    names = ["doc_id", "n_tokens", "n_pretokens", "edited_tokens", "edited_chars", "encoded_again"]
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.col("edits").cast("array<struct<at:int,cut:int,put:string>>").alias("edits"))
    return source.mapInArrow(count, ", ".join(f"{n} bigint" for n in names))
