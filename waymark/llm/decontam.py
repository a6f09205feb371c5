"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers' bit-parallel distance.

An item of m words may differ by k = floor(m / 5) edits of words (similarity 0.8). Cut into k + 1 pieces, a text within k edits
holds at least one piece unchanged. An Aho-Corasick automaton finds the pieces in whole texts, and Myers' algorithm, with a bit
for each word of the item, gives the smallest distance of the item to a stretch of the text about each hit.

The items are the stated query set. They are taken in blocks of bounded size, each of which goes to all texts in turn, so no
join is made and nothing that grows with the documents is sent to the driver.

Defined results: words are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased; null texts have none and
match nothing; items without words match nothing; items of every length are found inside texts by the same rule, so those under 5
words without edits; repeated rows get equal results; an empty benchmark matches nothing."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One edit in so many words is allowed.
WORDS_PER_EDIT = 5
#: Bytes of item text in a block.
BLOCK_BYTES = 4 << 20

_KEEP = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Pattern:
    """Myers' bit-parallel distance of a sequence of words to the stretches of another."""

    def __init__(self, words: list[bytes]):
        self.m = len(words)
        self.at: dict[bytes, int] = {}
        for i, w in enumerate(words):
            self.at[w] = self.at.get(w, 0) | 1 << i
        self.all, self.top = (1 << self.m) - 1, 1 << (self.m - 1)

    def best(self, text: list[bytes]) -> tuple[int, int]:
        """The smallest distance to a stretch of text, and the end of the first such stretch."""
        plus, minus, score, found, end = self.all, 0, self.m, self.m, 0
        at, full, top = self.at, self.all, self.top
        for j, w in enumerate(text):
            eq = at.get(w, 0)
            vertical = eq | minus
            x = ((((eq & plus) + plus) ^ plus) | eq) & full
            h_plus = (minus | ~(x | plus)) & full
            h_minus = plus & x
            if h_plus & top:
                score += 1
            elif h_minus & top:
                score -= 1
            h_plus = h_plus << 1 & full
            h_minus = h_minus << 1 & full
            plus = (h_minus | ~(vertical | h_plus)) & full
            minus = h_plus & vertical
            if score < found:
                found, end = score, j + 1
        return found, end


class Matcher:
    """A block of items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], words_per_edit: int = WORDS_PER_EDIT):
        self.items: list[tuple[int, list[bytes], int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k = len(words) // words_per_edit
            n = len(self.items)
            self.items.append((item_id, words, k))
            for i in range(k + 1):
                a, b = i * len(words) // (k + 1), (i + 1) * len(words) // (k + 1)
                pieces.setdefault((b" " + b" ".join(words[a:b]) + b" ").decode("latin-1"), []).append((n, a))
        self.patterns: dict[tuple[int, bool], Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def _pattern(self, n: int, backwards: bool = False) -> Pattern:
        if (n, backwards) not in self.patterns:
            self.patterns[n, backwards] = Pattern(self.items[n][1][:: -1 if backwards else 1])
        return self.patterns[n, backwards]

    def match(self, text: str | None, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, end word) of each item's best stretch; first: any one match will do."""
        words = words_of(text)
        if not words:
            return []
        out: list[tuple[int, int, int, int]] = []
        if not self.any:
            return out
        canonical = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts: dict[int, list[int]] = {}
        counted, at = 0, 0
        for end, (size, places) in self.automaton.iter(canonical):
            begin = end + 1 - size
            if begin >= at:
                counted += canonical.count(" ", at, begin)
                at, word = begin, counted
            else:
                word = counted - canonical.count(" ", begin, at)
            for n, offset in places:
                starts.setdefault(n, []).append(word - offset)
        for n, places in starts.items():
            item_id, pattern, k = self.items[n]
            m, best = len(pattern), None
            windows: list[list[int]] = []
            for s in sorted(set(places)):
                a, b = max(0, s - k), min(len(words), s + m + k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], b)
                else:
                    windows.append([a, b])
            for a, b in windows:
                distance, end = self._pattern(n).best(words[a:b])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, a + end)
                    if first:
                        break
            if best is not None:
                back, size = self._pattern(n, True).best(words[max(0, best[1] - m - k) : best[1]][::-1])
                out.append((item_id, best[0], best[1] - size if back == best[0] else max(0, best[1] - m), best[1]))
                if first:
                    return out
        return out


def blocks_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about size bytes that come to the driver one at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        block.append((row.i, row.t))
        held += len(row.t)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, distance long, first_word long, end_word long"


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, first_word, end_word) for each text and item within the item's edits."""
    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in blocks_of(benchmark):

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            matcher = Matcher(block)
            for batch in batches:
                rows = [(d, *m) for d, x in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True) for m in matcher.match(x)]
                if rows:
                    frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "first_word", "end_word"])
                    yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = t.mapInPandas(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that match no item, with the columns of docs. Each block filters what the last one left."""
    for block in blocks_of(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([not matcher.match(x, first=True) for x in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
