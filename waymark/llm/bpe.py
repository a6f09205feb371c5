"""Byte-level BPE over a minimal acyclic transducer lexicon.

Words of all documents, as the pattern splits them, are counted, and the most frequent ones (a parameter bounds how many) are compiled into a minimal
acyclic automaton: equal suffixes share their states, each arc carries a number, and the numbers on a word's path add up to
its place among the words, which gives its ids. The automaton is a file of flat arrays that executors map into memory.
Words outside it are merged exactly, so the lexicon decides the speed and never the ids.

Defined results: a null text counts as empty and has no ids; the strings of special tokens get their ids; equal texts get
equal ids; an empty table gives no rows and an empty lexicon."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import objects, written

#: Fixed value: the pattern that byte-level BPE splits text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in the lexicon at most; the rest is merged.
LEXICON_WORDS = 50_000
#: Distinct words that a worker counts, or keeps ids of, before it starts afresh.
CACHE_WORDS = 200_000
TEXT_BLOCK = 1 << 21
#: Bytes of a word that is merged along with others (characters of one in the lexicon, at most), and the rank of a pair that does not merge.
SHORT, NO_MERGE = 48, np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes are themselves, the others follow from U+0100 on."""
    printable = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What a tokenizer file says: bytes of each id, ranks of merges, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: as_bytes(t) for t, i in ids.items() if t not in self.special}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        self.byte_ids = np.array(self.byte_id, np.int32)
        keys = np.array([a << 32 | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.merged = np.zeros(len(spec["model"]["merges"]), np.int32)
        for rank, new in self.merge.values():
            self.merged[rank] = new

    def encode_words(self, words: list[bytes]) -> list:
        """The ids of each word. Short words are merged all together, one merge of each in a round; long ones one by one."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= SHORT]
        for i, w in enumerate(words):
            if not 0 < len(w) <= SHORT:
                out[i] = self.encode_word(w)
        if not short:
            return out
        size = np.array([len(words[i]) for i in short], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        of = np.repeat(np.arange(len(short)), size)
        rank = np.full(len(sym), NO_MERGE, np.int64)
        rank[:-1] = np.where(of[:-1] == of[1:], self._ranks(sym[:-1], sym[1:]), NO_MERGE)
        done_sym, done_of = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            length = np.diff(np.concatenate([first, [len(of)]]))
            low = np.repeat(np.minimum.reduceat(rank, first), length)
            over = low == NO_MERGE
            if over.any():
                done_sym.append(sym[over])
                done_of.append(of[over])
                sym, of, rank, low = sym[~over], of[~over], rank[~over], low[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            at = at[np.concatenate([[True], of[at[1:]] != of[at[:-1]]])]  # the leftmost of each word
            sym[at] = self.merged[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, of, rank = sym[stay], of[stay], rank[stay]
            at = at - np.arange(len(at))
            for p in (at, at[at > 0] - 1):  # the pairs that the new symbol begins and ends
                q = np.minimum(p + 1, len(sym) - 1)
                rank[p] = np.where((q > p) & (of[p] == of[q]), self._ranks(sym[p], sym[q]), NO_MERGE)
        sym, of = np.concatenate(done_sym), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(short)))
        for i, ids in zip(short, np.split(sym[order], ends[:-1]), strict=True):
            out[i] = ids
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_MERGE)

    def encode_word(self, word: bytes) -> list[int]:
        """The lowest-ranked pair is merged first, the leftmost of equals; n log n in the word's length."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:  # one of the two has been merged meanwhile
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (p := before[i]) >= 0 and (m := self.merge.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return [x for x in ids if x >= 0]


class Transducer:
    """A minimal acyclic automaton in flat arrays. Arc of state s for byte c: the key s * 256 + c in `keys`."""

    NAMES = ("keys", "targets", "numbers", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Transducer:
        """From words and their ids: states are registered by what follows them, as the sorted words are added."""
        register: dict[tuple, int] = {}
        below: list[int] = []  # words accepted from each state
        arcs_of: list[tuple] = []
        finals: list[bool] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if (s := register.get(key)) is None:
                s = register[key] = len(below)
                below.append(node[0] + sum(below[t] for _, t in node[1]))
                arcs_of.append(key[1])
                finals.append(bool(node[0]))
            return s

        path: list[list] = [[0, []]]
        last = b""
        order = sorted(words)
        for word in order:
            shared = len(os.path.commonprefix([last, word]))
            while len(path) - 1 > shared:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(node)))
            path += [[0, []] for _ in range(len(word) - shared)]
            path[-1][0] = 1
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        root = settle(path[0])
        keys, targets, numbers = [], [], []
        for s, arcs in enumerate(arcs_of):
            seen = int(finals[s])
            for c, t in arcs:
                keys.append(s * 256 + c)
                targets.append(t)
                numbers.append(seen)
                seen += below[t]
        ids = [words[w] for w in order]
        arrays = {
            "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "numbers": np.array(numbers, np.int32),
            "final": np.array([*finals, root], np.int32), "offsets": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64) if ids else np.zeros(1, np.int64),
            "ids": np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32),
        }
        return cls(arrays)

    def save(self, path: str) -> None:
        """A line of JSON with the places, then the arrays."""
        head, at = {}, 0
        for n in self.NAMES:
            head[n] = [str(self.a[n].dtype), len(self.a[n]), at]
            at += (self.a[n].nbytes + 63) // 64 * 64
        with open(path, "wb") as f:
            f.write(json.dumps(head).encode().ljust(1024))
            for n in self.NAMES:
                f.write(self.a[n].tobytes().ljust((self.a[n].nbytes + 63) // 64 * 64, b"\0"))

    @classmethod
    def load(cls, path: str) -> Transducer:
        """Maps the file into memory; all workers of a machine share its pages."""
        with open(path, "rb") as f:
            head = json.loads(f.read(1024))
        return cls({n: np.memmap(path, dtype, "r", 1024 + at, (size,)) if size else np.zeros(0, dtype) for n, (dtype, size, at) in head.items()})

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, or -1; all words take their next byte together."""
        keys, targets, numbers = self.a["keys"], self.a["targets"], self.a["numbers"]
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        start = np.cumsum(size) - size
        state = np.full(len(words), self.a["final"][-1], np.int64)
        total = np.zeros(len(words), np.int64)
        alive = np.flatnonzero(size >= 0)
        step = 0
        while len(alive := alive[size[alive] > step]):
            key = state[alive] * 256 + data[start[alive] + step]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1) if len(keys) else np.zeros(len(alive), np.int64)
            hit = keys[at] == key if len(keys) else np.zeros(len(alive), bool)
            state[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            state[alive] = targets[at]
            total[alive] += numbers[at]
            step += 1
        ok = state >= 0
        ok[ok] = self.a["final"][state[ok]] == 1
        return np.where(ok, total, -1)


def _splitter(special: dict[str, int]):
    """text -> its words; a special token's string is a word of its own."""
    find = regex.compile(PATTERN).findall
    cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")").split if special else None

    def words(text: str) -> list[str]:
        if cut is None or not any(x in text for x in special):
            return find(text)
        return [w for piece in cut(text) for w in ([piece] if piece in special else find(piece))]

    return words


def frequent_words(docs: DataFrame, special: dict[str, int], limit: int = LEXICON_WORDS, text: str = "text") -> list[str]:
    """The most frequent words of all documents, as the pattern splits them; at most limit, of SHORT characters or less, come to the driver.

    A worker sums what it reads before rows move. The least count that a frequent word has follows from a histogram of the
    counts, so no task sends more than its share of the result."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = _splitter(special), Counter()

        def out() -> pd.DataFrame:
            some = [w for w in seen if len(w) <= SHORT]
            return pd.DataFrame({"word": objects(some), "n": [seen[w] for w in some]})

        for batch in batches:
            for t in batch["text"]:
                seen.update(words(t or ""))
                if len(seen) > CACHE_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    counts = docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where("n > 1"))
    level = F.floor(F.log2("n") * 8).cast("int")
    least, held = 0, 0
    for row in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():  # a row for each eighth of a power of two
        if held + row.words > limit:
            least = row.level + 1
            break
        held += row.words
    return [r.word for r in counts.where(level >= least).select("word").collect() if r.word not in special]


def publish(spark: SparkSession, vocabulary: str, words: list[str]) -> str:
    """Compiles the lexicon and sends it with the vocabulary to the executors; the name under which they find both."""
    v = Vocabulary(vocabulary)
    name = f"lexicon-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="waymark-")
    keys = [w.encode() for w in words]
    Transducer.compile(dict(zip(keys, v.encode_words(keys), strict=True))).save(f"{folder}/{name}.fsa")
    shutil.copyfile(vocabulary, f"{folder}/{name}.json")
    spark.sparkContext.addFile(f"{folder}/{name}.fsa")
    spark.sparkContext.addFile(f"{folder}/{name}.json")
    return name


class Codec:
    """Encodes and decodes texts; keeps the ids of words it has met, up to CACHE_WORDS."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.v, self.lexicon = vocabulary, lexicon
        self.words = _splitter(vocabulary.special)
        size = max(vocabulary.token) + 1
        self.token_size = np.array([len(vocabulary.token.get(i, b"")) for i in range(size)], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(vocabulary.token.get(i, b"") for i in range(size)), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.pending: list[str] = []
        pending = self.pending

        class Known(dict):
            def __missing__(self, word):
                pending.append(word)
                self[word] = k = len(self)
                return k

        self.known = Known()
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self) -> None:
        new = [w.encode("utf-8", "surrogatepass") for w in self.pending]
        special = self.v.special
        places = self.lexicon.find(new)
        offsets, ids = self.lexicon.a["offsets"], self.lexicon.a["ids"]
        unseen = iter(self.v.encode_words([b for w, b, p in zip(self.pending, new, places.tolist(), strict=True) if p < 0 and w not in special]))
        made = [[special[w]] if w in special else ids[offsets[p] : offsets[p + 1]] if p >= 0 else next(unseen) for w, p in zip(self.pending, places.tolist(), strict=True)]
        size = np.array([len(x) for x in made], np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *[np.asarray(x, np.int32) for x in made]])
        self.pending.clear()

    @staticmethod
    def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = int(size.sum())
        return values[np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        lists = [self.words(t) for t in texts]
        get = self.known.__getitem__
        codes = np.fromiter(map(get, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        if self.pending:
            self._learn()
        size = self.size[codes]
        ids = self._gather(self.ids, self.start[codes], size).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, lists)])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return self._gather(self.token_bytes, self.token_start[ids], self.token_size[ids]).tobytes().decode("utf-8", "replace")


SCHEMA = "doc_id long, ids array<int>"


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about TEXT_BLOCK characters, with the place of the first."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= TEXT_BLOCK or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0


def _codec(name: str) -> Codec:
    return Codec(Vocabulary(SparkFiles.get(f"{name}.json")), Transducer.load(SparkFiles.get(f"{name}.fsa")))


def encode(docs: DataFrame, lexicon: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of docs; lexicon: the name that publish() gave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(lexicon)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for first, some in _chunks(texts):
                ids = [x.view(np.int32) for x in codec.encode(some)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[first : first + len(some)].astype("Int64").array, "ids": objects(ids)})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)


def decode(encoded: DataFrame, lexicon: str) -> DataFrame:
    """(doc_id, text) for each row of (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(lexicon)
        for batch in batches:
            text = [None if x is None else codec.decode(np.asarray(x, np.int64)) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": objects(text)})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, lexicon: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Encodes and decodes each row in one task and returns the digests of both; the ids too, if asked for."""
    with_ids = ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(lexicon)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for first, some in _chunks(texts):
                ids = codec.encode(some)
                more = {"ids": objects(x.view(np.int32) for x in ids)} if with_ids else {}
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[first : first + len(some)].astype("Int64").array,
                        "n_tokens": [len(x) for x in ids],
                        "ids_sha256": objects(hashlib.sha256(x.tobytes()).hexdigest() for x in ids),
                        "decoded_sha256": objects(hashlib.sha256(codec.decode(x.astype(np.int64)).encode()).hexdigest() for x in ids),
                        **more,
                    }
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, DIGEST + (", ids array<int>" if with_ids else ""))


def round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS, ids: bool = False) -> DataFrame:
    """Counts, compiles, encodes and decodes: the digests of every row, and its ids if asked for."""
    special = Vocabulary(vocabulary).special
    return digest(docs, publish(docs.sparkSession, vocabulary, frequent_words(docs, special, words, text)), doc_id, text, ids)
