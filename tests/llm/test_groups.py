"""Operators that compare texts with each other, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from edge_texts import EDGES

from waymark.llm import common, graph, minhash, pii, repeats, substring, suffix, warc


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def prose(rng, n, size=300):
    return " ".join(f"w{i}" for i in rng.integers(0, size, n))


def shingles(t, width):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(texts, width, percent):
    ids = sorted({i for i, _ in texts if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t, width)) for i, t in texts if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i in ids}


def near_copies(rng, n=12):
    """Texts with copies at similarities about the threshold, a chain, and a group of copies."""
    texts = []
    for k in range(n):
        base = prose(rng, int(rng.integers(20, 200)), 5000).split()
        texts.append((10 * k, " ".join(base)))
        for c in range(1, 5):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, max(1, len(w) // 8)))):
                w[at] = "new"
            texts.append((10 * k + c, " ".join(w).upper() if c == 4 else "  ".join(w)))
    chain = prose(rng, 100, 5000).split()
    for c in range(12):
        chain = chain[6:] + prose(rng, 6, 5000).split()
        texts.append((1000 - c, " ".join(chain)))
    return texts + [(2000 + c, "the very same text as all of these") for c in range(40)]


@pytest.mark.parametrize(("width", "percent"), [(2, 80), (5, 80)])
def test_near_duplicates_against_brute_force(docs, width, percent):
    texts = near_copies(np.random.default_rng(width)) + [(i + 5000 if i is not None else None, t) for i, t in EDGES]
    want = components(texts, width, percent)
    rows = minhash.digest(minhash.near_duplicates(docs(texts), width, percent)).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert len(set(want.values())) < len(want) - 40
    sizes = {i: len(shingles(t, width)) for i, t in texts if i is not None}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    alone = [r for r in rows if r.doc_id is None]
    assert len(alone) == 1 and alone[0].component_id is None and alone[0].kept


def test_buckets_in_blocks_have_the_same_links(docs, monkeypatch):
    texts = near_copies(np.random.default_rng(9), 4)
    monkeypatch.setattr(minhash, "GROUP_ROWS", 3)
    rows = minhash.near_duplicates(docs(texts), 2, 80).collect()
    assert {r.doc_id: r.component for r in rows} == components(texts, 2, 80)


def test_one_of_each(docs):
    d = docs([(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words that stand here alone"), (2, "other words that stand here alone"), (4, None), (5, None)])
    left = minhash.one_of_each(d)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 2, 4, 5]
    assert minhash.near_duplicates(docs([])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[1000:]
    assert (np.maximum(minhash.registers(a), minhash.registers(b)) == minhash.registers(x)).all()
    for share in (0, 500, 1000, 1800):
        b = np.concatenate([a[:share], rng.integers(0, 1 << 63, 2000 - share, dtype=np.uint64)])
        ka, kb = minhash.registers(a), minhash.registers(b)
        j = minhash.likeliest(*(np.array([f.sum()]) for f in (ka == kb, ka > kb, ka < kb)), np.array([2000.0]), np.array([2000.0]))[0]
        assert j == pytest.approx(share / (4000 - share), abs=0.12)
    assert minhash.miss(0.8) < 1e-4 and minhash.miss(0.85) < 1e-8


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 50)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if i in got} and set(got) == {x for a, b in edges for x in (a, b) if a != b}
    more = graph.components(spark.createDataFrame([(400, 500), (900, 901)], "a long, b long"), spark.createDataFrame(list(got.items()), "id long, comp long"))
    late = {r.id: r.comp for r in more.collect()}
    assert late[501] == late[460] == 400 and late[901] == 900


def repeat_texts(rng):
    shared = [prose(rng, int(n), 10**6) for n in (30, 60, 150, 25, 19, 20, 21)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            parts.append(prose(rng, int(rng.integers(0, 60)), 10**6))
            if rng.random() < 0.6:
                s = shared[int(rng.integers(0, len(shared)))].split()
                a, b = sorted(rng.integers(0, len(s) + 1, 2))
                parts.append(" ".join(s[a:b] if rng.random() < 0.4 else s))
        texts.append((i, " \n"[i % 2].join(p for p in parts if p)))
    texts += [(100 + i, texts[i][1]) for i in range(5)]
    return texts + [(200, "a b " * 300), (201, "x " * 200), (202, "z" * 3000), (203, "ab" * 1500), (204, "é" * 900)]


def removed_words(texts, length=20):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        w, gone = words(t), set()
        for p in range(len(w) - length + 1):
            g = tuple(w[p : p + length])
            if g in seen:
                gone |= set(range(p, p + length))
            seen.add(g)
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substring_dedup_against_brute_force(docs):
    texts = repeat_texts(np.random.default_rng(4)) + [(i + 5000 if i is not None else None, t) for i, t in EDGES if i != 3] + [(9000, "v" * 10)]
    d = docs([*texts, (9000, "v" * 10)])
    rows = substring.dedup(d).collect()
    assert len(rows) == len(texts) + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == removed_words(texts)
    assert substring.dedup(docs([])).count() == 0


def removed_bytes(texts, length=400):
    count = Counter()
    data = {i: (t or "").encode() for i, t in texts}
    for b in data.values():
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(docs):
    small = [(i + 5000 if i is not None else None, t) for i, t in EDGES if i not in (3, 7, 8)]
    texts = repeat_texts(np.random.default_rng(5)) + small + [(9000, "q" * 399), (9001, "r" * 400)]
    rows = suffix.dedup(docs([*texts, (9001, "r" * 400)])).collect()
    assert len(rows) == len(texts) + 1
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == removed_bytes(texts)
    assert suffix.dedup(docs([])).count() == 0


def mutated(rng, n, symbols, many):
    """Variants of a few sequences with single changes, so that runs of one anchor differ in many ways."""
    bases = [rng.integers(0, symbols, n) for _ in range(3)]
    out = []
    for _ in range(many):
        x = bases[int(rng.integers(0, 3))].copy()
        for at in rng.integers(0, n, int(rng.integers(0, 6))):
            x[at] = rng.integers(0, symbols)
        a = int(rng.integers(0, n // 2))
        out.append(np.concatenate([rng.integers(0, symbols, int(rng.integers(0, 9))), x[a:]]))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_small_windows_against_brute_force(docs, monkeypatch, seed):
    """Short windows over few symbols: all rounds of the doubling and of the extension have rows."""
    rng = np.random.default_rng(seed)
    bytes_ = [(i, "".join(chr(97 + c) for c in x)) for i, x in enumerate(mutated(rng, 90, 2 + 24 * seed, 150))]
    plan, cuts = repeats.Plan(length=40, grams=32, words=False), (8, 1)
    doubled = suffix.repeating
    monkeypatch.setattr(suffix, "repeating", lambda d, p: doubled(d, p, cuts))
    rows = suffix.dedup(docs(bytes_), plan=plan).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == removed_bytes(bytes_, 40)
    words_ = [(i, " ".join(f"w{c}" for c in x)) for i, x in enumerate(mutated(rng, 60, 2 + 24 * seed, 150))]
    rows = substring.dedup(docs(words_), plan=repeats.Plan(length=18, grams=16, words=True)).collect()
    want = removed_words(words_, 18)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and 0 < sum(x[1] for x in want.values()) < sum(x[0] for x in want.values())


def test_rows_of_one_id(docs):
    """Equal rows are one document; rows of one id with other texts are documents of their own."""
    t = "m" * 50 + prose(np.random.default_rng(1), 200, 10**6)
    rows = suffix.dedup(docs([(1, t), (1, t), (2, "other")])).collect()
    assert [r.n_removed for r in rows if r.doc_id == 1] == [0, 0]
    rows = suffix.dedup(docs([(1, t), (1, t + " more"), (2, "other")])).collect()
    assert sorted(r.n_removed for r in rows if r.doc_id == 1) == [len(t), len(t)]


def test_long_texts_have_repeats(docs):
    rows = {r.doc_id: r for r in substring.dedup(docs([(i, t) for i, t in EDGES if i in (7, 8)])).collect()}
    assert (rows[7].n_words, rows[7].n_removed, rows[8].n_removed) == (30000, 29999, 0)
    rows = {r.doc_id: r for r in suffix.dedup(docs([(i, t) for i, t in EDGES if i in (7, 8)])).collect()}
    assert rows[7].n_removed == 150000 and rows[8].n_removed == 120000


@pytest.mark.parametrize("seed", range(8))
def test_runs_cover_every_window(seed):
    rng = np.random.default_rng(seed)
    plan = repeats.Plan(length=12, grams=8, words=False)
    sizes = rng.integers(0, 60, 6)
    data = rng.integers(97, 97 + 1 + seed % 3, sizes.sum()).astype(np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes)])
    text, place, near, far, _, _ = repeats.runs(data, first, plan)
    got = sorted((int(t), int(p - d)) for t, p, a, b in zip(text, place, near, far, strict=True) for d in range(a, b + 1))
    assert got == [(i, p) for i, n in enumerate(sizes) for p in range(n - 11)]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(x):
    t = 0
    for i, c in enumerate(reversed(x)):
        c = int(c) * (1 + i % 2)
        t += c - 9 if c > 9 else c
    return t % 10 == 0


def personal(t):
    out, n = [], []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        hits = 0
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
                hits += 1
        n.append(hits)
    return tuple(n), ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_personal_data_against_brute_force(docs):
    rng = np.random.default_rng(6)
    pieces = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "a@b.c.d..e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.255.00", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "79927398713", "+1 (377) 555-0271",
              "+1", "+44 20 7946 0958.", "++12345678901", "1 2  3", "é🙂", " ", "\n", "word", "-", "12345678901234567890123", "0000 0000 0000 00"]
    texts = [(i, "".join(pieces[k] + " " * int(rng.integers(0, 2)) for k in rng.integers(0, len(pieces), int(rng.integers(1, 25))))) for i in range(400)]
    texts += [(i + 5000 if i is not None else None, t) for i, t in EDGES] + [(7000, "1" * 30000), (7001, "a." * 20000), (7002, "a@b.c " * 3000)]
    got = sorted((str(r.doc_id), (r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) for r in pii.digest(pii.detect(docs(texts))).collect())
    want = sorted((str(i), personal(t)[0], hashlib.sha256(personal(t)[1].encode()).hexdigest()) for i, t in texts)
    assert got == want
    assert pii.digest(pii.detect(docs([]))).count() == 0


def leaking(rng):
    """A code name that stands by one address in many texts, and common words about many addresses."""
    texts = [(i, f"{prose(rng, 5)} the agent nightowl writes from owl@x.org about number{i} {prose(rng, 5)}") for i in range(8)]
    texts += [(50 + i, f"{prose(rng, 5)} the writer sends from user{i}@mail.com today {prose(rng, 5)}") for i in range(40)]
    texts += [(1000 + i, prose(rng, 12)) for i in range(250)]
    return texts + [(200, "only nightowl is named here, the rest is clean"), (201, "nothing to see for the writer today"), (202, None), (203, ""), (203, "")]


def test_revealing_terms(docs):
    rows = {r.doc_id: r.spans for r in pii.digest(pii.detect(docs(leaking(np.random.default_rng(1))))).collect()}
    assert rows[200] == "term:5:13" and rows[201] == "" and rows[202] == ""
    assert "email:" in rows[0] and "term:" in rows[0] and "term" not in rows[60]


def test_sanitise(docs):
    d = docs([*leaking(np.random.default_rng(1)), (300, "call +1 (377) 555-0271 or 1.2.3.4"), (None, "mail a@b.co")])
    out = pii.sanitise(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes and out.count() == d.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[300].text == "call [PHONE] or [IP]" and rows[300].n_chars == 20 and rows[None].text == "mail [EMAIL]"
    assert rows[200].text == "only [TERM] is named here, the rest is clean" and rows[201].text.startswith("nothing") and rows[202].text is None and rows[203].text == ""
    assert pii.sanitise(docs([])).count() == 0


def test_secrets(docs):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [(1, f"the key {key}, and {key.upper()}"), (2, f"x{key} {key[:31]} {'1' * 40} {'ab' * 20}"), (3, key), (4, "d" * 50000 + " " + "0a" * 20000), (5, None)]
    rows = {r.doc_id: r for r in pii.digest(pii.detect(docs(texts))).collect()}
    assert {i: r.spans for i, r in rows.items()} == {1: "secret:8:48,secret:54:94", 2: "", 3: "secret:0:40", 4: "secret:50001:90001", 5: ""}
    assert rows[1].n_spans == 2 and rows[2].n_spans == 0 and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(texts)).collect()}
    assert clean[1] == "the key [SECRET], and [SECRET]" and clean[2] == texts[1][1] and clean[3] == "[SECRET]"


def test_terms_are_counted_in_texts(docs):
    """A name in a passage that different texts share, and one far from its address, reveal the address; copies of a text do not."""
    rng = np.random.default_rng(2)
    passage = "of all that was said there " * 2 + "moonfish wrote from moon@y.org " + "and nothing more was said then " * 2
    texts = [(i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(9)]
    texts += [(20 + i, f"{prose(rng, 4)} about moonfish number {i} by moon@y.org {prose(rng, 4)}") for i in range(3)]
    texts += [(100 + i, f"sunfish {prose(rng, 40)} sun@y.org {prose(rng, 4)}") for i in range(5)]
    texts += [(150 + i, "starfish wrote from star@y.org once") for i in range(6)]
    texts += [(200 + i, f"user{i}@mail.com {prose(rng, 9)}") for i in range(40)] + [(1000 + i, prose(rng, 12)) for i in range(300)]
    texts += [(900, "moonfish"), (901, "a sunfish"), (902, "starfish"), (903, "moon sun org")]
    rows = {r.doc_id: r.spans for r in pii.digest(pii.detect(docs(texts))).collect()}
    assert (rows[900], rows[901], rows[902], rows[903]) == ("term:0:8", "term:2:9", "", "")


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 60
    rows = [(5, "http://a\r\n/x", big, "t"), (3, "http://b", big, "t"), (9, None, big, "t"), (4, "u", "small", "t"), (6, "u", "small", "t"), (7, "u", None, "t"), (8, "u", "", "t"), (10, "u", "x" * 200000 + "\r\n\r\nWARC/1.1", "t")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    got = {r.page_id: r for r in warc.digests(warc.round_trip(spark, d)).collect()}
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = min(k for k, _, h, _ in rows if (h or "") == (html or ""))
        revisit = len(data) >= 100 and first < i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
    archives = warc.write_archives(d, "file://" + str(tmp_path / "w"))
    whole = warc.assemble(warc.read_records(archives)).collect()
    assert {r.capture_id: r.response.payload.decode() for r in whole if r.response.warc_type == "response"} == {i: h or "" for i, _, h, _ in rows if i not in (5, 9)}
    assert all(r.request.record_id and r.metadata.record_id for r in whole)
    assert warc.digests(warc.round_trip(spark, d.limit(0))).count() == 0
    # Attempts have files of their own: another run over the same folder leaves the archives that an index names as they were.
    folder = "file://" + str(tmp_path / "twice")
    first = warc.write_archives(d, folder).collect()
    second = warc.write_archives(d, folder).collect()
    assert first and not {r.path for r in first} & {r.path for r in second} and all(r.path.startswith(folder + "/") for r in first)
    again = warc.assemble(warc.read_records(spark.createDataFrame(first, "path string, captures long, bytes long")))
    assert again.count() == len(whole) == sum(r.captures for r in first)


def test_repeated_pages(spark):
    d = spark.createDataFrame([(1, "u", "x" * 150), (1, "u", "x" * 150), (2, "u", "x" * 150), (None, "u", "n")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.digests(warc.round_trip(spark, d)).collect())
    assert got == [("1", "response", "None"), ("1", "response", "None"), ("2", "revisit", "1"), ("None", "response", "None")]


def test_word_hashes_are_of_words_alone():
    data = np.frombuffer(b"one two one  two\none", np.uint8)
    s, e, first = common.word_bounds(data, np.array([0, 7, len(data)]))
    h = common.word_hashes(data, s, e)
    assert first.tolist() == [0, 2, 5] and h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]
