"""Operators that look at one text at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from edge_texts import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import bpe, decontam, extract, licenses, quality
from waymark.llm.queries import vocabulary_path


def measured(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_quality_against_brute_force(docs):
    texts = [*EDGES, (20, "a b c a b c d"), (21, "a b a b a b"), (22, "x x x x"), (23, "l 1\nl 1\n\nl 1\n#*$%&|<>"), (24, " ".join(f"w{i % 11}" for i in range(300)))]
    rows = quality.ledger(docs(texts)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((i is None, i or 0, *measured(t)) for i, t in texts)


def test_quality_policies(docs):
    clean = " ".join("word" + chr(97 + i // 9) + chr(97 + i % 9) for i in range(90))
    d = docs([(1, clean), (2, "too short"), (3, clean + " ### $$$ %%% &&& *** ### $$$"), (4, clean.upper()), (5, None)])
    book = quality.ledger(d)
    assert {r.doc_id for r in book.where(quality.verdict()).collect()} == {1}
    assert {r.doc_id for r in book.where(quality.verdict("base")).collect()} == {1, 3, 4}
    kept = quality.reject(d)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [1]
    ab = {r.rule: r for r in quality.ablations(book).collect()}
    assert ab["symbols"].n_only_this == 1 and ab["shouting"].n_only_this == 1 and ab["too_few_words"].n_failed == 2 and ab["symbols"].n_kept == 1
    assert quality.reject(docs([])).count() == 0


def test_few_distinct_words_at_every_length(docs):
    """A text of ten words over and over is rejected however long it is, and prose of a growing vocabulary is not."""
    rng = np.random.default_rng(4)
    junk = [(n, " ".join(f"word{i}" for i in rng.integers(0, 10, n))) for n in (60, 1999, 2500, 40000)]
    prose = [(n + 1, " ".join(f"word{i}" for i in rng.integers(0, 10 * int(n**0.7), n))) for n in (60, 1999, 2500, 40000)]
    bits = {r.doc_id: r.fail_bits >> 8 & 1 for r in quality.ledger(docs(junk + prose)).collect()}
    assert bits == {n + k: 1 - k for n in (60, 1999, 2500, 40000) for k in (0, 1)}


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("MIT", ({"mit"}, True)),
        ("MIT OR Apache-2.0", ({"mit", "apache-2.0"}, True)),
        ("GPL-2.0-only AND MIT", ({"gpl-2.0-only", "mit"}, False)),
        ("GPL-2.0-only OR MIT AND BSD-3-Clause", ({"gpl-2.0-only", "mit", "bsd-3-clause"}, True)),
        ("(GPL-2.0-only OR MIT) AND GPL-3.0-only", ({"gpl-2.0-only", "mit", "gpl-3.0-only"}, False)),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", ({"gpl-2.0-or-later"}, False)),
        ("(MIT", None),
        ("MIT AND", None),
        ("AND", None),
        ("MIT MIT", None),
        ("MIT)", None),
    ],
)
def test_license_expressions(expression, value):
    assert licenses.evaluate(expression) == value


def test_license_scan(docs):
    texts = [*EDGES, (20, "x MIT License, the mit\nlicense; Apache (License) GENERAL public license"), (21, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) and so on"), (22, "submit license permit licensed"), (23, "mit license mit license")]
    rows = {r.doc_id: r for r in licenses.scan(docs(texts)).collect()}
    a = rows[20]
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels) == (11, 4, 1, 8, "apache,gpl,mit")
    assert rows[21].labels == "gpl-2.0-only,mit,permissive" and rows[21].n_base == 0 and rows[21].score == 1.0 and rows[21].first_word is None
    assert rows[21].expressions == ["( MIT OR GPL-2.0-only )"]
    assert rows[22].labels == "" and rows[22].score == 0
    assert (rows[23].n_base, rows[23].first_word, rows[23].last_word) == (2, 0, 2)
    assert rows[1].n_words == 0 and rows[1].base_labels == "" and rows[7].n_words == 30000
    assert licenses.scan(docs([])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy &amp; buy now, it is a very good thing</div><article><h1>The  Title</h1><p><b>First &amp; bold paragraph<br>goes on.<p>By.</p>
<ul><li>One</li><li>Two</li></ul><div class="share">Share this</div><section id="comments"><p>I am a reader and I comment at length here</p></section></article><aside>Side</aside><form>Sign up <input></form><footer>&copy; us</footer>"""


def test_extraction():
    assert extract.content(PAGE) == ["The Title", "First & bold paragraph goes on.", "By.", "One", "Two"]
    plain = "<html><body><ul><li><a href=x>Home</a></li><li><a href=y>More</a></li></ul><h1>Head</h1><p>" + "long text here " * 20 + "</p><p>short</p><p>" + "other text " * 20 + "</p><footer>f</footer></body></html>"
    blocks = extract.content(plain)
    assert blocks[0] == "Head" and "short" in blocks and "Home" not in blocks and "f" not in blocks
    assert extract.content("<html><head><title>T</title><body><article><p>kept text</p><button>b<p>too</p></article>") == ["kept text", "too"]
    for broken in (None, "", "<", "<p", "<<<>>>", "</p></div>", "<p>&#xZZ;&#99999999;</p>", "<script>x", "<!-- x"):
        extract.content(broken)


_WORDS = "words that make a paragraph of some length, so that it is read and not skipped "
ARTICLE = f"<h1>Title of it</h1><p>{_WORDS * 4}</p><p>By.</p><ul><li>One</li></ul><p>{_WORDS * 3}</p>"
WANTED = ["Title of it", (_WORDS * 4).strip(), "By.", "One", (_WORDS * 3).strip()]
MENU = "<nav><ul><li><a href=/>Home</a></li></ul></nav><ul><li><a href=/a>Unmarked menu</a></li></ul>"


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar content", "with-related", "share-enabled", "page-header-fixed", "ad-free", "social-history", "post-content", "container"])
@pytest.mark.parametrize("inner", ["article", "main", "section", "div"])
def test_extraction_below_wrappers(name, inner):
    assert extract.content(f'<body>{MENU}<div class="{name}"><{inner}>{ARTICLE}</{inner}></div><footer>f</footer></body>') == WANTED


@pytest.mark.parametrize("name", ["ad", "ad-slot", "cookie-notice", "main-menu", "related-posts", "sidebar_left", "comments", "social-links", "newsletter-signup-form box sidebar", "ad2"])
def test_extraction_without_named_parts(name):
    part = f'<div class="{name}"><p>{_WORDS * 2}</p></div>'
    assert extract.content(f"<body>{MENU}{part}<article>{ARTICLE}{part}</article>{part}</body>") == WANTED
    assert extract.content(f"<body>{MENU}{part}{ARTICLE}{part}</body>") == WANTED


@pytest.mark.parametrize("tag", ["iframe", "svg", "noscript", "video", "audio", "canvas", "object", "template", "button", "select"])
def test_extraction_after_unclosed_elements(tag):
    assert extract.content(f"<body>{MENU}<{tag}><article>{ARTICLE}</article></body>") == WANTED
    assert extract.content(f"<body>{MENU}<{tag}>hidden</{tag}><article>{ARTICLE}</article></body>") == WANTED


def test_extraction_of_loose_text_and_forms():
    assert extract.content(f"<body><form id=all>{MENU}<main>{ARTICLE}<div>Buy now</div></main></form></body>") == WANTED
    assert extract.content(f"<body>{MENU}<article>{ARTICLE}<div>Buy now</div>{_WORDS * 3}</article>") == [*WANTED, (_WORDS * 3).strip()]
    assert extract.content(f"<body>{MENU}<div><h1>Title of it</h1></div><div><p>{_WORDS * 4}</p></div><div>more</div></body>") == ["Title of it", (_WORDS * 4).strip()]
    assert extract.content(f"<body><div class=menu>{MENU}{ARTICLE}</div></body>") == WANTED
    assert extract.content(f"<body>{MENU}<footer>the end</footer></body>") == extract.content(f"<body>{MENU}</body>") == []
    assert extract.content(f"<body>{MENU}<aside><p>{_WORDS * 4}</p></aside></body>") == [(_WORDS * 4).strip()]
    assert len(extract.content(f"<body><article>{'<p>one line of it</p>' * 20000}</article>")) == 20000


def test_extraction_without_containers_is_the_same():
    """Pages of the test tables without their article elements: the clusters alone find the same text."""
    import os

    import pandas as pd

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    for page in pd.read_parquet(path).html:
        assert extract.content(re.sub(r"</?article[^>]*>", "", page)) == extract.content(page)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(1, 5), st.integers(0, 3), st.booleans(), st.booleans()), min_size=1, max_size=30))
def test_clusters_against_brute_force(rows):
    lines = [extract.Line("x" * n, tags, n // 3, (), section, False, prose or heading, heading) for n, tags, section, prose, heading in rows]
    ratio = [(n - n // 3) / tags for n, tags, *_ in rows]
    smooth = []
    for i in range(len(rows)):
        near = [(2.718281828459045 ** (-0.5 * (i - j) ** 2), ratio[j]) for j in range(len(rows)) if abs(i - j) <= 3]
        smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    threshold = max(1.0, 0.5 * max(mean, (sum((v - mean) ** 2 for v in smooth) / len(smooth)) ** 0.5))
    if min(abs(v - threshold) for v in smooth + ratio) < 1e-6:
        return
    want = [any(min(s, o) >= threshold and r[2] == rows[i][2] for s, o, r in zip(smooth, ratio, rows, strict=True)) and (rows[i][3] or rows[i][4] or ratio[i] >= threshold) for i in range(len(rows))]
    for i in reversed(range(len(rows) - 1)):
        want[i] = want[i] or (rows[i][4] and want[i + 1])
    assert extract.clusters(lines).tolist() == want


def test_extraction_rows(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, ""), (2, None, None, ""), (3, "v", "", "")], "page_id long, url string, html string, text string")
    rows = sorted(((r.page_id, r.text, r.n_chars) for r in extract.extract(d).collect()))
    assert [r[0] for r in rows] == [1, 2, 2, 3] and rows[0][2] == len(rows[0][1]) > 0 and rows[1][1:] == ("", 0)
    assert extract.extract(d.limit(0)).count() == 0


def test_bpe_equals_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    texts = [*EDGES, (20, "It's a <|endoftext|> test<|endoftext|>"), (21, "a\x1c\x85b　 c \r\n\t z"), (22, "the same the same the same"), (23, "aaaa" * 500)]
    want = []
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    rows = bpe.round_trip(docs(texts), vocabulary_path(), words=50).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert bpe.round_trip(docs([]), vocabulary_path()).count() == 0


def test_bpe_encodes_and_decodes(docs, spark):
    d = docs([(1, "some words, some more"), (2, None)])
    name = bpe.publish(spark, vocabulary_path(), ["some", " words", " some"])
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(d, name), name).collect()}
    assert back == {1: "some words, some more", 2: ""}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6), unique=True, max_size=40), st.lists(st.binary(max_size=7), min_size=1, max_size=20))
def test_transducer_is_a_map(words, others):
    ids = {w: [i, i + 1] for i, w in enumerate(words)}
    t = bpe.Transducer.compile(ids)
    asked = [w for w in others if w] + words
    for w, p in zip(asked, t.find(asked).tolist() if asked else [], strict=True):
        assert (t.a["ids"][t.a["offsets"][p] : t.a["offsets"][p + 1]].tolist() if p >= 0 else None) == ids.get(w)


def test_transducer_shares_suffixes(tmp_path):
    t = bpe.Transducer.compile({w: [1] for w in (b"walking", b"talking", b"balking")})
    assert len(t.a["final"]) - 1 == 8
    t.save(str(tmp_path / "x"))
    assert bpe.Transducer.load(str(tmp_path / "x")).find([b"talking", b"talk", b""]).tolist()[1:] == [-1, -1]


def distance(p, t):
    """The smallest edit distance of p to a stretch of t."""
    row, best = list(range(len(p) + 1)), len(p)
    for w in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=70), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=60))
def test_myers(pattern, words):
    assert decontam.Pattern(pattern).best(words)[0] == distance(pattern, words)


def test_decontamination_against_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    pick = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
    items = [(i, " ".join(pick(n))) for i, n in enumerate((30, 12, 45, 8, 3, 1))] + [(6, None), (7, "")]
    texts = list(EDGES)
    for k in range(60):
        item = (items[k % 6][1]).split()
        for _ in range(int(rng.integers(0, len(item) // 4 + 2))):
            at = int(rng.integers(0, len(item)))
            item = item[:at] + [[], ["other"], [item[at], "more"]][int(rng.integers(0, 3))] + item[at + 1 :]
        texts.append((100 + k, " ".join(pick(int(rng.integers(0, 40))) + item + pick(int(rng.integers(0, 40))))))
    texts.append((300, items[4][1].upper() + "!"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(docs(texts), bench).collect()}
    want = {}
    for i, t in texts:
        for j, x in items:
            p, w = decontam.words_of(x), decontam.words_of(t)
            if p and (e := distance(p, w) if len(w) < 5000 else 99) <= len(p) // decontam.WORDS_PER_EDIT:
                want[i, j] = e
    assert got == want and len(want) > 20 and (300, 4) in got
    d = docs(texts)
    left = decontam.clean(d, bench)
    assert left.columns == d.columns
    bad = {i for i, _ in want}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in texts if i not in bad)
    assert decontam.matches(d, bench.limit(0)).count() == 0 and decontam.clean(docs([]), bench).count() == 0


def test_many_license_places():
    """Counting goes on from the last place: 100,000 places take no quadratic time."""
    assert licenses.Scanner().scan("mit license apache license " * 50000)[:4] == (200000, 100000, 0, 199998)


def test_blocks_of_items_do_not_change_matches(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(10))) for i in range(5)], "item_id long, text string")
    d = docs([(i, "x " + " ".join(f"i{i}w{k}" for k in range(10))) for i in range(5)] + [(9, "clean text")])
    monkeypatch.setattr(decontam.blocks_of, "__defaults__", ("item_id", "text", 30))
    assert {(r.doc_id, r.item_id) for r in decontam.matches(d, bench).collect()} == {(i, i) for i in range(5)}
    assert [r.doc_id for r in decontam.clean(d, bench).collect()] == [9]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["mit", "MIT", "license", "License", "apache", "general", "public", "x", "é", "9", "-", " ", "\n", "_", ".", "\x7f"]), max_size=40))
def test_license_places_against_brute_force(pieces):
    text = " ".join(pieces[::2]) + "".join(pieces[1::2])
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    places = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    got = licenses.Scanner().scan(text)
    starts = [i for i, _ in places]
    assert got[:5] == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_extraction_on_whole_pages():
    """The content of every test page is its article's blocks."""
    import html
    import os

    import pandas as pd

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    for page in pd.read_parquet(path).html:
        inner = re.search(r"(?s)<article>(.*?)(</article>|<footer|$)", page)[1]
        parts = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.sub("</?b>", "", re.sub(r"(?s)<!--.*?-->", "", inner)))
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in parts]
        assert extract.content(page) == [x for x in want if x]


def test_lexicon_is_made_of_the_patterns_words(docs):
    special = bpe.Vocabulary(vocabulary_path()).special
    texts = ["It's 42, it's 42!!\n\n  the end", "it's 42, the end\n\n", None, "", "x" * 100 + " " + "y" * 100] * 2
    counts = Counter(w for t in texts for w in bpe._splitter(special)(t or ""))
    want = {w for w, n in counts.items() if n > 1 and len(w) <= bpe.SHORT}
    got = bpe.frequent_words(docs(list(enumerate(texts))), special)
    assert len(got) == len(set(got)) and set(got) == want and {" 42", "'s", ",", "!!"} <= want
    few = bpe.frequent_words(docs(list(enumerate(texts))), special, 5)
    assert len(few) <= 5 and all(counts[w] >= max((counts[x] for x in want - set(few)), default=0) for w in few)
