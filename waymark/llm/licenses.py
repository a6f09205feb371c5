"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases in one pass over each text; a
shunting-yard parser evaluates the expressions after the tags.

Defined results: a null text counts as empty; without evidence the labels are empty strings, the places null and the
score 0; a malformed expression still yields the known identifiers it names; repeated rows get equal results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

#: Phrases of the contract and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases (as the scanner's words) and the label each points to.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "gnu general public license": "gpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Licence identifiers that an expression may name.
IDENTIFIERS = (
    "0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsl-1.0 "
    "cc-by-4.0 cc-by-sa-4.0 cc0-1.0 epl-1.0 epl-2.0 eupl-1.2 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only "
    "gpl-3.0-or-later isc lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.1 mpl-2.0 "
    "ms-pl ncsa ofl-1.1 openssl postgresql python-2.0 unlicense upl-1.0 wtfpl zlib"
).split()
#: Identifiers that allow use without copyleft; an expression that can be met by these alone is permissive.
PERMISSIVE = {x for x in IDENTIFIERS if not re.match("agpl|gpl|lgpl|mpl|epl|eupl|cc-by-sa|ms-pl", x)}
#: The tag after which an expression stands, as the scanner's words.
TAG = "spdx license identifier"

_KEEP = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str] | None:
    """The expression's tokens in postfix order (shunting-yard; with binds before and, and before or); None if malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in map(str.lower, _TOKEN.findall(expression)):
        if token in _PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """The licences that the expression names, and whether permissive ones alone can meet it; None if it is malformed."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append(({token}, token.rstrip("+") in PERMISSIVE))
            continue
        (b, free_b), (a, free_a) = stack.pop(), stack.pop()
        if token == "with":  # the right side is an exception, which names no licence
            stack.append((a, free_a))
        else:
            stack.append((a | b, (free_a or free_b) if token == "or" else (free_a and free_b)))
    return stack[0]


def _identifier(token: str) -> bool:
    """Known, a reference, or built like one: prose after an expression is not."""
    return token.rstrip("+") in IDENTIFIERS or token.startswith(("licenseref-", "documentref-")) or bool(re.search(r"-.*[0-9]|[0-9].*-", token))


def _expression_at(line: str) -> str:
    """The longest start of line that reads as an expression: operands and operators take turns."""
    taken, depth, operand_next, end = [], 0, True, 0
    for m in _TOKEN.finditer(line):
        token = m[0].lower()
        if line[end : m.start()].strip():  # another character stands between
            break
        if token in _PRECEDENCE and not operand_next:
            operand_next = True
        elif token == "(" and operand_next:
            depth += 1
        elif token == ")" and not operand_next and depth:
            depth -= 1
        elif token not in _PRECEDENCE and token not in "()" and operand_next and (_identifier(token) or taken[-1:] and taken[-1].lower() == "with"):
            operand_next = False
        else:
            break
        taken.append(m[0])
        end = m.end()
    while taken and taken[-1].lower() in (*_PRECEDENCE, "("):
        taken.pop()
    return " ".join(taken)


class Scanner:
    """Finds phrases in canonical text: lower-case words, each with one space before and after."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for phrase in {*BASE_PHRASES, *NOTICES, TAG}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions)."""
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").translate(_KEEP).split()
        canonical = b" " + b" ".join(words) + b" "
        canon = canonical.decode("latin-1")
        n_base, first, last, base, labels, tagged = 0, None, None, set(), set(), False
        score = 0.0
        counted, at = -1, 0  # spaces before `at`: hits come in the order of their ends, so each stretch is counted once
        for end, phrase in self.automaton.iter(canon):
            if phrase in BASE_PHRASES:
                begin = end - len(phrase)  # the phrase's first letter; a phrase may begin before the last one did
                if begin >= at:
                    counted += canon.count(" ", at, begin)
                    at, start = begin, counted
                else:
                    start = counted - canon.count(" ", begin, at)
                n_base += 1
                first, last = start if first is None else min(first, start), start if last is None else max(last, start)
                base.add(BASE_PHRASES[phrase])
                score = max(score, 0.6)
            elif phrase == TAG:
                tagged = True
            if phrase in NOTICES:
                labels.add(NOTICES[phrase])
                score = max(score, 0.8)
        expressions = []
        if tagged:
            for m in re.finditer(r"(?i)spdx[\W_]+license[\W_]+identifier[ \t]*[:=]?[ \t]*([^\r\n]*)", text, re.ASCII):
                if not (expression := _expression_at(m[1])):
                    continue
                expressions.append(expression)
                if (value := evaluate(expression)) is not None and (known := {x.rstrip("+") for x in value[0]} & {*IDENTIFIERS}):
                    labels |= known
                    if value[1]:
                        labels.add("permissive")
                    score = 1.0
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score, expressions


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scanner.scan(t) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=names[1:], dtype=object)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            for c in ("doc_id", "n_words", "n_base", "first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out["score"] = out["score"].astype("float64")
            yield out

    from pyspark.sql import functions as F

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)
