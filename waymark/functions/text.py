"""Captions, questions and descriptions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the punctuation that captions and questions lose.
PUNCTUATION = '[.!"()*#:;~]'


def _first_words(text: Column, n: int) -> Column:
    return F.concat_ws(" ", F.slice(F.split(text, " ", -1), 1, n))


def caption(text: Column, max_words: int = 50) -> Column:
    """Lower case, punctuation to spaces, runs of white space to one, trimmed, cut to max_words. Null stays null."""
    c = F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, " "), r"\s{2,}", " ")
    c = F.btrim(F.rtrim(c, F.lit("\n")), F.lit(" "))
    return F.when(text.isNotNull(), _first_words(c, max_words))


def question(text: Column, max_words: int = 50) -> Column:
    """Lower case, punctuation dropped, spaces trimmed on the right only, cut to max_words. Null stays null."""
    q = F.rtrim(F.regexp_replace(F.lower(text), PUNCTUATION, ""), F.lit(" "))
    return F.when(text.isNotNull(), _first_words(q, max_words))


def with_prompt(text: Column, prompt: str) -> Column:
    return F.concat(F.lit(prompt), text)


def without_prompt(text: Column, prompt: str) -> Column:
    """What follows as many characters as the prompt has."""
    return F.substring(text, len(prompt) + 1, 1 << 30)


def too_long(text: Column, limit: int) -> Column:
    """More characters than limit; null is not too long."""
    return F.coalesce(F.char_length(text) > limit, F.lit(False))


def cut_at_word(text: Column, limit: int) -> Column:
    """The first limit characters without their last part of a word; all of them if they hold no space. A text within the limit stays."""
    head = F.left(text, F.lit(limit))
    return F.when(F.char_length(text) > limit, F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)).otherwise(text)


def sides_swapped(sentence: Column) -> Column:
    """left for right and right for left, word by word."""
    swap = lambda w: F.when(w == "left", F.lit("right")).when(w == "right", F.lit("left")).otherwise(w)
    return F.array_join(F.transform(F.split(sentence, " ", -1), swap), " ")


def comma_fields(line: Column) -> Column:
    """The trimmed fields between commas, empty ones too."""
    return F.transform(F.split(line, ",", -1), lambda x: F.trim(x))


def unquoted(value: Column) -> Column:
    """Without quotes of either kind on either side."""
    return F.btrim(value, F.lit("\"'"))


def wrapped(text: Column, width: int = 50) -> Column:
    """Lines of at most width, broken at white space; a longer word is cut. Folds over the words."""
    words = F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.regexp_extract_all(w, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        grown = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        fits = F.length(grown) <= width
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), F.when(fits, grown).otherwise(w).alias("line"))

    folded = F.aggregate(words, start, step, lambda acc: F.array_join(F.concat(acc["done"], F.array(acc["line"])), "\n"))
    return F.when(F.length(text) <= width, text).otherwise(folded)


def sentences(text: Column) -> Column:
    """The sentences, trimmed: a full stop, question or exclamation mark, quotes or brackets that close, white space, and then no lower-case letter.

    A rule without a list of abbreviations, so one before a capital ends a sentence."""
    ends = r"(?<=[.!?][\"')\]]{0,2})\s+(?![a-z\s])"
    return F.filter(F.transform(F.split(text, ends, -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def recall_line(values: dict[int, Column]) -> Column:
    """'R@1: x.x, R@5: ...'."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"R@{k}: "), F.format_string("%.1f", v)) for k, v in values.items()])
