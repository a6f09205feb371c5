"""Quality rules: a ledger of bitmasks. Every rule is evaluated once; the ledger keeps its failure bit and the
measurement behind it. Policies are versions of a mask over the bits, so another policy or an ablation reads the
ledger and never the texts. DataFrame functions only.

Defined results: a null or empty text has no words, so it fails `too_few_words`; nothing is dropped here; extra
columns are ignored; repeated rows are judged alike; an empty table gives an empty ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, written

SYMBOLS = "#*$%&|<>"
_WORD_GAP = "[\\x20\\x09-\\x0D]"


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first included.

    Windows are hashed; only a text with two equal hashes is sorted. Neighbours in the order (window, place) that are
    equal flag both places, and the flagged places' stretches of three words are united."""
    span = F.size(words) - 2

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            pairs = F.zip_with(
                F.slice(s, 1, F.size(s) - 1),
                F.slice(s, 2, F.size(s) - 1),
                lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
            )
            return F.sort_array(F.array_distinct(F.flatten(pairs)))

        def united(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(ordered, lambda s: let(places(s), united))

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) < 4, F.array().cast("array<bigint>")
        ).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def gated(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))

    return F.when(span < 2, F.lit(0).cast("long")).otherwise(let(windows(words), gated))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the id and the measurements that the rules read."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    words = F.array_remove(F.split(F.translate("t", SPACES, " " * len(SPACES)), " ", -1), "")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # A filter on size() >= 0 keeps the array in a column of its own instead of copying its expression to every use.
    return base.select(
        "doc_id",
        F.length("t").cast("long").alias("n_chars"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", "0123456789", ""))).cast("long").alias("n_digits"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"),
                F.size(F.array_distinct(w)).cast("long").alias("distinct"),
                _repeat_words(w).alias("repeat"),
            ),
        ).alias("w"),
    ).select(
        "doc_id", "n_chars", "word_chars", "n_symbols", "n_upper", "n_digits",
        F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"),
        F.col("w.n").alias("n_words"), F.col("w.distinct").alias("n_distinct_words"), F.col("w.repeat").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` holds; its bit in the ledger is its place in RULES."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    """In the order of their bits; new rules go to the end, so that stored ledgers stay readable."""
    n = F.col("n_words")
    return [
        Rule("too_few_words", n < 50),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 50 * n),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("short_words", F.col("word_chars") < 2 * n),
        Rule("long_words", F.col("word_chars") > 15 * n),
        Rule("shouting", 2 * F.col("n_upper") > F.col("word_chars")),
        Rule("digits", 10 * F.col("n_digits") > 3 * F.col("word_chars")),
        Rule("few_distinct_words", (n >= 50) & (F.col("n_distinct_words") * F.col("n_distinct_words") < 2 * n)),
    ]


#: Versions of the policy: the names of the rules that count. Stored versions are never changed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "shouting", "digits", "few_distinct_words"),
}
PRODUCTION = "v1"


def mask(policy: str) -> int:
    names = [r.name for r in rules()]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and `fail_bits`: bit k is set if rule k fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, doc_id, text).withColumn("fail_bits", bits)


def verdict(policy: str = PRODUCTION, bits: str = "fail_bits") -> Column:
    """True where no rule of the policy fails."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that only it rejects (they come back without it), rows kept.

    The ledger is first counted by its bits, 2^rules rows at most, so the rules' expansion is over those counts."""
    m = mask(policy)
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [(k, r.name) for k, r in enumerate(rules()) if m >> k & 1]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in chosen]))
    return (
        counts.select("b", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(F.col("b") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger, written to the shared folder: the texts are read once, and policies and ablations read what is stored."""
    return written(ledger(docs, doc_id, text))


def stored_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger with each row of docs beside its entry, as a struct `row`, written. Nothing has to be joined back, so repeated or null ids do not matter."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    book = ledger(whole.select(F.struct("row", "doc_id").alias("id"), "text"), "id", "text")
    return written(book.select(F.col("doc_id.row").alias("row"), F.col("doc_id.doc_id").alias("doc_id"), *[c for c in book.columns if c != "doc_id"]))


def reject(docs: DataFrame, policy: str = PRODUCTION, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps by the stored ledger, with the columns of docs."""
    return stored_rows(docs, doc_id, text).where(verdict(policy)).select("row.*")
