"""Caption metrics as aggregations over n-grams. Words are lower-cased and divided at white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "").alias("_w")


def _grams(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, n, gram, c): how often each gram of 1 to most words stands in a row's words _w."""
    sized = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))).where(F.size("_w") >= F.col("n"))
    each = F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("n") + 1), lambda i: F.array_join(F.slice("_w", i, F.col("n")), " "))
    return sized.select(*keys, "n", F.explode(each).alias("gram")).groupBy(*keys, "n", "gram").agg(F.count(F.lit(1)).alias("c"))


def bleu(candidates: DataFrame, references: DataFrame, key: str = "id", ref: str = "ref", text: str = "text", most: int = 4) -> DataFrame:
    """(n, bleu) of a whole corpus: clipped precisions of 1 to n words, and the penalty by each candidate's nearest reference length (of two
    the shorter). Candidates (key, text) have one row for each key, references (key, ref, text) several; candidates without one do not count.
    A precision of 0 makes 0."""
    c = candidates.join(references.select(key).distinct(), key, "left_semi").select(key, _words(text))
    r = references.select(key, ref, _words(text))
    best = _grams(r, [key, ref], most).groupBy(key, "n", "gram").agg(F.max("c").alias("m"))
    zero = F.lit(0).cast("long")
    hits = _grams(c, [key], most).join(best, [key, "n", "gram"], "left")
    hits = hits.select("n", F.least("c", F.coalesce("m", zero)).alias("hit"), F.col("c").alias("total"), zero.alias("own"), zero.alias("wanted"))
    both = c.select(key, F.size("_w").alias("own")).join(r.select(key, F.size("_w").alias("wanted")), key)
    near = both.groupBy(key, "own").agg(F.min(F.struct(F.abs(F.col("wanted") - F.col("own")), F.col("wanted").alias("wanted"))).alias("b"))
    sizes = near.select(F.lit(0).alias("n"), zero.alias("hit"), zero.alias("total"), F.col("own").cast("long").alias("own"), F.col("b.wanted").cast("long").alias("wanted"))
    share = lambda k: F.sum(F.when(F.col("n") == k, F.col("hit"))) / F.nullif(F.sum(F.when(F.col("n") == k, F.col("total"))), zero)
    penalty = F.least(F.lit(1.0), F.exp(1 - F.sum("wanted") / F.nullif(F.sum("own"), zero))).alias("bp")
    row = hits.unionByName(sizes).agg(penalty, *[F.coalesce(share(k), F.lit(0.0)).alias(f"p{k}") for k in range(1, most + 1)])

    def upto(n: int) -> Column:
        ps = [F.col(f"p{k}") for k in range(1, n + 1)]
        mean = F.exp(sum((F.ln(p) for p in ps), F.lit(0.0)) / n)
        return F.when(F.least(F.lit(1.0), *ps) > 0, F.col("bp") * mean).otherwise(0.0)

    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), upto(n).alias("bleu")) for n in range(1, most + 1)])).alias("_x")).select("_x.*")
