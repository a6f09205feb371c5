"""Personal data: patterns find the protected entities, and an information-theoretic pass over the whole corpus finds
terms that give them away. DataFrame functions only.

Entities are the spans of the patterns. A token whose own information is that of a key (`secret`) needs no corpus to be protected. The corpus counts in how many different texts a term and an entity stand together,
wherever in the text, and in how many texts each stands at all; a term whose pointwise mutual information with an entity,
and whose share of texts with that entity, exceed the disclosure thresholds reveals it, and its places are spans of the kind
`term`. All counts are of distinct texts. In a sanitised text, entities are generalised to their kind and revealing terms to
a mark.

Defined results: a null text counts as empty; offsets are code points, the end exclusive; equal texts count
once, so copies alone make no term revealing; words that only addresses hold are no terms of their text; repeated rows get equal results; rows with a null id are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_key, written

#: Kinds in the order of the contract; the method's own kind follows.
KINDS = ("email", "ip", "card", "phone")
TERM, SECRET = "term", "secret"
#: A token that gives itself away: hexadecimal digits of 128 bits or more, four bits each, letters and figures mixed.
_SECRET = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
#: The contract's patterns for Java, linear in the text: a match can start only where a run starts or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur in it at all.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Disclosure thresholds: different texts that a term shares with an entity, bits of pointwise mutual information, and the
#: share of the term's texts that hold the entity.
MIN_CONTEXTS, MIN_BITS, MIN_SHARE = 3, 4.0, 0.5
#: One in so many texts is searched first, for terms that are too common to reveal anything.
FIRST_LOOK = 16
#: The term's words: letters of any script, three at least.
_WORD = r"\p{L}{3,}+"
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)


def _starts(sizes: Column, chunk: int = 64) -> Column:
    """Sum of the elements before each, in two levels: a chunk's base, and the sum within the chunk."""

    def of_chunk(k: Column) -> Column:
        def within(base_part: Column) -> Column:
            part = base_part["part"]
            return F.transform(part, lambda _, j: base_part["base"] + _sum(F.slice(part, F.lit(1), j)))

        return let(F.struct(_sum(F.slice(sizes, F.lit(1), k * chunk)).alias("base"), F.slice(sizes, k * chunk + 1, F.lit(chunk)).alias("part")), within)

    many = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / chunk).cast("int")), of_chunk))
    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(many)


def find_all(text: Column, pattern: str, kind: str) -> Column:
    """The matches of a pattern, leftmost and without overlap: array of (kind, start, end, value)."""
    pieces = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def build(x: Column) -> Column:
        steps = F.zip_with(F.transform(x["p"], lambda p: F.length(p)), F.transform(x["v"], lambda v: F.length(v)), lambda a, b: a + F.coalesce(b, F.lit(0)))
        return let(
            F.struct(let(steps, lambda s: _starts(s)).alias("at"), x["v"].alias("v")),
            lambda y: F.transform(
                y["v"], lambda v, i: F.struct(F.lit(kind).alias("kind"), (F.get(y["at"], i + 1) - F.length(v)).alias("start"), F.get(y["at"], i + 1).alias("end"), v.alias("value"))
            ),
        )

    empty = F.array().cast(_SPANS)
    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.struct(pieces.alias("p"), values.alias("v")), build)).otherwise(empty)


#: A number of at most 255.
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - 1 - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return _sum(F.transform(F.sequence(F.lit(0), n - 1), digit)) % 10 == 0


def _valid(kind: str):
    def card(x: Column) -> Column:
        return let(_digits(x["value"]), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))

    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": card,
        "phone": lambda x: F.length(_digits(x["value"])).between(10, 15),
    }[kind]


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, the spans that its checks let pass."""
    out = {}
    empty = F.array().cast(_SPANS)
    for kind in KINDS:
        # A card's digits are 14 at least: without such a run there is nothing to split the text for.
        pattern = PATTERNS[kind]
        found = F.filter(find_all(text, pattern, kind), _valid(kind))
        if kind == "card":
            found = F.when(F.regexp_like(text, F.lit(r"[0-9](?:[ -]?[0-9]){13}")), found).otherwise(empty)
        elif _NEEDS[kind]:
            found = F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(empty)
        out[kind] = found
    return out


def secrets(text: Column) -> Column:
    """The spans of tokens that are keys by their own information."""
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Fa-f]")
    return F.filter(find_all(text, _SECRET, SECRET), mixed)


#: Rows of a table that may be broadcast, an element of an array counting as one; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def _bounded(df: DataFrame) -> DataFrame:
    """df (written) with a broadcast hint if its rows, with the elements of their arrays, are within the bound."""
    arrays = [F.coalesce(F.greatest(F.size(f.name), F.lit(0)), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "array"]
    size = df.agg(F.coalesce(F.sum(sum(arrays, F.lit(1))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def _rest(text: Column) -> Column:
    """The text without its addresses; the other kinds hold no letters."""
    return F.when(F.contains(text, F.lit(_NEEDS["email"])), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, key (tells rows of one id apart), copy (the same for equal texts), spans of each kind, secrets, the
    different entities, and the terms of a text that holds any entity."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.select("doc_id", row_key("doc_id", "text").alias("key"), F.xxhash64("text").alias("copy"), "text", F.concat(*base_spans(F.col("text")).values()).alias("spans"), secrets(F.col("text")).alias("secrets"))
    # A filter on size() >= 0 keeps the spans in a column of their own instead of copying their expression to every use.
    t = t.where(F.size("spans") >= 0)
    entities = F.array_distinct(F.transform("spans", lambda e: F.xxhash64(e["kind"], e["value"])))
    terms = F.when(F.size("spans") > 0, _terms(_rest(F.col("text")))).otherwise(F.array().cast("array<string>"))
    return t.select("doc_id", "key", "copy", "spans", "secrets", entities.alias("entities"), terms.alias("terms"))


def _count(df: DataFrame, by: str | list[str], name: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def _exceeds(texts: str, total: int) -> Column:
    """The thresholds, with the column texts as the number of the term's texts."""
    bits = F.log2(F.col("both") * F.lit(total) / (F.col(texts) * F.col("n_entity")))
    return (bits >= MIN_BITS) & (F.col("both") >= MIN_SHARE * F.col(texts))


def co_occurring(scanned: DataFrame, total: int) -> DataFrame:
    """(term, entity, n_entity, both): terms that may reveal an entity, judged by the texts that hold entities.

    No term shares more texts with an entity than hold it, and none has fewer texts than those that hold it and an entity. So
    entities in too few texts, or in so many that no term has the bits, and terms whose share is too small, go without loss."""
    held = written(scanned.where(F.size("entities") > 0).select("copy", "entities", "terms").dropDuplicates(["copy"]))
    pairs = held.select("copy", F.explode("entities").alias("entity"))
    n_entity = written(_count(pairs, "entity", "n_entity").where((F.col("n_entity") >= MIN_CONTEXTS) & (F.col("n_entity") * 2.0**MIN_BITS <= total)))
    chosen = written(pairs.join(_bounded(n_entity.select("entity")), "entity").groupBy("copy").agg(F.collect_list("entity").alias("entities")))
    near = held.select("copy", "terms").join(_bounded(chosen), "copy")
    both = _count(near.select("terms", F.explode("entities").alias("entity")).select("entity", F.explode("terms").alias("term")), ["term", "entity"], "both")
    both = written(both.where(F.col("both") >= MIN_CONTEXTS))
    n_near = written(_count(held.select(F.explode("terms").alias("term")), "term", "n_near").where(F.col("n_near") >= MIN_CONTEXTS))
    return both.join(_bounded(n_near), "term").join(_bounded(n_entity), "entity").where(_exceeds("n_near", total)).select("term", "entity", "n_entity", "both")


def term_hits(docs: DataFrame, scanned: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame | None:
    """(doc_id, key, terms): the revealing terms of each text that has any; None if no term of the corpus can be one.

    Only terms that co_occurring() lets pass are counted in all texts, those first that pass in a part of them as well: a term
    has no fewer texts in the whole than in a part. Only the places of revealing terms are moved."""
    total = scanned.select("copy").distinct().count()
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    found = written(co_occurring(scanned, total))
    for part in (t.where(F.pmod("copy", F.lit(FIRST_LOOK)) == 0), t):
        if found.isEmpty():
            return None
        terms = _bounded(written(found.select("term").distinct()))
        n_term = _count(part.select("copy", F.explode(_terms(_rest(F.col("text")))).alias("term")).join(terms, "term").distinct(), "term", "n_term")
        found = written(found.join(_bounded(written(n_term)), "term", "left").where(F.col("n_term").isNull() | _exceeds("n_term", total)).drop("n_term"))
    if found.isEmpty():
        return None
    revealing = _bounded(written(found.select("term").distinct()))
    places = t.select("doc_id", row_key("doc_id", "text").alias("key"), F.explode(_terms(F.col("text"))).alias("term")).join(revealing, "term")
    return written(places.groupBy("doc_id", "key").agg(F.collect_set("term").alias("terms")))


def _term_spans(text: Column, terms: Column) -> Column:
    """The places of the terms as whole words."""
    return F.filter(find_all(text, _WORD, TERM), lambda s: F.array_contains(terms, F.lower(s["value"])))


def _by_start(spans: Column) -> Column:
    """By start, then kind in the listed order."""
    order = F.create_map(*[x for i, k in enumerate((*KINDS, TERM, SECRET)) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.sort_array(keyed)


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: counts of the base kinds, and the ordered spans, base ones and all."""
    scanned = scan(docs, doc_id, text)
    scanned = written(scanned)
    hits = term_hits(docs, scanned, doc_id, text)
    base = scanned.select("doc_id", "key", "spans", "secrets")
    if hits is None:
        both = base.withColumn("extra", F.array().cast(_SPANS))
    else:
        t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        t = t.withColumn("key", row_key("doc_id", "text")).alias("t")
        h = _bounded(hits).alias("h")
        on = F.col("t.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("t.key") == F.col("h.key"))
        extra = t.join(h, on).select(F.col("t.doc_id").alias("i"), F.col("t.key").alias("k"), _term_spans(F.col("t.text"), F.col("h.terms")).alias("extra")).dropDuplicates(["i", "k"])
        both = base.join(extra, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").drop("i", "k")
        both = both.withColumn("extra", F.coalesce("extra", F.array().cast(_SPANS)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return both.select("doc_id", *[count(k) for k in KINDS], _by_start(F.col("spans")).alias("base"), _by_start(F.concat("spans", "secrets", "extra")).alias("all"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query over detect()'s rows."""
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with entities generalised to their kind in brackets and revealing terms removed to a mark; the columns of docs.

    Overlapping spans become one, named by the first. A column n_chars, if there is one, follows the text."""
    hits = term_hits(docs, written(scan(docs, doc_id, text)), doc_id, text)
    cols = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    t = whole.select("row", F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("text"), F.col(f"row.`{doc_id}`").alias("doc_id"))
    if hits is None:
        t = t.withColumn("terms", F.array().cast("array<string>"))
    else:
        h = _bounded(hits).alias("h")
        t = t.withColumn("key", row_key("doc_id", "text")).alias("t")
        t = t.join(h, F.col("t.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("t.key") == F.col("h.key")), "left")
        t = t.select("t.row", "t.text", F.coalesce("h.terms", F.array().cast("array<string>")).alias("terms"))
    extra = F.when(F.size("terms") > 0, _term_spans(F.col("text"), F.col("terms"))).otherwise(F.array().cast(_SPANS))
    spans = _by_start(F.concat(*base_spans(F.col("text")).values(), secrets(F.col("text")), extra))

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (s["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(own)))

    merged = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"), lambda acc, s: merge(acc, s))

    def redact(m: Column) -> Column:
        pieces = F.transform(
            m, lambda s, i: F.concat(F.substring("text", F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        )
        return F.concat(F.array_join(pieces, ""), F.substring("text", F.element_at(m, -1)["end"] + 1, F.length("text")))

    new = let(merged, lambda m: F.when(F.size(m) > 0, redact(m)))
    t = t.withColumn("new", new)
    fixed = F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col(f"row.`{text}`"))
    out = [
        fixed.alias(c) if c == text else F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in cols
    ]
    return t.select(*out)
