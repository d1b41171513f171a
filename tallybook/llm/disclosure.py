"""Information-theoretic sanitisation: personal data, and the terms that reveal it.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by pattern:
leftmost, non-overlapping for each kind, failing matches dropped. Each distinct value is
a protected entity. The corpus tells how strongly a term reveals an entity: with
p(e) the share of documents that hold the entity and p(e|t) that of the documents with
the term that hold it, the term discloses log(p(e|t) / p(e)) of the -log p(e) nats that
the entity is worth. Terms that disclose at least `threshold` of it, and share at least
`support` different texts with it, are spans of kind `term` wherever they occur, also in
documents without that entity.

A term is a whole run of two or more letters or digits in any case; what looks like
personal data holds none. Co-occurrence is that of whole documents. The bound prunes: as
no more documents can share both than hold the entity, a term in more than
p(e)^(threshold - 1) times as many cannot reveal it. What is left are the pairs of an
entity seen in several texts with the rare terms of its documents, summed before they
are shuffled.

All counts are over all documents. Only DataFrame functions are used. Positions are code
points, ends exclusive. A null text is empty; texts of any length are read whole, in one
row. Repeated rows count as documents and get the same result, copies of one text are no
further evidence. A term exactly at the threshold counts. An empty table gives an empty
result. A null `doc_id` stays null. Columns besides `doc_id` and `text` are not read;
`sanitised` keeps them, whatever their names (its own columns are nested in one it names
freely).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.session import is_small, materialise

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Where a match may begin: at the start of a run, or where the last match ended. Inside
# a run no later start can match if its first one does not.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A whole chain of digits with single separators that has 16 to 19 of them.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"[\p{L}\p{N}]{2,}+"
# Values added up at once in running totals.
RUN = 256

SPANS = "array<struct<kind:string,start:int,stop:int,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts doubled."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(
        numbers,
        lambda n, i: F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, n: total + F.coalesce(n, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def may_hold(kind: str, text: Column) -> Column:
    """A cheap condition without which no match is possible."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return F.lit(True)


def totals(values: Column) -> Column:
    """Running totals of an array of ints, summed by blocks: an append copies its array."""
    none = F.array().cast("array<int>")

    def block(some: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), none.alias("sums"))

        def step(done: Column, x: Column) -> Column:
            total = done["total"] + x
            return F.struct(total.alias("total"), F.array_append(done["sums"], total).alias("sums"))

        return F.aggregate(some, start, step)

    def joined(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("sums"))

        def step(done: Column, x: Column) -> Column:
            moved = F.transform(x["sums"], lambda s: s + done["total"])
            return F.struct(
                (done["total"] + x["total"]).alias("total"),
                F.array_append(done["sums"], moved).alias("sums"),
            )

        return F.aggregate(blocks, start, step, lambda done: F.flatten(done["sums"]))

    def summed(all_values: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(all_values), F.lit(RUN))
        return joined(F.transform(firsts, lambda i: block(F.slice(all_values, i, RUN))))

    # a lambda's argument is computed once
    return F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, summed(v)).otherwise(none))[0]


def placed(text: Column, pattern: Column, hits: Column, kind: str) -> Column:
    """Spans of the matches `hits` of `pattern`: the text between matches tells their places."""
    between = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    stops = totals(F.zip_with(between, hits, lambda gap, hit: F.length(gap) + F.length(hit)))

    def span(stop: Column, hit: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            (stop - F.length(hit)).alias("start"),
            stop.alias("stop"),
            hit.alias("value"),
        )

    return F.when(F.size(hits) > 0, F.zip_with(stops, hits, span)).otherwise(F.array().cast(SPANS))


def base_spans(docs: DataFrame) -> DataFrame:
    """`docs` with `base`: the spans of the four kinds, by kind and start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    hits = {
        f"_hits_{kind}": F.when(
            may_hold(kind, text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        ).otherwise(none)
        for kind, pattern in PATTERNS.items()
    }
    rows = docs.withColumns(hits)

    def checked(kind: str) -> Column:
        spans = placed(text, F.lit(PATTERNS[kind]), F.col(f"_hits_{kind}"), kind)
        return F.filter(spans, lambda s: valid(kind, s["value"]))

    spans = [checked(kind) for kind in KINDS]
    return rows.withColumn("base", F.concat(*spans)).drop(*hits)


def entity(span: Column) -> Column:
    """What makes two values the same: case and separators do not count."""
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", ""))
    return F.concat(span["kind"], F.lit(":"), F.lower(F.coalesce(plain, span["value"])))


def sent(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast only if measured to be small."""
    return F.broadcast(df) if is_small(df) else df


def own_words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    hits = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_distinct(F.transform(hits, F.lower))


def scanned(rows: DataFrame) -> DataFrame:
    """`row_id, text_id, base, words` of every row; words in personal data do not count."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = text
    for kind, pattern in PATTERNS.items():
        plain = F.when(may_hold(kind, text), F.regexp_replace(plain, pattern, " ")).otherwise(plain)
    words = F.when(F.size("base") > 0, own_words(plain)).otherwise(own_words(text))
    return base_spans(rows).select("row_id", "text_id", "base", words.alias("words"))


def revealing_terms(
    corpus: DataFrame, found: DataFrame, threshold: float, support: int
) -> DataFrame:
    """`entity, term` of all terms that disclose an entity by at least the threshold.

    `corpus` are all rows with their `words`; `found` the different ones with base spans:
    `row_id, text_id, base, words, copies`.
    """
    total = corpus.count()
    own = F.explode(F.array_distinct(F.transform("base", entity))).alias("entity")
    held = materialise(found.select("row_id", "text_id", "copies", own))
    texts = held.groupBy("entity", "text_id").agg(F.sum("copies").alias("copies"))
    worth = F.log(F.lit(float(max(total, 1))) / F.col("with_entity"))
    entities = (
        texts.groupBy("entity")
        .agg(F.count("*").alias("texts"), F.sum("copies").alias("with_entity"))
        .withColumn("worth", worth)
        .where((F.col("texts") >= support) & (F.col("worth") > 0))
        .withColumn("most", F.col("with_entity") * F.exp((1 - threshold) * F.col("worth")))
        .drop("texts")
    )
    entities = materialise(entities)
    # rounding may not lose a pair: the exact condition follows
    most = (entities.agg(F.max("most")).first()[0] or 0.0) * (1 + 1e-9)
    # documents with each word, over the whole corpus
    counts = corpus.select(F.explode("words").alias("term")).groupBy("term")
    counts = counts.agg(F.count("*").alias("with_term"))
    rare = materialise(counts.where((F.col("with_term") >= support) & (F.col("with_term") <= most)))
    held = materialise(held.join(sent(entities), "entity"))
    ids = materialise(held.select("row_id").distinct())
    words = found.join(sent(ids), "row_id", "left_semi").select("row_id", F.explode("words").alias("term"))
    pairs = words.join(sent(rare), "term").join(held, "row_id")
    pairs = pairs.where(F.col("with_term") <= F.col("most") * (1 + 1e-9))
    pair = ["entity", "term", "worth", "with_term"]
    together = pairs.groupBy(*pair, "text_id").agg(F.sum("copies").alias("copies"))
    together = together.groupBy(*pair).agg(F.count("*").alias("texts"), F.sum("copies").alias("together"))
    told = F.log(F.col("together") / F.col("with_term")) + F.col("worth")
    enough = (F.col("texts") >= support) & (told >= threshold * F.col("worth"))
    return materialise(together.where(enough).select("entity", "term"))


def identified(docs: DataFrame) -> DataFrame:
    text_id = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumn("text_id", text_id).withColumn("row_id", F.xxhash64("doc_id", "text_id"))


def term_spans(rows: DataFrame, corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """`row_id, terms`: the spans of the words in `terms` in every row that has any."""
    words = corpus.select("row_id", F.explode("words").alias("term"))
    holders = materialise(words.join(terms, "term", "left_semi").select("row_id").distinct())
    texts = rows.join(sent(holders), "row_id", "left_semi").groupBy("row_id").agg(F.first("text").alias("text"))
    hits = texts.withColumn("hits", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    spans = hits.select("row_id", F.explode(placed(F.col("text"), F.lit(WORD), F.col("hits"), TERM)).alias("span"))
    marked = spans.withColumn("term", F.lower("span.value")).join(terms, "term", "left_semi")
    order = F.sort_array(F.collect_list(F.struct("span.start", "span")))
    return marked.groupBy("row_id").agg(order["span"].alias("terms"))


def all_spans(docs: DataFrame, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """Per row: `doc_id, row_id`, the `base` spans, and the `terms` spans that the method adds.

    Term spans that overlap a base span are part of it and not listed.
    """
    rows = identified(docs.select("doc_id", "text"))
    corpus = materialise(scanned(rows))
    found = corpus.where(F.size("base") > 0).groupBy("row_id", "text_id")
    found = found.agg(F.first("base").alias("base"), F.first("words").alias("words"), F.count("*").alias("copies"))
    found = materialise(found)
    revealing = revealing_terms(corpus, found, threshold, support)
    terms = materialise(revealing.select("term").distinct())
    marked = materialise(term_spans(rows, corpus, sent(terms)))
    nothing = F.array().cast(SPANS)
    both = found.select("row_id", "base").join(marked, "row_id", "full")
    both = both.select("row_id", F.coalesce("base", nothing).alias("base"), F.coalesce("terms", nothing).alias("terms"))
    clear = F.filter(
        "terms",
        lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
    )
    both = materialise(both.withColumn("terms", clear))
    plain = rows.select("doc_id", "row_id")
    out = plain.join(sent(both), "row_id", "left")
    return out.select(
        "doc_id",
        "row_id",
        F.coalesce("base", nothing).alias("base"),
        F.coalesce("terms", nothing).alias("terms"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sanitised(docs: DataFrame, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """The rows of `docs` with every span replaced by its kind in brackets; same columns.

    Overlapping spans are replaced as one, named after the first. Rows without spans
    keep their text as it is, null included.
    """
    spans = all_spans(docs, threshold, support)
    ordered = F.array_sort(
        F.concat("base", "terms"),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]),
    )
    some = (F.size("base") > 0) | (F.size("terms") > 0)
    found = spans.where(some).select("row_id", ordered.alias("spans"))
    found = materialise(found.dropDuplicates(["row_id"]))
    text_id = F.xxhash64(F.coalesce("text", F.lit("")))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(own.alias("own"), F.xxhash64("doc_id", text_id).alias("row_id"))
    rows = rows.join(F.broadcast(found) if is_small(found) else found, "row_id", "left")
    text = F.col("own.text")

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["stop"]
        gap = F.substring(text, done["stop"] + 1, span["start"] - done["stop"])
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        more = F.when(fresh, F.concat(done["out"], gap, mark)).otherwise(done["out"])
        return F.struct(more.alias("out"), F.greatest(done["stop"], span["stop"]).alias("stop"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("stop"))
    end = F.length(text)

    def last(done: Column) -> Column:
        return F.concat(done["out"], F.substring(text, done["stop"] + 1, end))

    clean = F.when(F.col("spans").isNull(), text).otherwise(F.aggregate("spans", start, step, last))
    return rows.select(*((clean if c == "text" else F.col(f"own.`{c}`")).alias(c) for c in docs.columns))
