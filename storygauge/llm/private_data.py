"""Personal data: base patterns, and terms that the corpus shows to reveal the entities found by them.

Base kinds are email, ip, card and phone, leftmost non-overlapping per kind, in code points. Every value found is a
protected entity. Terms are the tokens of the documents that mention it: runs of other than white space without the signs at
their ends, in lower case, whatever they are made of and wherever in the document they stand. With documents as events, a term t
reveals an entity e by their pointwise mutual information over e's own information, ``ln(N d_et / (d_e d_t)) / ln(N / d_e)``: 1
where t is never seen without e. All counts are over whole documents: N documents, d_e that mention e, d_t that hold t, d_et that
do both. A ratio is trusted from ``support`` documents of different tokens on, so copies of a text prove nothing.

A ratio of r asks for ``d_t <= d_e^r N^(1-r)``. Terms and entities that cannot reach it or the support are left out before they
are paired, which leaves few terms of a document, and changes no result.

In documents that mention e, terms at or above ``generalise_at`` are generalised: to their longest beginning that ``CROWD``
different tokens of the corpus share, or to their class where there is none. Those at or above ``remove_at`` are removed.

A null text counts as empty; long texts are searched whole. Rows that repeat id and text have equal results; null ids are
ids. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storygauge.llm.common import WORD, durable, let, small_side, staged, texts

# Possessive repeats match what greedy ones do here and need no stack on long runs of digits or labels. A card has 14
# digits at least, and a shorter run of digits cannot hide a longer one, so the pattern asks for them at once.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
MARKS = {"email": "@", "ip": ".", "phone": "+"}  # a text without it holds none of the kind
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TOKEN, EDGES = WORD, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
CROWD = 5  # different tokens that must share the beginning a term is generalised to
GENERALISED, REMOVED = "<word>", ""
_STEP = 256  # numbers summed up at a time
_SLACK = 1e-9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def share(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), share), F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return (F.length(_digits(value)) <= 19) & passes_luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _before_each(sizes: Column) -> Column:
    """For each number of an array the sum of those before it, in two levels, so that work grows with the array's length."""
    none = F.array().cast("array<int>")

    def sums(numbers: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), none.alias("list"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["list"], F.array(acc["at"])).alias("list"))
        return F.aggregate(numbers, start, step)["list"]

    count = F.ceil(F.size(sizes) / _STEP).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(sizes, c * _STEP + 1, F.lit(_STEP)))

    def run(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda t, x: t + x))
        return let(sums(totals, F.lit(0)), lambda first: F.flatten(F.transform(parts, lambda p, i: sums(p, F.get(first, i)))))

    return F.when(F.size(sizes) == 0, none).otherwise(let(chunks, run))


def _located(text: Column, pattern: Column, kind: str) -> Column:
    """All matches with their places: the lengths of the pieces between matches and of the matches add up."""
    none = F.array().cast(SPAN)

    def places(found: Column) -> Column:
        def run(pieces: Column) -> Column:
            sizes = F.transform(found, lambda f, i: F.length(F.get(pieces, i)) + F.length(f))

            def span(value: Column, i: Column, before: Column) -> Column:
                begin = F.get(before, i) + F.length(F.get(pieces, i))
                return F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (begin + F.length(value)).alias("end"),
                                F.lit(kind).alias("kind"), value.alias("value"))

            return let(_before_each(sizes), lambda before: F.transform(found, lambda f, i: span(f, i, before)))

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), run))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if mark := MARKS.get(kind):
        found = F.when(F.contains(text, F.lit(mark)), found).otherwise(F.array().cast("array<string>"))
    return let(found, places)


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by start, then kind."""
    def of(kind: str) -> Column:
        return F.filter(_located(text, F.lit(PATTERNS[kind]), kind), lambda s: _valid(kind, s["value"]))

    return F.array_sort(F.concat(*map(of, PATTERNS)))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _entity(span: Column) -> Column:
    """One spelling for each entity: digits of a card or phone, lower case otherwise."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _term(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, EDGES, ""))


def terms_in(text: Column) -> Column:
    """The different terms of a text, in order."""
    every = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _term)
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: t != "")))


def _row_key() -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))))


def disclosing_terms(docs: DataFrame, found: DataFrame, total: int, generalise_at: float, support: int) -> DataFrame:
    """``entity, term, ratio`` of the terms that reveal an entity.

    ``found`` holds ``entities`` and ``terms`` of the documents with base spans. Documents alike in both are counted before they move.
    """
    alike = F.md5(F.concat_ws("\n", F.array_join("entities", "\r"), F.array_join("terms", "\r")))
    sets = durable(found.groupBy(alike.alias("alike")).agg(
        F.count(F.lit(1)).alias("docs"), F.first("entities").alias("entities"), F.first("terms").alias("terms")))
    n = float(total)
    named = sets.select("alike", "docs", F.explode("entities").alias("entity"))
    entities = named.groupBy("entity").agg(F.sum("docs").alias("d_e"), F.count(F.lit(1)).alias("sets"))
    entities = durable(entities.filter((F.col("sets") >= support) & (F.col("d_e") < n)).select("entity", "d_e"))
    most = entities.agg(F.max("d_e")).head()[0]
    limit = lambda d_e: F.pow(d_e.cast("double"), F.lit(generalise_at)) * F.pow(F.lit(n), F.lit(1 - generalise_at)) * (1 + _SLACK)
    if most is None:
        return entities.select("entity", F.lit("").alias("term"), F.lit(0.0).alias("ratio")).limit(0)
    # one row a term and task is shuffled; what is too frequent or too rare for any entity goes here
    held = texts(docs).select(F.explode(terms_in(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("d_t"))
    rare = held.filter((F.col("d_t") >= support) & (F.col("d_t") <= limit(F.lit(most))))
    likely = sets.select("alike", "docs", F.explode("terms").alias("term")).join(rare, "term")
    pairs = likely.join(named.select("alike", "entity").join(entities, "entity"), "alike").filter(F.col("d_t") <= limit(F.col("d_e")))
    counted = pairs.groupBy("entity", "term").agg(
        F.sum("docs").alias("d_et"), F.count(F.lit(1)).alias("sets"), F.max("d_t").alias("d_t"), F.max("d_e").alias("d_e")).filter(F.col("sets") >= support)
    ratio = F.log(F.lit(n) * F.col("d_et") / (F.col("d_e").cast("double") * F.col("d_t"))) / F.log(F.lit(n) / F.col("d_e"))
    return counted.select("entity", "term", ratio.alias("ratio")).filter(F.col("ratio") >= generalise_at)


def coarser_values(docs: DataFrame, terms: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``term, coarse``: the longest beginning of a term that ``crowd`` different tokens of the corpus share, followed by a star."""
    cut = terms.select("term", F.explode(F.sequence(F.lit(1), F.greatest(F.length("term") - 1, F.lit(1)))).alias("size"))
    cut = cut.filter(F.col("size") < F.length("term")).select("term", "size", F.expr("substring(term, 1, size)").alias("beginning"))
    wanted, count = staged(cut.select("beginning").distinct())
    if not count:  # every term is removed, or too short to be cut
        return terms.select("term", F.lit("").alias("coarse")).limit(0)
    held = texts(docs).select(F.explode(terms_in(F.col("text"))).alias("token")).distinct()
    sizes = F.sequence(F.lit(1), F.length("token"))
    beginnings = held.select("token", F.explode(F.transform(sizes, lambda n: F.substring(F.col("token"), F.lit(1), n))).alias("beginning"))
    shared = beginnings.join(small_side(wanted, count), "beginning", "left_semi").groupBy("beginning").agg(F.count(F.lit(1)).alias("n"))
    best = cut.join(shared.filter(F.col("n") >= crowd), "beginning").groupBy("term").agg(F.max_by("beginning", "size").alias("beginning"))
    return best.select("term", F.concat("beginning", F.lit("*")).alias("coarse"))


def find_private(docs: DataFrame, generalise_at: float = 0.8, remove_at: float = 0.95, support: int = 3, crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id, base, spans``; spans are structs of start, rank, end, kind, value.

    ``base`` has those of the patterns, ``spans`` also the disclosing terms, whole tokens that no base span overlaps; a term's
    value is what takes its place.
    """
    source = texts(docs).withColumn("_key", _row_key())
    with_base = source.withColumn("base", base_spans(F.col("text")))
    some = F.size("base") > 0
    rows = durable(with_base.select(
        "doc_id", "_key", "base", F.when(some, F.array_sort(F.array_distinct(F.transform("base", _entity)))).alias("entities"),
        F.when(some, terms_in(F.col("text"))).alias("terms"),
    ))
    found = rows.filter("entities is not null")
    revealing, count = staged(disclosing_terms(docs, found, rows.count(), generalise_at, support))
    plain = rows.select("doc_id", "_key", "base")
    if not count:
        return plain.withColumn("spans", F.col("base"))
    coarse = coarser_values(docs, revealing.filter(F.col("ratio") < remove_at).select("term").distinct(), crowd)
    valued = revealing.join(coarse, "term", "left").withColumn("coarse", F.coalesce("coarse", F.lit(GENERALISED)))
    mentions = found.select("_key", F.explode("entities").alias("entity")).distinct()
    by_doc = mentions.join(small_side(durable(valued), count), "entity").groupBy("_key", "term").agg(
        F.max(F.struct("ratio", "coarse")).alias("best"))
    by_key, by_key_count = staged(by_doc.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "best"))).alias("_terms")))
    inside = source.join(small_side(by_key, by_key_count), "_key").withColumn("base", base_spans(F.col("text")))

    def trimmed(s: Column) -> Column:
        """A token's span without the signs at its ends, its value the term's."""
        ahead = F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[^\p{L}\p{N}]+", ""))
        own = F.regexp_replace(s["value"], EDGES, "")
        begin = s["start"] + ahead
        return F.struct(begin.alias("start"), s["rank"].alias("rank"), (begin + F.length(own)).alias("end"), s["kind"].alias("kind"), F.lower(own).alias("value"))

    def replaced(s: Column) -> Column:
        best = F.try_element_at("_terms", s["value"])
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
                        F.when(best["ratio"] >= remove_at, F.lit(REMOVED)).otherwise(best["coarse"]).alias("value"))

    tokens = F.transform(_located(F.col("text"), F.lit(TOKEN), "term"), trimmed)
    known = F.filter(tokens, lambda s: F.map_contains_key("_terms", s["value"]))
    apart = F.filter(known, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    extra, extra_count = staged(inside.select("_key", F.transform(apart, replaced).alias("_extra")).groupBy("_key").agg(F.first("_extra").alias("_extra")))
    joined = plain.join(small_side(extra, extra_count), "_key", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("_extra", F.array().cast(SPAN))))
    return joined.select("doc_id", "_key", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, **options: float) -> DataFrame:
    """``doc_id, text`` with every base span replaced by its kind, revealing terms generalised or removed.

    Of spans that overlap, the first and longest replaces the whole stretch.
    """
    found = find_private(docs, **options)
    spans, count = staged(found.filter(F.size("spans") > 0).groupBy("_key").agg(F.first("spans").alias("spans")))
    source = texts(docs).withColumn("_key", _row_key()).join(small_side(spans, count), "_key", "left")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"), s["value"].alias("value"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        new = F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), mark)
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], -s["last"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct((-s["last"]).alias("at"), new.alias("out")))

    run = let(F.aggregate(ordered, start, step), lambda r: F.concat(r["out"], F.substring("text", r["at"] + 1, F.length("text"))))
    return source.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(run).alias("text"))
