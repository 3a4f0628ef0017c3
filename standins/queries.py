"""The registered queries: every operator run over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from standins.stubs import LETTERS, scripted_generator, scripted_labeller
from standins.views import (
    BACKLOG, LABEL_REPLIES, MENTIONS, MIN_SIMILARITY, NEIGHBOUR_TEXTS, REPLIES, REWRITES, RUBRIC_SHEET, SUBMISSIONS, Tables,
    vector_key,
)
from storygauge import schemas
from storygauge.functions import neighbours as fn, replies as fr, scale as fs, similarity as fv, text as ft
from storygauge.operators import (
    cleaning, encode, estimate, generate, index as nn_index, ingest, metrics, neighbours as nn, profile, review, sampling,
)
from storygauge.plans import evaluate, export, ingest as ingest_job, lookup, scores
from storygauge.session import durable, shared_folder
from storygauge.sources import backlog, files, tables, vectors as vector_store
from storygauge.streaming.ingest import stream_upserts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LARGE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def query(fn_: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn_.__name__] = lambda spark, directory: fn_(Tables(spark, directory))
    return fn_


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that another engine's summation order does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of the session."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """The table after a write and a read, as one run's results are scored by several reports."""
    path = scratch(t.spark, name)
    df.write.parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)


def tickets_of(t: Tables) -> DataFrame:
    return cleaning.to_tickets(tables.load_issues_for_export(t.issues(), t.projects(), include_zero=True))


def letter_vectors(t: Tables) -> DataFrame:
    """Vector-table rows of every document, from the letter-count encoder."""
    return ingest.embed_tickets(t.tickets(), LETTERS)


# --- retrieval and estimates -----------------------------------------------------------------------
@query
def neighbour_estimates(t):
    return rounded(t.estimates())


@query
def nearest_tickets(t):
    return t.neighbours().select("query_key", "rank", "issue_key", "story_points", "similarity")


@query
def nearest_tickets_by_blocks(t):
    """Several scans of the corpus, each for as many queries as a small bound allows."""
    found = nn.nearest(t.queries(), t.vectors(), 10, broadcast_bytes=1 << 17)
    return found.select("query_key", "rank", "issue_key", "story_points", "similarity")


def _coded(t: Tables) -> tuple[nn_index.VectorIndex, DataFrame]:
    """An index of all vectors, and the vectors with their cells and codes."""
    index = nn_index.VectorIndex.fit(t.vectors(), 16)
    return index, durable(index.place(nn.searchable(t.vectors()).select("issue_key", "story_points", "embedding")).drop("apart"))


@query
def approximate_tickets(t):
    """For each query the ten nearest tickets that a search by codes finds. Without SQL; unit tests hold it against brute force."""
    index, stored = _coded(t)
    return nn_index.coded_neighbours(t.queries(), stored, index, 10).select("query_key", "rank", "issue_key", "story_points", "similarity")


@query
def approximate_recall(t):
    """The share of the exact neighbours that a search by codes finds, through a stored index and a table stored by cell; what was
    expected when the index was fitted; and the shares of vectors that a query compares and of cells whose codes it reads."""
    path = scratch(t.spark, "index")
    rows = t.vectors().withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("embedding_model", F.lit("all"))
    vector_store.write_vectors(rows, path, index=nn_index.VectorIndex.fit(rows, 16))
    index, stored = vector_store.read_index(t.spark, path, "all"), vector_store.read_vectors(t.spark, path, "all", indexed=True)
    found = nn_index.coded_neighbours(t.queries(), stored, index, 10)
    total = t.vectors().agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(float(max(index.shortlist, 40))) / total.scalar()
    return nn.recall(found, t.neighbours()).select(
        "n_exact", "recall", F.lit(index.expected_recall).alias("expected"), share.alias("vectors_share"),
        F.lit(index.probes / len(index.ids)).alias("cells_share"),
    )


@query
def nearest_tickets_by_cells(t):
    """The exact neighbours, found in the cells that the bounds leave."""
    index, stored = _coded(t)
    found = nn_index.nearest_by_cells(t.queries(), stored, index, 10)
    return found.select("query_key", "rank", "issue_key", "story_points", "similarity")


@query
def looked_up_in_a_kept_store(t):
    """Ticket texts looked up in a store that was indexed, then added to, partly written over and split: the exact neighbours."""
    path = scratch(t.spark, "kept")
    tickets = t.tickets()
    vectors = durable(ingest.embed_tickets(tickets.filter("doc_id % 3 <> 0"), LETTERS))
    vector_store.write_vectors(vectors, path, index=nn_index.VectorIndex.fit(vectors, 6))
    ingest_job.ingest(tickets, path, LETTERS)
    changed = tickets.filter("doc_id % 5 = 0").withColumn("description", F.concat("description", F.lit(" zzz")))
    ingest_job.ingest(changed, path, LETTERS, force=True)
    vector_store.split_crowded(t.spark, path, LETTERS.model, max(1, tickets.count() // 4))
    index = vector_store.read_index(t.spark, path, LETTERS.model)
    stored = vector_store.read_vectors(t.spark, path, LETTERS.model, indexed=True)
    return _answer_parts(lookup.lookup_json(t.view(SUBMISSIONS), stored, LETTERS, 3, index=index, probes=len(index.ids)))


@query
def looked_up_through_an_index(t):
    """Ticket texts looked up in a table stored by cell, with all cells probed: the exact neighbours."""
    folder = scratch(t.spark, "index")
    vectors = letter_vectors(t)
    index = nn.CellIndex.fit(vectors, 6)
    vector_store.write_vectors(vectors, f"{folder}/vectors", index=index)
    stored = vector_store.read_vectors(t.spark, f"{folder}/vectors", LETTERS.model, indexed=True)
    answers = lookup.lookup_json(t.view(SUBMISSIONS), stored, LETTERS, 3, index=index, probes=6)
    return _answer_parts(answers)


@query
def neighbours_at_most_fifty(t):
    """A lookup that asks for 80 neighbours gets 50."""
    found = lookup.find_similar(t.view(SUBMISSIONS), letter_vectors(t), LETTERS, 80)
    return found.groupBy("query_key").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))


@query
def approximate_tickets_all_cells(t):
    index = nn.CellIndex.fit(t.vectors(), 8)
    found = nn.approximate_neighbours(t.queries(), t.vectors(), index, 10, probes=8, block_rows=64)
    return found.select("query_key", "rank", "issue_key", "story_points", "similarity")


@query
def close_neighbours(t):
    return estimate.similar_enough(t.neighbours(), MIN_SIMILARITY).select("query_key", "issue_key", "similarity")


@query
def neighbour_spread(t):
    return estimate.neighbour_spread(t.neighbours())


@query
def cosine_of_successors(t):
    v = t.table("embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = v.join(nxt, "vec_id")
    return rounded(pairs.select("vec_id", fv.cosine(F.col("embedding"), F.col("next")).alias("similarity")))


@query
def unit_vectors(t):
    unit = fv.unit(F.col("query_vector"))
    return rounded(t.queries().select(
        "query_key", fv.norm(F.col("query_vector")).alias("length"), fv.norm(unit).alias("unit_length"), unit[0].alias("first")
    ))


@query
def vector_quality(t):
    vectors = t.vectors().select("embedding")
    zeros = vectors.select(F.transform("embedding", lambda x: (x * 0).cast("float")).alias("embedding"))
    return nn.vector_quality(vectors.unionByName(zeros).unionByName(t.view(REWRITES).select("embedding")))


@query
def lookup_answers(t):
    """Every submission looked up among the documents' letter vectors; blank ones get an error."""
    return _answer_parts(lookup.lookup_json(t.view(SUBMISSIONS), letter_vectors(t), LETTERS, 3))


def _answer_parts(answers: DataFrame) -> DataFrame:
    """The error of an answer, or its neighbours' keys, points, similarities and texts, each as one text."""
    items = F.from_json("answer", "array<struct<issue_key string, story_points int, similarity double, title string, description string>>")
    joined = lambda name, text: F.when(
        F.col("answer").startswith("["), F.array_join(F.transform(items, text), ",")).alias(name)
    return answers.select(
        "doc_id",
        F.when(F.col("answer").startswith("{"), F.col("answer")).alias("error"),
        joined("keys", lambda i: i["issue_key"]), joined("points", lambda i: i["story_points"].cast("string")),
        joined("similarities", lambda i: F.format_string("%.4f", i["similarity"])),
        F.md5(joined("texts", lambda i: F.concat(i["title"], F.lit("|"), i["description"]))).alias("texts"),
    )


@query
def embedded_texts(t):
    made = LETTERS.transform(
        t.tickets().select("issue_key", ft.embedding_text(F.col("title"), F.col("description"), True).alias("text")), "text"
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b.cast("double"))
    return made.select("issue_key", F.size("embedding").alias("dimension"), total.alias("letters"), F.length("text").alias("chars"))


@query
def tfidf_vectors(t):
    tickets = t.tickets()
    encoder = encode.TfIdfEncoder.fit(tickets, "description", 64)
    made = encoder.transform(tickets.select("issue_key", "description"), "description")
    return made.select("issue_key", F.size("embedding").alias("dimension"), F.round(fv.norm(F.col("embedding")), 4).alias("length"))


# --- sources, cleaning, joins ----------------------------------------------------------------------
@query
def issues_for_profile(t):
    return tables.load_issues(t.issues(), t.projects())


@query
def issues_for_export(t):
    return tables.load_issues_for_export(t.issues(), t.projects())


@query
def issues_for_export_with_zero(t):
    return tables.load_issues_for_export(t.issues(), t.projects(), include_zero=True)


@query
def clean_tickets(t):
    return tickets_of(t)


@query
def eligible_tickets(t):
    return cleaning.eligible_pool(tickets_of(t))


@query
def issues_of_project(t):
    return cleaning.of_project(t.issues_large(), "NATION_7").select(*LARGE_KEY, "Story_Point")


@query
def keyed_issues(t):
    return cleaning.with_key(t.issues(), "Issue_Key").select("ID", "Issue_Key")


@query
def checked_submissions(t):
    return cleaning.mark_valid_submissions(t.view(SUBMISSIONS)).select("doc_id", "valid")


@query
def fractional_issues(t):
    return t.issues().filter(fs.is_fractional(F.col("Story_Point"))).select("ID", "Story_Point")


@query
def tickets_through_csv(t):
    path = scratch(t.spark, "tickets-csv")
    files.write_csv(tickets_of(t), path)
    return files.read_csv(t.spark, path, schemas.TICKETS)


@query
def backlog_from_json(t):
    """The backlog written as one JSON array, read back and extended by the submissions."""
    path = scratch(t.spark, "backlog")
    rows = t.view(BACKLOG).select(F.struct(*schemas.BACKLOG.fieldNames()).alias("row"))  # a table of fixed size
    rows.agg(F.to_json(F.collect_list("row")).alias("value")).write.text(path)
    accepted, _ = cleaning.split_submissions(t.view(SUBMISSIONS))
    return ingest.append_tickets(backlog.read_backlog(t.spark, path), accepted, [F.col("doc_id")])


@query
def tickets_through_split_csv(t):
    """The tickets through CSV files whose records any number of tasks put together."""
    path = scratch(t.spark, "split-csv")
    files.write_csv(tickets_of(t), path)  # no task writes them all
    return files.read_csv(t.spark, path, schemas.TICKETS, split=True)


@query
def backlog_from_split_json(t):
    """As ``backlog_from_json``, the array cut at its braces."""
    path = scratch(t.spark, "split-backlog")
    rows = t.view(BACKLOG).select(F.struct(*schemas.BACKLOG.fieldNames()).alias("row"))  # a table of fixed size
    rows.agg(F.to_json(F.collect_list("row")).alias("value")).write.text(path)
    accepted, _ = cleaning.split_submissions(t.view(SUBMISSIONS))
    return ingest.append_tickets(backlog.read_backlog(t.spark, path, split=True), accepted, [F.col("doc_id")])


@query
def backlog_with_submissions(t):
    accepted, _ = cleaning.split_submissions(t.view(SUBMISSIONS))
    return ingest.append_tickets(t.view(BACKLOG), accepted, [F.col("doc_id")])


@query
def upserted_vectors(t):
    fresh = t.view(REWRITES)
    stored = t.vectors().withColumn("created_at", F.lit(None).cast("timestamp"))
    merged = ingest.upsert_vectors(stored, fresh.withColumn("created_at", F.lit(None).cast("timestamp")), order=F.col("turn"))
    return merged.select(
        "issue_key", "embedding_model", "story_points", "description", F.col("created_at").isNotNull().alias("touched")
    )


@query
def upserted_vectors_one_model(t):
    fresh = t.view(REWRITES).withColumn("created_at", F.lit(None).cast("timestamp"))
    stored = t.vectors().withColumn("created_at", F.lit(None).cast("timestamp"))
    merged = ingest.upsert_vectors(stored, fresh, one_model=True, order=F.col("turn"))
    return merged.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("n"), F.sum("story_points").alias("points"))


@query
def stored_vectors_of_model(t):
    path = scratch(t.spark, "vectors")
    vector_store.write_vectors(t.vectors().withColumn("created_at", F.current_timestamp()), path)
    return vector_store.read_vectors(t.spark, path, "unit-64").select("issue_key", "story_points", F.size("embedding").alias("dimension"))


@query
def pending_tickets(t):
    return ingest.pending_rows(t.tickets(), t.vectors(), "unit-64").select("issue_key", "actual_story_points")


@query
def ingested_vectors(t):
    """Every ticket embedded into a new vector table, then again: the second run finds nothing to do."""
    path = scratch(t.spark, "ingest")
    first = ingest_job.ingest(t.tickets(), path, LETTERS)
    again = ingest_job.ingest(t.tickets(), path, LETTERS)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b.cast("double"))
    return vector_store.read_vectors(t.spark, path).select(
        "issue_key", "story_points", "embedding_model", total.alias("letters"),
        F.lit(first).cast("long").alias("first_run"), F.lit(again).cast("long").alias("second_run"),
    )


@query
def streamed_upserts(t):
    """Every ticket streamed into a vector table, then a second batch of repeats and changed ones: as one batch job would leave it."""
    source, store, state = (scratch(t.spark, name) for name in ("stream", "streamed", "state"))
    tickets = t.tickets().select(*schemas.TICKETS.fieldNames(), "doc_id")
    changed = tickets.filter("doc_id % 5 = 0").withColumn("description", F.concat("description", F.lit(" zzz")))
    for batch in (tickets, changed.unionByName(tickets.filter("doc_id % 5 = 1"))):
        batch.select(*schemas.TICKETS.fieldNames()).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(schemas.TICKETS).parquet(source)
        stream_upserts(stream, store, LETTERS, state, buckets=8).awaitTermination()
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b.cast("double"))
    return vector_store.read_vectors(t.spark, store).select("issue_key", "story_points", "embedding_model", total.alias("letters"))


# --- profile ---------------------------------------------------------------------------------------
@query
def dataset_summary(t):
    return profile.dataset_summary(t.issues())


@query
def dataset_summary_large(t):
    return profile.dataset_summary(t.issues_large())


@query
def missing_fields(t):
    return profile.missing_fields(t.issues())


@query
def project_summary(t):
    return profile.project_summary(tables.load_issues(t.issues(), t.projects()))


@query
def project_summary_large(t):
    return profile.project_summary(t.issues_large())


@query
def top_projects(t):
    return profile.top_projects(t.issues_large(), 5)


@query
def label_counts(t):
    return profile.label_counts(t.issues())


@query
def label_counts_large(t):
    return profile.label_counts(t.issues_large())


@query
def rounded_label_counts(t):
    return profile.rounded_label_counts(t.issues())


@query
def rounded_label_counts_of_project(t):
    return profile.rounded_label_counts_of(tables.load_issues(t.issues(), t.projects()), "NATION_7")


@query
def class_imbalance(t):
    return profile.class_imbalance(t.issues_large())


@query
def clean_label_distribution(t):
    return profile.clean_label_distribution(tickets_of(t))


@query
def priority_counts(t):
    return profile.priority_counts(t.issues())


@query
def described_lengths(t):
    return rounded(profile.describe_lengths(t.issues()))


@query
def length_histogram(t):
    return rounded(profile.length_histogram(t.issues()))


@query
def fractional_label_stats(t):
    return profile.fractional_label_stats(t.issues())


@query
def profile_report(t):
    return rounded(export.profile_report(tables.load_issues(t.issues(), t.projects())))


# --- sampling --------------------------------------------------------------------------------------
@query
def balanced_sample(t):
    return sampling.balanced_sample(tables.load_issues_for_export(t.issues(), t.projects()), 0.2)


@query
def balanced_sample_with_zero(t):
    source = tables.load_issues_for_export(t.issues(), t.projects(), include_zero=True)
    return sampling.balanced_sample(source, 0.2, include_zero=True)


@query
def balanced_sample_large(t):
    issues = t.issues_large().select(*LARGE_KEY, "Story_Point")
    cls = fs.sample_class(F.col("Story_Point"), False)
    return sampling.take_per_class(issues, cls, sampling.EvenShare(0.2), LARGE_KEY)


@query
def stratified_sample(t):
    return sampling.stratified_sample(tickets_of(t), 10).select("issue_key", "actual_story_points")


@query
def corpus_and_holdout(t):
    pool = cleaning.eligible_pool(tickets_of(t))
    return sampling.mark_split(pool, 0.8).select("issue_key", "actual_story_points", "side")


@query
def split_through_files(t):
    """Both sides written as CSV and read back: how many tickets each holds, and whether its files are in key order."""
    folder = scratch(t.spark, "split")
    counted = []
    for side, path in zip(("corpus", "holdout"), export.write_split(export.split(t.issues(), t.projects()), folder)):
        rows = files.read_csv(t.spark, path, schemas.TICKETS).select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
        before = F.lag("issue_key").over(Window.partitionBy("file").orderBy("place"))
        ordered = rows.withColumn("_ordered", F.coalesce(before <= F.col("issue_key"), F.lit(True)))
        counted.append(ordered.groupBy("actual_story_points").agg(F.count(F.lit(1)).alias("n"), F.bool_and("_ordered").alias("ordered"))
                       .withColumn("side", F.lit(side)))
    return counted[0].unionByName(counted[1])


@query
def split_overlap(t):
    marked = export.split(t.issues(), t.projects())
    corpus, holdout = marked.filter("side = 'corpus'"), marked.filter("side = 'holdout'")
    return corpus.join(holdout, "issue_key", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


@query
def first_tickets(t):
    return sampling.first_rows(t.tickets(), 25).select("issue_key", "project")


@query
def export_distributions(t):
    return export.distributions(export.export_sets(t.issues(), t.projects()))


# --- text, scale and JSON expressions ---------------------------------------------------------------
@query
def cleaned_texts(t):
    c = F.col
    return t.issues().select(
        "ID", ft.strip(c("Description_Text")).alias("stripped"), ft.unquote(c("Title")).alias("title"),
        ft.pick_description(c("Description_Text"), c("Description")).alias("description"),
        ft.key_or_default(c("Issue_Key"), c("ID"), "GEN-").alias("key"), ft.is_blank(c("Priority")).alias("no_priority"),
    )


@query
def scale_values(t):
    p = F.col("Story_Point")
    return t.issues().select(
        "ID", fs.snap_to_scale(p).alias("snapped"), fs.export_label(p).alias("label"),
        fs.sample_class(p, True).alias("class_zero"), fs.sample_class(p, False).alias("class"),
        fs.round_points(p).alias("rounded"), fs.points_label(p).alias("shown"), fs.is_on_scale(p).alias("on_scale"),
    )


@query
def on_scale_lines(t):
    lines = t.issues_large()
    return lines.filter(fs.is_on_scale(F.col("Story_Point"))).groupBy("Story_Point").agg(F.count(F.lit(1)).alias("n"))


@query
def confidence_labels(t):
    return t.estimates().groupBy(fs.confidence_label(F.col("rag_confidence")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def shortened_texts(t):
    return t.table("documents").select(
        "doc_id", ft.one_line(F.col("text")).alias("one_line"), ft.leading_snippet(F.col("text")).alias("snippet"),
        ft.word_count(F.col("text")).alias("words"),
    )


@query
def mentioned_keys(t):
    keys = ft.issue_keys_in(F.expr(MENTIONS))
    return t.table("documents").select("doc_id", F.array_join(F.array_sort(keys), ",").alias("keys"))


@query
def embedding_texts(t):
    sub = t.view(SUBMISSIONS)
    c = F.col
    return sub.select(
        "doc_id", F.md5(ft.embedding_text(c("title"), c("description"), True)).alias("with_title"),
        F.md5(ft.embedding_text(c("title"), c("description"))).alias("plain"),
    )


@query
def neighbour_json(t):
    return t.results_rag().select("issue_key", "similar_tickets_json")


@query
def neighbour_lines(t):
    items = fn.parse_neighbours(F.col("similar_tickets_json"))
    return t.results_rag().select(
        "issue_key", fn.neighbour_line(items).alias("line"),
        F.round(fn.same_stem_share(F.col("issue_key"), items), 6).alias("same_stem"), ft.key_stem(F.col("issue_key")).alias("stem"),
    )


@query
def odd_neighbour_json(t):
    """Neighbour lists with numbers as texts, fractions, odd entries and text after the list."""
    items = fn.parse_neighbours(F.col("raw"))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    texts = F.transform(items, lambda x: F.concat_ws(":", shown(x["issue_key"]), shown(x["story_points"]), shown(x["similarity"])))
    return t.view(NEIGHBOUR_TEXTS).select("doc_id", F.array_join(texts, "|").alias("items"))


@query
def neighbour_examples(t):
    found = nn.nearest(t.queries(), t.vectors(), 10, fetch=("title", "description"))
    lists = nn.as_lists(found, evaluate.NEIGHBOUR_COLUMNS)
    return lists.select("query_key", F.md5(fn.neighbour_examples(F.col("similar_tickets"))).alias("block"))


@query
def repaired_replies(t):
    return t.view(REPLIES).select("doc_id", fr.repair_json(F.col("raw")).alias("repaired"))


@query
def reply_objects(t):
    parsed = t.view(REPLIES).withColumn("p", fr.json_object(F.col("raw")))
    p = F.col("p")
    parts = F.col("parts")
    return parsed.withColumn("parts", fr.subtasks_of(p)).select(
        "doc_id", p.isNotNull().alias("found"), fr.number_field(p, "story_points").alias("points"),
        fr.number_field(p, "confidence").alias("confidence"), fr.text_field(p, "reasoning").alias("reasoning"),
        fr.flag_field(p, "complex").alias("complex"),
        F.array_join(F.transform(parts, lambda s: F.concat_ws(":", s["title"], s["story_points"].cast("string"), s["reasoning"])), "|").alias("parts"),
    )


@query
def reply_labels(t):
    return t.view(LABEL_REPLIES).select("doc_id", fr.label_of(F.col("raw")).alias("label"))


@query
def point_claims(t):
    return t.results_rag().select(
        "issue_key", fr.claimed_points(F.col("reasoning")).alias("claimed"),
        fr.agrees_with_points(F.col("reasoning"), F.col("predicted_story_points")).alias("agrees"),
    )


@query
def prompt_texts(t):
    asked = evaluate.with_prompts(evaluate.route_tickets(t.tickets(), None))
    return asked.select("issue_key", "user_prompt")


# --- estimation ------------------------------------------------------------------------------------
@query
def keyword_estimates(t):
    return t.results_norag().select(
        "issue_key", "predicted_story_points", "confidence", "complex_flag", "reasoning", "subtask_count",
        "subtask_points_sum", "subtask_titles",
    )


@query
def merged_replies(t):
    """Replies joined to the neighbour estimates of the same key; documents without one take the other route."""
    replied = t.view(REPLIES).withColumn("query_key", vector_key(F.col("doc_id")))
    joined = replied.join(t.estimates(), "query_key", "left").withColumnsRenamed({"raw": "reply"})
    made = estimate.merge_replies(joined.withColumn("error", F.lit(None).cast("string")), "m")
    return made.select(
        "doc_id", "error", "story_points", F.round("confidence", 6).alias("confidence"), "reasoning",
        "complex", "source", "no_rag_fallback", F.round("rag_raw_average", 1).alias("rag_raw_average"), F.when(F.col("subtasks").isNotNull(), F.size("subtasks")).alias("n_subtasks"),
    )


@query
def generated_replies(t):
    asked = evaluate.with_prompts(evaluate.route_tickets(t.tickets(), None))
    made = generate.generate_replies(asked, scripted_generator, batch_size=32)
    return made.select("issue_key", "reply", "attempts", "error")


def _run_columns(made: DataFrame) -> DataFrame:
    return made.select(
        "issue_key", "actual_story_points", "predicted_story_points", F.round("confidence", 6).alias("confidence"), "complex_flag",
        "subtask_count", "subtask_points_sum", "subtask_titles", "reasoning", "source", "no_rag_fallback",
        F.col("error").isNotNull().alias("failed"),
    )


@query
def estimate_run_without_retrieval(t):
    return _run_columns(evaluate.run_estimates(t.tickets(), None, None, scripted_generator, "m", use_rag=False))


@query
def estimate_run_from_a_log(t):
    """All tickets estimated after a run over some of them: the replies of that run are taken from its log."""
    log = scratch(t.spark, "replies")
    run = lambda tickets: evaluate.run_estimates(
        tickets, None, None, scripted_generator, "m", use_rag=False, log=log, task_rows=1 << 14)
    run(t.tickets().filter("doc_id % 2 = 0"))
    return _run_columns(run(t.tickets()))


@query
def estimate_run_outcome(t):
    return estimate.run_outcome(evaluate.run_estimates(t.tickets(), None, None, scripted_generator, "m", use_rag=False))


@query
def failed_estimates(t):
    made = evaluate.run_estimates(t.tickets(), None, None, scripted_generator, "m", use_rag=False)
    return estimate.failures(made)


@query
def estimate_run_with_retrieval(t):
    """All tickets estimated against the letter vectors of all documents, written and read back."""
    path = scratch(t.spark, "results")
    made = evaluate.run_estimates(t.tickets(), letter_vectors(t), LETTERS, scripted_generator, "m", k=5)
    files.write_results(made, path)
    return files.read_results(t.spark, path).select(
        "issue_key", "actual_story_points", "rag_story_points", F.round("rag_raw_average", 1).alias("rag_raw_average"), "rag_confidence",
        "no_rag_fallback", F.size(fn.parse_neighbours(F.col("similar_tickets_json"))).alias("n_neighbours"),
    )


@query
def labelled_subtasks(t):
    made = generate.label_subtasks(review.subtask_sheet(t.results_norag()), scripted_labeller, batch_size=64)
    return made.select("issue_key", "subtask_title", "label")


# --- scores ----------------------------------------------------------------------------------------
@query
def off_scale_predictions(t):
    raw = t.issues().select(F.col("ID").cast("string").alias("issue_key"), F.col("Story_Point").cast("int").alias("predicted_story_points"))
    return metrics.off_scale(raw)


@query
def error_metrics(t):
    return rounded(metrics.error_metrics(t.results_rag()))


@query
def error_metrics_large(t):
    return rounded(metrics.error_metrics(t.results_large()))


@query
def rank_correlation_large(t):
    return rounded(metrics.rank_correlation(t.results_large()).select("n", "spearman_rho"))


@query
def average_ranks(t):
    return metrics.average_ranks(metrics.point_pairs(t.results_large()), "actual")


@query
def worst_misses(t):
    return metrics.worst_misses(t.results_norag(), 10)


@query
def paired_errors(t):
    return metrics.paired_errors(t.results_rag(), t.results_norag()).withColumn("n_pairs", F.col("n_pairs").cast("long"))


@query
def paired_comparison(t):
    return rounded(metrics.paired_comparison(t.results_rag(), t.results_norag()))


@query
def paired_comparison_repeated_keys(t):
    """Order lines compared with themselves shifted by one: every order's lines pair with each other."""
    large = t.results_large()
    other = large.withColumn("predicted_story_points", F.col("predicted_story_points") + 1)
    return rounded(metrics.paired_comparison(large, other))


@query
def retrieval_stats(t):
    return rounded(metrics.retrieval_stats(t.results_rag()))


@query
def confidence_band_errors(t):
    return rounded(metrics.confidence_band_errors(t.results_rag()))


@query
def confusion_counts(t):
    return metrics.confusion_counts(t.results_norag())


@query
def precision_recall_f1(t):
    return rounded(metrics.precision_recall_f1(metrics.confusion_counts(t.results_norag())))


@query
def reconciliation_gaps(t):
    return metrics.reconciliation_gaps(t.results_norag())


@query
def mean_reconciliation_gap(t):
    return rounded(metrics.mean_reconciliation_gap(t.results_norag()))


@query
def ablation_report(t):
    rag, norag = written(t, t.results_rag(), "rag"), written(t, t.results_norag(), "norag")
    return rounded(evaluate.ablation_report(rag, norag))


@query
def kept_ablation_report(t):
    """The report over both runs from a state that their results were added to in three parts."""
    rag, norag = written(t, t.results_rag(), "rag"), written(t, t.results_norag(), "norag")
    state = scratch(t.spark, "scores")
    some, rest = F.col("vec_id") % 3 == 0, F.col("doc_id") % 4 == 0
    scores.add_results(t.spark, state, rag.filter(some), norag.filter(rest))
    scores.add_results(t.spark, state, rag.filter(~some))
    scores.add_results(t.spark, state, None, norag.filter(~rest))
    return rounded(scores.kept_report(t.spark, state))


# --- reviews ---------------------------------------------------------------------------------------
@query
def justification_sheet(t):
    return review.justification_sheet(t.results_rag()).select(
        "issue_key", "ticket_title", "ticket_description_snippet", "predicted_story_points", "reasoning", "neighbour_keys",
        *schemas.RUBRIC_COLUMNS,
    )


@query
def reviewed_justifications(t):
    """The justification sheet through CSV: written, filled in by formula, written, read and scored."""
    folder = scratch(t.spark, "review")
    names = schemas.JUSTIFICATION_REVIEW.fieldNames()
    files.write_csv(review.justification_sheet(t.results_rag()).select(*names), f"{folder}/blank")
    blank = files.read_csv(t.spark, f"{folder}/blank", schemas.JUSTIFICATION_REVIEW)
    number = F.split("issue_key", "-")[1].cast("long")
    mark = lambda i: F.when(number % (11 + i) == 0, F.lit(None)).when(number % (i + 2) == 0, F.lit("1")).otherwise(F.lit("0.0"))
    filled = blank.withColumns({c: mark(i).cast("string") for i, c in enumerate(schemas.RUBRIC_COLUMNS)})
    files.write_csv(filled, f"{folder}/filled")
    return rounded(review.rubric_rates(files.read_csv(t.spark, f"{folder}/filled", schemas.JUSTIFICATION_REVIEW)))


@query
def reviewed_subtasks(t):
    """The subtask sheet through CSV: written, labelled, written, read and scored."""
    folder = scratch(t.spark, "review")
    names = schemas.HALLUCINATION_REVIEW.fieldNames()
    files.write_csv(review.subtask_sheet(t.results_norag()).select(*names), f"{folder}/blank")
    blank = files.read_csv(t.spark, f"{folder}/blank", schemas.HALLUCINATION_REVIEW)
    files.write_csv(generate.label_subtasks(blank, scripted_labeller, batch_size=64), f"{folder}/labelled")
    sheet = files.read_csv(t.spark, f"{folder}/labelled", schemas.HALLUCINATION_REVIEW)
    return rounded(review.label_rates(sheet))


@query
def citation_checks(t):
    return review.citation_checks(review.justification_sheet(t.results_rag())).select(
        "issue_key", "consistent", "has_neighbours", "cites_neighbour",
        F.array_join(F.array_sort("cited"), ",").alias("cited"), F.array_join("invented", ",").alias("invented"),
    )


@query
def automatic_checks(t):
    return rounded(review.automatic_checks(review.justification_sheet(t.results_rag())))


@query
def fully_labelled_sheets(t):
    return review.fully_labelled(t.view(RUBRIC_SHEET)).select("issue_key", *schemas.RUBRIC_COLUMNS)


@query
def rubric_rates(t):
    return rounded(review.rubric_rates(t.view(RUBRIC_SHEET)))


@query
def subtask_sheet(t):
    return review.subtask_sheet(t.results_norag()).select("issue_key", "ticket_title", "subtask_title", "subtask_reasoning", "label")


def _labelled(t: Tables) -> DataFrame:
    replies = t.view(LABEL_REPLIES)
    return replies.select(
        F.concat(F.lit("T-"), F.floor(F.col("doc_id") / 4).cast("string")).alias("issue_key"), fr.label_of(F.col("raw")).alias("label")
    )


@query
def valid_labels(t):
    return review.with_valid_label(_labelled(t)).groupBy("issue_key").agg(F.count(F.lit(1)).alias("n"))


@query
def label_rates(t):
    return rounded(review.label_rates(_labelled(t)))


@query
def hallucination_summary(t):
    return rounded(review.hallucination_summary(_labelled(t)))

