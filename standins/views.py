"""Stand-in views. SQL that both engines read alike is written once; the rest is built by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from standins.harness import name_checkpoint_folder
from storygauge.functions.neighbours import neighbours_json
from storygauge.functions.scale import snap_to_scale
from storygauge.operators.estimate import (
    estimate_from_keywords, estimate_from_neighbours, subtask_columns,
)
from storygauge.operators.neighbours import nearest

MIN_SIMILARITY = 0.35

ISSUES = """
SELECT doc_id AS ID,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '  '
       ELSE upper(source) || '-' || CAST(doc_id AS STRING) END AS Issue_Key,
  doc_id % 30 AS Project_ID,
  CASE WHEN doc_id % 37 = 0 THEN NULL ELSE lang END AS Type,
  CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 43 = 0 THEN chr(9)
       ELSE repeat('"', CAST(doc_id % 3 AS INT)) || split_part(text, chr(10), 1) || repeat('"', CAST(doc_id % 4 AS INT)) END AS Title,
  text AS Description,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '" "' WHEN doc_id % 31 = 0 THEN chr(10) || ' '
       ELSE text END AS Description_Text,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'Low' WHEN doc_id % 5 = 2 THEN 'Medium'
       WHEN doc_id % 10 = 3 THEN ' ' ELSE 'High' END AS Priority,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN CAST(-1 AS DOUBLE)
       WHEN doc_id % 29 = 0 THEN CAST(101 AS DOUBLE) ELSE CAST(n_chars % 90 AS DOUBLE) / 4 END AS Story_Point
FROM {documents}
"""
PROJECTS = """
SELECT CAST(n_nationkey AS BIGINT) AS ID,
  CASE WHEN n_nationkey = 3 THEN NULL WHEN n_nationkey = 4 THEN 'Unknown' WHEN n_nationkey = 6 THEN ' '
       ELSE n_name END AS Name
FROM {nation}
"""
ISSUES_LARGE = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS Story_Point, o_orderpriority AS Priority,
  n_name AS Project_Name, p_name AS Title, p_type AS Description_Text
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} ON c_nationkey = n_nationkey LEFT JOIN {part} ON l_partkey = p_partkey
"""
RESULTS_LARGE = """
SELECT 'ORD-' || CAST(l_orderkey AS STRING) AS issue_key,
  CAST(floor(l_quantity) AS INT) % 22 AS actual_story_points,
  CAST(floor(l_extendedprice) AS INT) % 22 AS predicted_story_points
FROM {lineitem}
"""
VECTORS = """
SELECT 'V' || CAST(vec_id % 4 AS STRING) || '-' || CAST(vec_id AS STRING) AS issue_key, split_part(text, chr(10), 1) AS title,
  coalesce(text, '') AS description,
  CASE label WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 WHEN 5 THEN 8 WHEN 6 THEN 13
       ELSE 21 END AS story_points,
  embedding, CASE WHEN label = 9 THEN 'alt-64' ELSE 'unit-64' END AS embedding_model, vec_id
FROM {embeddings} LEFT JOIN {documents} ON doc_id = vec_id
"""
REWRITES = """
SELECT 'V' || CAST(conv_id % 4 AS STRING) || '-' || CAST(conv_id AS STRING) AS issue_key, role AS title, text AS description,
  CAST(length(text) % 9 AS INT) AS story_points, CAST(NULL AS {float_array}) AS embedding,
  'unit-64' AS embedding_model, turn
FROM {conversations}
"""
BACKLOG = """
SELECT CASE WHEN n_nationkey % 5 = 4 THEN 'OTHER-' || CAST(n_nationkey * 100 AS STRING)
            ELSE 'TKT-' || lpad(CAST(n_nationkey AS STRING), 3, '0') END AS issue_key,
  n_name AS project, 'Task' AS issue_type, n_name AS title, 'Region ' || CAST(n_regionkey AS STRING) AS description
FROM {nation}
"""
SUBMISSIONS = """
SELECT doc_id, CASE WHEN doc_id % 12 = 5 THEN ' ' ELSE ' ' || source || ' ' END AS project, lang AS issue_type,
  CASE WHEN doc_id % 9 = 2 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
  CASE WHEN doc_id % 20 = 7 THEN chr(9) ELSE text || chr(10) END AS description
FROM {documents}
"""
# Titles open with words the keyword estimator knows.
TICKET_TITLE = """
CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'Rewrite ' WHEN 1 THEN 'Fix ' WHEN 2 THEN 'Implement ' WHEN 3 THEN 'Migrate and add '
  WHEN 4 THEN 'Framework: ' ELSE '' END || split_part(text, chr(10), 1)
"""
# Every document mentions two keys, one of them of another project.
MENTIONS = """
text || ' See ' || upper(source) || '-' || CAST(doc_id AS STRING) || ', X' || CAST(doc_id % 3 AS STRING) || '-' ||
CAST(doc_id % 7 AS STRING) || ' and ' || upper(source) || '-' || CAST(doc_id AS STRING) || '; not ' || lang || '-1.'
"""
# A reply per document: plain, fenced, with slips to repair, two objects, an array, cut off, without JSON; points that are
# a word, null or too large, a confidence and subtask points that are no number, braces before the object, a key twice.
REPLIES = """
SELECT doc_id, CAST(doc_id % 17 AS INT) AS form,
  CASE doc_id % 17
    WHEN 0 THEN body WHEN 1 THEN 'Sure:' || chr(10) || fence || 'json' || chr(10) || body || chr(10) || fence
    WHEN 2 THEN replace(body, '}}', ',}}') WHEN 3 THEN replace(body, '"', chr(39))
    WHEN 4 THEN 'Estimate ' || body || ' and {{"more": 1}}' WHEN 5 THEN '[' || body || ']'
    WHEN 6 THEN replace(body, 'true', 'True') WHEN 7 THEN replace(body, '}}', '')
    WHEN 8 THEN source WHEN 9 THEN replace(body, 'small', 'braces }} and {{ inside') WHEN 15 THEN 'Draft {{x}} final ' || body
    WHEN 16 THEN replace(body, ', "complex"', ', "story_points": 5, "complex"') ELSE body END AS raw
FROM (SELECT doc_id, source, repeat(chr(96), 3) AS fence,
        '{{"story_points": ' || CASE doc_id % 17 WHEN 10 THEN '"five"' WHEN 11 THEN 'null' WHEN 12 THEN '3000000000'
          ELSE CAST(n_chars % 25 AS STRING) END || ', "confidence": ' ||
        CASE WHEN doc_id % 17 = 13 THEN 'NaN' ELSE '0.' || CAST(n_chars % 9 + 1 AS STRING) END ||
        ', "reasoning": " Looks small for ' || source || ' ", "complex": true, "subtasks": [{{"title": " part ' ||
        CAST(doc_id AS STRING) || ' ", "story_points": ' || CASE WHEN doc_id % 17 = 14 THEN '"n/a"' ELSE CAST(doc_id % 6 AS STRING) END ||
        '}}, 7, {{"reasoning": "rest"}}]}}' AS body
      FROM {documents}) AS t
"""
# Neighbour lists as texts, some with numbers as texts, some no list.
NEIGHBOUR_TEXTS = """
SELECT doc_id, CASE doc_id % 7
    WHEN 0 THEN '[{{"story_points": ' || CAST(doc_id % 9 AS STRING) || '.5, "similarity": "0.5"}}]'
    WHEN 1 THEN ' [{{"issue_key": "K-' || CAST(doc_id AS STRING) || '", "story_points": "5", "similarity": "0.75"}}] '
    WHEN 2 THEN '[1, {{"issue_key": "K", "story_points": "5.5", "similarity": "high"}}, null, {{"issue_key": 7, "story_points": 2.0}}]'
    WHEN 3 THEN '[{{"issue_key": "K"}}] and more' WHEN 4 THEN '{{"issue_key": "K"}}' WHEN 5 THEN '[{{"issue_key": "K"}}'
    ELSE '[{{"issue_key": "é", "story_points": null, "similarity": 1}}]' END AS raw
FROM {documents}
"""
LABEL_REPLIES = """
SELECT doc_id,
  CASE doc_id % 6 WHEN 0 THEN '{{"label": "grounded"}}' WHEN 1 THEN 'I say {{"label": " Inferred ", "why": "' || source || '",}}'
    WHEN 2 THEN '{{"label": "HALLUCINATED"}}' WHEN 3 THEN '{{"label": "maybe"}}' WHEN 4 THEN '{{"why": "x"}}' ELSE 'none' END AS raw
FROM {documents}
"""
RUBRIC_SHEET = """
SELECT 'DOC-' || CAST(d.doc_id AS STRING) AS issue_key,
  CASE WHEN quality IS NULL THEN '' ELSE CAST(quality AS STRING) END AS grounded,
  CASE WHEN toxic IS NULL THEN '' ELSE CAST(toxic AS STRING) || '.0' END AS faithful_to_rag,
  CASE WHEN d.doc_id % 3 = 0 THEN ' 1 ' ELSE '0' END AS comparative,
  CASE WHEN d.doc_id % 8 = 3 THEN 'yes' WHEN d.doc_id % 8 = 4 THEN NULL ELSE '1' END AS no_hallucination,
  CASE WHEN n_chars % 2 = 0 THEN '1' ELSE '0' END AS useful
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
# Reasoning texts: cite the first neighbour, sometimes an unknown key, sometimes other points.
REASONING = """
'Like ' || {first} || CASE WHEN {id} % 7 = 0 THEN ' and ZZ9-1' ELSE '' END ||
CASE WHEN {id} % 9 = 0 THEN '; estimated at 4' WHEN {id} % 5 = 0 THEN '; a close match'
     ELSE '; Story points: ' || CAST({points} AS STRING) END
"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def vector_key(number: Column) -> Column:
    """Key of a vector, in one of four projects."""
    return F.concat(F.lit("V"), (number % 4).cast("string"), F.lit("-"), number.cast("string"))


class Tables:
    """The tables of one scale-factor directory and the views on them."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = name_checkpoint_folder(spark), directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def view(self, sql: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in sql}
        return self.spark.sql(sql.replace("{float_array}", "array<float>"), **used)

    # --- issues and tickets
    def issues(self) -> DataFrame:
        return self.view(ISSUES)

    def projects(self) -> DataFrame:
        return self.view(PROJECTS)

    def issues_large(self) -> DataFrame:
        return self.view(ISSUES_LARGE)

    # --- vectors
    def vectors(self) -> DataFrame:
        return self.view(VECTORS)

    def queries(self) -> DataFrame:
        """Every vector, mixed with the following one; the share of the other goes by the id."""
        v = self.table("embeddings")
        nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
        share = (F.col("vec_id") % 4) / F.lit(2.0)
        mixed = F.zip_with("embedding", "next", lambda a, b: a.cast("double") + share * b.cast("double"))
        return v.join(nxt, "vec_id", "left").select(
            vector_key(F.col("vec_id")).alias("query_key"),
            F.coalesce(mixed, F.col("embedding").cast("array<double>")).alias("query_vector"),
        )

    def neighbours(self) -> DataFrame:
        return nearest(self.queries(), self.vectors(), 10)

    def estimates(self) -> DataFrame:
        return estimate_from_neighbours(self.neighbours(), MIN_SIMILARITY)

    def results_rag(self) -> DataFrame:
        """Results of a run with retrieval: the neighbour estimate of every query, explained by formula."""
        neighbours = self.neighbours().withColumn("title", F.concat(F.lit("T "), "issue_key"))
        listed = ("issue_key", "story_points", "similarity", "title")
        estimates = estimate_from_neighbours(neighbours, MIN_SIMILARITY, listed)
        own = self.vectors().select(
            F.col("issue_key").alias("query_key"), "vec_id", F.col("story_points").alias("actual_story_points"),
            F.coalesce("title", F.lit("")).alias("title"), "description",
        )
        joined = own.join(estimates, "query_key")
        reasoning = F.expr(REASONING.format(first="similar_tickets[0].issue_key", id="vec_id", points="rag_story_points"))
        return joined.select(
            F.col("query_key").alias("issue_key"), "vec_id", "title", "description", "actual_story_points",
            F.col("rag_story_points").alias("predicted_story_points"),
            (F.col("rag_story_points") >= 13).alias("complex_flag"),
            reasoning.alias("reasoning"), "rag_confidence",
            # some rows without neighbours: an empty list, nothing, and JSON that is no list
            F.when(F.col("vec_id") % 13 == 0, F.lit("[]"))
            .when(F.col("vec_id") % 13 == 2, F.lit('{"issue_key":"X-1"}'))
            .when(F.col("vec_id") % 13 > 2, neighbours_json(F.col("similar_tickets"))).alias("similar_tickets_json"),
        )

    def tickets(self) -> DataFrame:
        """Every document as a ticket with its label."""
        return self.table("documents").select(
            vector_key(F.col("doc_id")).alias("issue_key"),
            "doc_id",
            F.col("source").alias("project"), F.col("lang").alias("issue_type"),
            F.expr(TICKET_TITLE).alias("title"), F.col("text").alias("description"),
            F.when(F.col("n_chars") % 90 == 0, 0).otherwise(snap_to_scale((F.col("n_chars") % 90).cast("double") / 4))
            .alias("actual_story_points"),
        )

    def results_norag(self) -> DataFrame:
        """Results of a run without retrieval: the keyword estimate of every document."""
        made = estimate_from_keywords(self.tickets())
        return made.withColumns(subtask_columns(F.col("subtasks"))).select(
            "issue_key", "doc_id", "title", "description", "actual_story_points",
            F.col("story_points").alias("predicted_story_points"), "confidence",
            F.col("complex").alias("complex_flag"), "subtask_count", "subtask_points_sum", "subtask_titles",
            "subtasks_json", "reasoning", "source",
        )

    def results_large(self) -> DataFrame:
        return self.view(RESULTS_LARGE)
