"""The same queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

import string

from standins import views

ORACLES: dict[str, str] = {}

# --- fixed values, written out here so that a wrong one in the library shows ------------------------
SCALE = (1, 2, 3, 5, 8, 13, 21)
HALLUCINATION_LABELS = ('grounded', 'inferred', 'hallucinated')
RUBRIC_COLUMNS = ('grounded', 'faithful_to_rag', 'comparative', 'no_hallucination', 'useful')
NO_RETRIEVAL_WARNING = 'No similar tickets found in the vector store; estimate is based on ticket details only.'
LARGE_WORDS = ('rewrite', 'migrate', 'real-time', 'collaborative', 'redesign', 'architecture', 'platform', 'framework', 'overhaul')
MEDIUM_WORDS = ('implement', 'add', 'integrate', 'support', 'module', 'feature', 'api')
SMALL_WORDS = ('fix', 'typo', 'rename', 'update text', 'log', 'tweak')
STANDARD_SUBTASKS = (('Design and spike', 3, 'Investigate approach and risks.'), ('Core implementation', 8, 'Build the primary functionality.'), ('Tests and rollout', 3, 'Cover edge cases and ship safely.'))
WHITESPACE = "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE_CLASS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
ISSUE_KEY_PATTERN = r"\b([A-Z][A-Z0-9]+-\d+)\b"
POINT_CLAIM = r"(?i)(?:story\s*points?|estimate(?:d)?(?:\s+at)?)\s*[:=]?\s*(\d+)"
# ----------------------------------------------------------------------------------------------------


def view(sql: str) -> str:
    return sql.format(float_array="FLOAT[]", **{t: t for t in views.TABLES})


# --- expressions -----------------------------------------------------------------------------------
def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), '{WHITESPACE}')"


def unquote(x: str) -> str:
    t = strip(x)
    runs = f"""CAST(length(regexp_extract({t}, '^("|{WHITESPACE_CLASS})*')) AS BIGINT)"""
    peel = f"""CASE WHEN length(acc) >= 2 AND starts_with(acc, '"') AND ends_with(acc, '"')
               THEN trim(substr(acc, 2, length(acc) - 2), '{WHITESPACE}') ELSE acc END"""
    return f"list_reduce(list_prepend({t}, list_transform(range({runs}), lambda i: '')), lambda acc, x: {peel})"


def described(plain: str, markup: str) -> str:
    return f"CASE WHEN {strip(plain)} <> '' THEN {unquote(plain)} ELSE {unquote(markup)} END"


def snap(x: str) -> str:
    steps = " ".join(f"WHEN {x} <= {s} THEN {s}" for s in SCALE)
    return f"CASE WHEN {x} IS NULL THEN NULL {steps} ELSE {SCALE[-1]} END"


def label(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE {snap(x)} END"


def exact(x: str, places: int) -> str:
    return f"CAST(printf('%.{places}f', {x}) AS DOUBLE)"


def one_decimal(x: str) -> str:
    return f"round_even(({x}) * 10, 0) / 10"


def words(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN 0 ELSE CAST(len(regexp_split_to_array({strip(x)}, '{WHITESPACE_CLASS}+')) AS INTEGER) END"


def shown(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'Missing' WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def keys_in(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({x}, ''), '{ISSUE_KEY_PATTERN}', 1), lambda k: upper(k)))"


def hashed(seed: int, *columns: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns) + f", '{seed}'))"


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} END"


def key(number: str) -> str:
    return f"'V' || {number} % 4 || '-' || {number}"


# --- tables that several queries start from -----------------------------------------------------------
ISSUES = f"issues AS ({view(views.ISSUES)})"
PROJECTS = f"projects AS ({view(views.PROJECTS)})"
LARGE = f"large AS ({view(views.ISSUES_LARGE)})"
RESULTS_LARGE = f"results_large AS ({view(views.RESULTS_LARGE)})"
NAMED = f"{ISSUES}, {PROJECTS}, named AS (SELECT i.*, p.Name AS Project_Name FROM issues i LEFT JOIN projects p ON i.Project_ID = p.ID)"
EXPORT = "SELECT ID, Issue_Key, Project_Name, Type, Title, Description, Description_Text, Story_Point FROM named WHERE Story_Point BETWEEN 0 AND 100"
POOL = f"{NAMED}, with_zero AS ({EXPORT}), positive AS ({EXPORT} AND Story_Point > 0)"


def tickets_from(source: str, prefix: str = "ISSUE-") -> str:
    return f"""SELECT CASE WHEN {strip('Issue_Key')} <> '' THEN Issue_Key ELSE '{prefix}' || ID END AS issue_key,
      CASE WHEN {strip('Project_Name')} <> '' THEN Project_Name ELSE 'Unknown' END AS project,
      coalesce(Type, '') AS issue_type, {unquote('Title')} AS title,
      {described('Description_Text', 'Description')} AS description, {label('Story_Point')} AS actual_story_points
    FROM {source} WHERE Story_Point >= 0"""


CLEAN = f"{POOL}, clean AS ({tickets_from('with_zero')})"
ELIGIBLE = f"""{CLEAN}, eligible AS (SELECT issue_key, project, issue_type, title, {strip('description')} AS description,
  actual_story_points FROM clean WHERE {strip('description')} <> '')"""
VECTORS = f"vectors AS ({view(views.VECTORS)})"
QUERY_VECTORS = f"""queries AS (SELECT {key('q.vec_id')} AS query_key,
  CASE WHEN n.embedding IS NULL THEN CAST(q.embedding AS DOUBLE[])
       ELSE list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[])),
                           lambda z: z[1] + (q.vec_id % 4) / CAST(2 AS DOUBLE) * z[2]) END AS query_vector
  FROM embeddings q LEFT JOIN embeddings n ON n.vec_id = q.vec_id + 1)"""


def nearest(queries: str, corpus: str, k: int, columns: str = "story_points") -> str:
    return f"""SELECT * EXCLUDE raw, {exact('raw', 4)} AS similarity FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_key ORDER BY raw DESC, issue_key) AS INTEGER) AS rank FROM (
        SELECT q.query_key, c.issue_key, {columns},
          round(list_cosine_similarity(q.query_vector, CAST(c.embedding AS DOUBLE[])), 12) AS raw
        FROM {queries} q, {corpus} c)) WHERE rank <= {k}"""


NEIGHBOURS = f"{VECTORS}, {QUERY_VECTORS}, neighbours AS ({nearest('queries', 'vectors', 10)})"
CLOSE = f"""{NEIGHBOURS}, close AS (SELECT * EXCLUDE any_close FROM (
  SELECT *, max(similarity >= {views.MIN_SIMILARITY}) OVER (PARTITION BY query_key) AS any_close FROM neighbours)
  WHERE similarity >= {views.MIN_SIMILARITY} OR NOT any_close)"""


def estimated(close: str, neighbours: str) -> str:
    confidence = (
        "greatest(CAST(0.3 AS DOUBLE), least(CAST(0.9 AS DOUBLE), CAST(0.3 AS DOUBLE) + "
        "least(max(similarity) / CAST(0.85 AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(0.6 AS DOUBLE) - "
        "least((max(story_points) - min(story_points)) / CAST(13 AS DOUBLE), CAST(0.5 AS DOUBLE))))"
    )
    return f"""SELECT query_key, n_neighbours, {snap('round(raw, 9)')} AS rag_story_points, raw AS rag_raw_average, rag_confidence
    FROM (SELECT query_key, CASE WHEN sum(similarity) > 0 THEN sum(CAST(story_points AS DOUBLE) * similarity) / sum(similarity)
            ELSE CAST(min_by(story_points, rank) AS DOUBLE) END AS raw, {exact(confidence, 2)} AS rag_confidence
          FROM {close} GROUP BY query_key)
    JOIN (SELECT query_key, count(*) AS n_neighbours FROM {neighbours} GROUP BY query_key) USING (query_key)"""


ESTIMATES = f"{CLOSE}, estimates AS ({estimated('close', 'neighbours')})"
RAG = f"""{ESTIMATES}, rag AS (
  SELECT issue_key, vec_id, title, description, actual_story_points, predicted_story_points, complex_flag, rag_confidence,
    {views.REASONING.format(first='first_key', id='vec_id', points='predicted_story_points')} AS reasoning
  FROM (SELECT v.issue_key, v.vec_id, coalesce(v.title, '') AS title, v.description, v.story_points AS actual_story_points,
          e.rag_story_points AS predicted_story_points, e.rag_story_points >= 13 AS complex_flag, e.rag_confidence,
          n.issue_key AS first_key
        FROM estimates e JOIN vectors v ON v.issue_key = e.query_key
        JOIN neighbours n ON n.query_key = e.query_key AND n.rank = 1))"""
TICKETS = f"""tickets AS (SELECT {key('doc_id')} AS issue_key, doc_id, source AS project, lang AS issue_type,
  {views.TICKET_TITLE} AS title, text AS description,
  CASE WHEN n_chars % 90 = 0 THEN 0 ELSE {snap('CAST(n_chars % 90 AS DOUBLE) / 4')} END AS actual_story_points FROM documents)"""


def any_of(x: str, keywords: tuple[str, ...], points: int) -> str:
    return f"CASE WHEN {' OR '.join(f'contains({x}, {chr(39)}{w}{chr(39)})' for w in keywords)} THEN {points} ELSE 0 END"


NORAG = f"""{TICKETS}, counted AS (SELECT *, {words('body')} AS n_words FROM (
  SELECT *, lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS body FROM tickets)),
scored AS (SELECT *, greatest(1, least(n_words // 25, 6) + {any_of('body', LARGE_WORDS, 6)} + {any_of('body', MEDIUM_WORDS, 2)}
  - {any_of('body', SMALL_WORDS, 2)}) AS score FROM counted),
norag AS (SELECT issue_key, doc_id, title, description, actual_story_points, {snap('score')} AS predicted_story_points,
  {exact('CAST(0.55 AS DOUBLE) + least(CAST(0.25 AS DOUBLE), n_words / CAST(400 AS DOUBLE))', 2)} AS confidence, {snap('score')} >= 13 AS complex_flag,
  'Heuristic signal: ~' || n_words || ' words in the description, keyword profile suggests a ' || {snap('score')} ||
  '-point scope. Configure an API key for a richer LLM-driven explanation.' AS reasoning,
  CASE WHEN {snap('score')} >= 13 THEN {len(STANDARD_SUBTASKS)} ELSE 0 END AS subtask_count,
  CASE WHEN {snap('score')} >= 13 THEN {sum(p for _, p, _ in STANDARD_SUBTASKS)} ELSE 0 END AS subtask_points_sum,
  CASE WHEN {snap('score')} >= 13 THEN '{' | '.join(t for t, _, _ in STANDARD_SUBTASKS)}' ELSE '' END AS subtask_titles
  FROM scored)"""
LETTER_COUNTS = "[" + ", ".join(
    f"CAST(length({{x}}) - length(replace({{x}}, '{c}', '')) AS DOUBLE)" for c in string.ascii_lowercase
) + "]"


def letters(x: str) -> str:
    return LETTER_COUNTS.replace("{x}", x)


ORACLES["neighbour_estimates"] = f"WITH {ESTIMATES} SELECT * REPLACE (round(rag_raw_average, 6) AS rag_raw_average) FROM estimates"
ORACLES["nearest_tickets"] = f"WITH {NEIGHBOURS} SELECT * FROM neighbours"
ORACLES["nearest_tickets_by_blocks"] = ORACLES["nearest_tickets"]
ORACLES["approximate_tickets_all_cells"] = ORACLES["nearest_tickets"]
ORACLES["nearest_tickets_by_cells"] = ORACLES["nearest_tickets"]
ORACLES["close_neighbours"] = f"WITH {CLOSE} SELECT query_key, issue_key, similarity FROM close"
ORACLES["neighbour_spread"] = f"""WITH {NEIGHBOURS} SELECT query_key, max(similarity) AS top_similarity,
  max(story_points) - min(story_points) AS points_spread FROM neighbours GROUP BY query_key"""
ORACLES["cosine_of_successors"] = """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
  CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
ORACLES["unit_vectors"] = f"""WITH {QUERY_VECTORS} SELECT query_key, round(len_, 6) AS length, CAST(1 AS DOUBLE) AS unit_length,
  round(query_vector[1] / len_, 6) AS first
  FROM (SELECT *, sqrt(list_inner_product(query_vector, query_vector)) AS len_ FROM queries)"""
ORACLES["vector_quality"] = """SELECT 2 * (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM conversations) AS total,
  (SELECT count(*) FROM conversations) AS missing, (SELECT count(*) FROM embeddings) AS zero, (SELECT count(*) FROM embeddings) AS usable"""
ORACLES["lookup_answers"] = f"""WITH subs AS ({view(views.SUBMISSIONS)}), {TICKETS},
asked AS (SELECT doc_id AS query_key, {strip('description')} AS body FROM subs WHERE {strip('description')} <> ''),
q AS (SELECT query_key, {letters('body')} AS query_vector FROM asked),
c AS (SELECT issue_key, actual_story_points AS story_points, {letters(strip('description'))} AS embedding FROM tickets),
found AS ({nearest("(SELECT * FROM q WHERE list_sum(query_vector) > 0)", "(SELECT * FROM c WHERE list_sum(embedding) > 0)", 3)}),
texts AS (SELECT issue_key, {strip('title')} AS title, {strip('description')} AS description FROM tickets),
lists AS (SELECT query_key, string_agg(issue_key, ',' ORDER BY rank) AS keys, string_agg(CAST(story_points AS VARCHAR), ',' ORDER BY rank) AS points,
  string_agg(printf('%.4f', similarity), ',' ORDER BY rank) AS similarities, string_agg(title || '|' || description, ',' ORDER BY rank) AS texts
  FROM found JOIN texts USING (issue_key) GROUP BY query_key)
SELECT s.doc_id, CASE WHEN {strip('s.description')} = '' THEN '{{"error":"description must not be empty"}}' END AS error,
  {', '.join(f"CASE WHEN {strip('s.description')} <> '' THEN coalesce(l.{c}, '') END AS {c}" for c in ('keys', 'points', 'similarities'))},
  md5(CASE WHEN {strip('s.description')} <> '' THEN coalesce(l.texts, '') END) AS texts
FROM subs s LEFT JOIN lists l ON l.query_key = s.doc_id"""
ORACLES["looked_up_through_an_index"] = ORACLES["lookup_answers"]
ORACLES["looked_up_in_a_kept_store"] = ORACLES["lookup_answers"].replace("FROM tickets)", "FROM kept)").replace(
    "asked AS (", "kept AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN description || ' zzz' ELSE description END AS description) FROM tickets),\nasked AS (", 1)
ORACLES["neighbours_at_most_fifty"] = f"""WITH subs AS ({view(views.SUBMISSIONS)}), {TICKETS}
SELECT md5({strip('description')}) AS query_key, CAST(50 AS BIGINT) AS n, 50 AS last FROM subs
WHERE list_sum({letters(strip('description'))}) > 0 GROUP BY 1"""
ORACLES["tfidf_vectors"] = f"""WITH {TICKETS} SELECT issue_key, 64 AS dimension, CASE WHEN {strip('description')} = '' THEN 0 ELSE 1 END::DOUBLE AS length FROM tickets"""
ORACLES["embedded_texts"] = f"""WITH {TICKETS}, texts AS (SELECT issue_key, CASE WHEN {strip('title')} <> ''
  THEN {strip('title')} || chr(10) || chr(10) || {strip('description')} ELSE {strip('description')} END AS text FROM tickets)
SELECT issue_key, 26 AS dimension, list_sum({letters('text')}) AS letters, CAST(length(text) AS INTEGER) AS chars FROM texts"""

# --- sources, cleaning, joins ----------------------------------------------------------------------
ORACLES["issues_for_profile"] = f"""WITH {NAMED} SELECT Story_Point, Title, Description, Description_Text, Priority, Project_ID,
  Project_Name FROM named"""
ORACLES["issues_for_export"] = f"WITH {POOL} SELECT * FROM positive"
ORACLES["issues_for_export_with_zero"] = f"WITH {POOL} SELECT * FROM with_zero"
ORACLES["clean_tickets"] = f"WITH {CLEAN} SELECT * FROM clean"
ORACLES["eligible_tickets"] = f"WITH {ELIGIBLE} SELECT * FROM eligible"
ORACLES["issues_of_project"] = f"""WITH {LARGE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, Story_Point FROM large
  WHERE Project_Name = 'NATION_7'"""
ORACLES["keyed_issues"] = f"WITH {ISSUES} SELECT ID, Issue_Key FROM issues WHERE {strip('Issue_Key')} <> ''"
VALID = f"({strip('title')} <> '' AND {strip('project')} <> '' AND {strip('description')} <> '')"
ORACLES["checked_submissions"] = f"WITH subs AS ({view(views.SUBMISSIONS)}) SELECT doc_id, {VALID} AS valid FROM subs"
ORACLES["fractional_issues"] = f"WITH {ISSUES} SELECT ID, Story_Point FROM issues WHERE Story_Point <> round_even(Story_Point, 0)"
# An empty CSV cell reads as NULL.
ORACLES["tickets_through_csv"] = f"""WITH {CLEAN} SELECT issue_key, project, nullif(issue_type, '') AS issue_type, nullif(title, '') AS title,
  nullif(description, '') AS description, actual_story_points FROM clean"""
ORACLES["backlog_with_submissions"] = f"""WITH backlog AS ({view(views.BACKLOG)}), subs AS ({view(views.SUBMISSIONS)}),
top AS (SELECT max(TRY_CAST(nullif(regexp_extract(issue_key, '^TKT-(\\d+)$', 1), '') AS BIGINT)) AS highest FROM backlog),
numbered AS (SELECT *, highest + row_number() OVER (ORDER BY doc_id) AS number FROM subs, top WHERE {VALID})
SELECT issue_key, project, issue_type, title, description FROM backlog UNION ALL
SELECT 'TKT-' || CASE WHEN number < 1000 THEN lpad(CAST(number AS VARCHAR), 3, '0') ELSE CAST(number AS VARCHAR) END,
  {strip('project')}, {strip('issue_type')}, {strip('title')}, {strip('description')} FROM numbered"""
REWRITES = f"""{VECTORS}, rewrites AS ({view(views.REWRITES)}), latest AS (
  SELECT * FROM rewrites QUALIFY row_number() OVER (PARTITION BY issue_key, embedding_model ORDER BY turn DESC) = 1)"""
ORACLES["backlog_from_json"] = ORACLES["backlog_with_submissions"]
ORACLES["upserted_vectors"] = f"""WITH {REWRITES}
SELECT issue_key, embedding_model, story_points, description, false AS touched FROM vectors
  WHERE (issue_key, embedding_model) NOT IN (SELECT (issue_key, embedding_model) FROM latest)
UNION ALL SELECT issue_key, embedding_model, story_points, description, true FROM latest"""
ORACLES["upserted_vectors_one_model"] = f"""WITH {REWRITES}, merged AS (
  SELECT embedding_model, story_points FROM vectors WHERE issue_key NOT IN (SELECT issue_key FROM latest)
  UNION ALL SELECT embedding_model, story_points FROM latest)
SELECT embedding_model, count(*) AS n, CAST(sum(story_points) AS BIGINT) AS points FROM merged GROUP BY embedding_model"""
ORACLES["stored_vectors_of_model"] = f"""WITH {VECTORS} SELECT issue_key, story_points, CAST(len(embedding) AS INTEGER) AS dimension
  FROM vectors WHERE embedding_model = 'unit-64'"""
ORACLES["pending_tickets"] = f"""WITH {VECTORS}, {TICKETS} SELECT issue_key, actual_story_points FROM tickets
  WHERE issue_key NOT IN (SELECT issue_key FROM vectors WHERE embedding_model = 'unit-64')"""
ORACLES["ingested_vectors"] = f"""WITH {TICKETS} SELECT issue_key, actual_story_points AS story_points, 'letters-26' AS embedding_model,
  list_sum({letters(strip('description'))}) AS letters, (SELECT count(*) FROM tickets) AS first_run, CAST(0 AS BIGINT) AS second_run
  FROM tickets"""
ORACLES["streamed_upserts"] = f"""WITH {TICKETS} SELECT issue_key, actual_story_points AS story_points, 'letters-26' AS embedding_model,
  list_sum({letters(strip('description'))}) + CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END AS letters FROM tickets"""


# --- profile ---------------------------------------------------------------------------------------
def summary(source: str) -> str:
    blank = lambda c: f"count_if({strip(c)} = '')"
    return f"""SELECT count(*) AS total, CAST(count_if(Story_Point IS NULL) AS BIGINT) AS missing_story_point,
  CAST({blank('Title')} AS BIGINT) AS missing_title, CAST({blank('Description_Text')} AS BIGINT) AS missing_description,
  CAST(count(*) - {blank('Priority')} AS BIGINT) AS has_priority, CAST({blank('Priority')} AS BIGINT) AS missing_priority,
  count(DISTINCT Story_Point) AS unique_story_points FROM {source}"""


def by_project(source: str) -> str:
    return f"""SELECT coalesce(Project_Name, 'Unknown') AS Project_Name, count(*) AS total_tickets,
  count(Story_Point) AS labeled_tickets, {one_decimal('count(Story_Point) / CAST(count(*) AS DOUBLE) * 100')} AS labeled_pct
  FROM {source} GROUP BY {source}.Project_Name"""


def by_label(source: str, value: str = "Story_Point", where: str = "true") -> str:
    return f"""SELECT story_point, count, {shown('story_point')} AS story_point_label FROM (
  SELECT {value} AS story_point, count(*) AS count FROM {source} WHERE {where} GROUP BY 1)"""


ROUNDED = "round_even(Story_Point, 0)"
ORACLES["dataset_summary"] = f"WITH {ISSUES} {summary('issues')}"
ORACLES["dataset_summary_large"] = f"WITH {LARGE} {summary('large')}"
ORACLES["missing_fields"] = f"""WITH {ISSUES}, s AS ({summary('issues')}), rows_ AS (
  SELECT 'Missing Story_Point' AS metric, missing_story_point AS count, total FROM s UNION ALL
  SELECT 'Missing Title', missing_title, total FROM s UNION ALL
  SELECT 'Missing Description_Text', missing_description, total FROM s UNION ALL SELECT 'Missing Priority', missing_priority, total FROM s)
SELECT metric, count, {one_decimal('count / CAST(total AS DOUBLE) * 100')} AS pct FROM rows_"""
ORACLES["project_summary"] = f"WITH {NAMED} {by_project('named')}"
ORACLES["project_summary_large"] = f"WITH {LARGE} {by_project('large')}"
ORACLES["top_projects"] = f"""WITH {LARGE} SELECT * FROM ({by_project('large')})
  ORDER BY labeled_tickets DESC, total_tickets DESC, Project_Name LIMIT 5"""
ORACLES["label_counts"] = f"WITH {ISSUES} {by_label('issues')}"
ORACLES["label_counts_large"] = f"WITH {LARGE} {by_label('large')}"
ORACLES["rounded_label_counts"] = f"WITH {ISSUES} {by_label('issues', ROUNDED)}"
ORACLES["rounded_label_counts_of_project"] = f"WITH {NAMED} " + by_label("named", ROUNDED, "Project_Name = 'NATION_7'")
ORACLES["class_imbalance"] = f"""WITH {LARGE} SELECT story_point_label, count,
  round_even(count / CAST(sum(count) OVER () AS DOUBLE) * 100 * 100, 0) / 100 AS pct FROM ({by_label('large')})"""
ORACLES["clean_label_distribution"] = f"WITH {CLEAN} SELECT actual_story_points, count(*) AS count FROM clean GROUP BY 1"
ORACLES["priority_counts"] = f"WITH {ISSUES} SELECT coalesce(Priority, 'Missing') AS priority, count(*) AS count FROM issues GROUP BY issues.Priority"
LENGTHS = f"{ISSUES}, lengths AS (SELECT CAST(length(Description_Text) AS INTEGER) AS len_ FROM issues WHERE Description_Text IS NOT NULL)"
DESCRIBE = """SELECT count(*) AS count, round(avg(len_), 6) AS mean, round(stddev_samp(len_), 6) AS std, min(len_) AS min,
  round(quantile_cont(len_, 0.25), 6) AS p25, round(quantile_cont(len_, 0.5), 6) AS p50, round(quantile_cont(len_, 0.75), 6) AS p75,
  max(len_) AS max FROM lengths"""
ORACLES["described_lengths"] = f"WITH {LENGTHS} {DESCRIBE}"
ORACLES["length_histogram"] = f"""WITH {LENGTHS}, span AS (SELECT min(len_) AS lo, max(len_) AS hi FROM lengths),
placed AS (SELECT least(CAST(floor((len_ - lo) / ((hi - lo) / CAST(50 AS DOUBLE))) AS INTEGER) + 1, 50) AS bin FROM lengths, span)
SELECT CAST(b AS INTEGER) AS bin, round(lo + (b - 1) * (hi - lo) / CAST(50 AS DOUBLE), 6) AS lower,
  round(lo + b * (hi - lo) / CAST(50 AS DOUBLE), 6) AS upper, (SELECT count(*) FROM placed WHERE placed.bin = b) AS count
FROM range(1, 51) r(b), span"""
ORACLES["fractional_label_stats"] = f"""WITH {ISSUES} SELECT CAST(count_if(Story_Point <> {ROUNDED}) AS BIGINT) AS fractional_story_points,
  count(DISTINCT Story_Point) AS unique_raw, count(DISTINCT {ROUNDED}) AS unique_rounded FROM issues"""


def as_rows(source: str, section: str, columns: list[str], prefix: str = "''") -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {prefix} || '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({source})" for c in columns
    )


ORACLES["profile_report"] = f"WITH {NAMED}, {LENGTHS[len(ISSUES) + 2:]} " + " UNION ALL ".join([
    as_rows(summary("named"), "summary", ["total", "missing_story_point", "missing_title", "missing_description", "has_priority", "missing_priority", "unique_story_points"]),
    as_rows(DESCRIBE, "description_length", ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]),
    as_rows("SELECT coalesce(Priority, 'Missing') AS priority, count(*) AS count FROM named GROUP BY named.Priority", "priority", ["count"], "priority || '_'"),
    as_rows(by_label("named"), "story_point", ["count"], "story_point_label || '_'"),
    as_rows(by_project("named"), "project", ["total_tickets", "labeled_tickets", "labeled_pct"], "Project_Name || '_'"),
])


# --- sampling --------------------------------------------------------------------------------------
def balanced(source: str, cls: str, *identity: str) -> str:
    return f"""SELECT * EXCLUDE (cls, place, share) FROM (
  SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {hashed(42, *identity)}) AS place,
    (SELECT CAST(round_even(count(*) * 0.2, 0) AS BIGINT) // count(DISTINCT {cls}) FROM {source}) AS share
  FROM (SELECT *, {cls} AS cls FROM {source})) WHERE place <= share"""


ORACLES["balanced_sample"] = f"WITH {POOL}, chosen AS ({balanced('positive', snap('Story_Point'), 'ID')}) {tickets_from('chosen')}"
ORACLES["balanced_sample_with_zero"] = f"WITH {POOL}, chosen AS ({balanced('with_zero', label('Story_Point'), 'ID')}) {tickets_from('chosen')}"
ORACLES["balanced_sample_large"] = f"""WITH {LARGE}, pool AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, Story_Point FROM large)
{balanced('pool', snap('Story_Point'), 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')}"""
ORACLES["stratified_sample"] = f"""WITH {CLEAN} SELECT issue_key, actual_story_points FROM clean
  QUALIFY row_number() OVER (PARTITION BY actual_story_points ORDER BY {hashed(42, 'issue_key')}) <= 10"""
ORACLES["corpus_and_holdout"] = f"""WITH {ELIGIBLE}, sizes AS (SELECT actual_story_points AS lab, count(*) AS n FROM eligible GROUP BY 1),
wanted AS (SELECT lab, n, sum(n) OVER () AS total,
  sum(n) OVER () - CAST(ceil(round((CAST(1 AS DOUBLE) - CAST(0.8 AS DOUBLE)) * sum(n) OVER (), 9)) AS BIGINT) AS want FROM sizes),
parts AS (SELECT lab, n * want // total AS whole, n * want % total AS remainder, want - sum(n * want // total) OVER () AS missing FROM wanted),
quotas AS (SELECT lab, whole + CASE WHEN row_number() OVER (ORDER BY remainder DESC, lab) <= missing THEN 1 ELSE 0 END AS quota FROM parts)
SELECT issue_key, actual_story_points, CASE WHEN row_number() OVER (PARTITION BY actual_story_points ORDER BY {hashed(42, 'issue_key')}) <= quota
  THEN 'corpus' ELSE 'holdout' END AS side FROM eligible JOIN quotas ON lab = actual_story_points"""
ORACLES["split_through_files"] = f"""WITH marked AS ({ORACLES['corpus_and_holdout']})
  SELECT side, actual_story_points, count(*) AS n, true AS ordered FROM marked GROUP BY ALL"""
ORACLES["split_overlap"] = f"""WITH marked AS ({ORACLES['corpus_and_holdout']}) SELECT count(*) AS overlap FROM marked a
  WHERE side = 'corpus' AND issue_key IN (SELECT issue_key FROM marked WHERE side = 'holdout')"""
ORACLES["first_tickets"] = f"WITH {TICKETS} SELECT issue_key, project FROM tickets ORDER BY issue_key LIMIT 25"
ORACLES["export_distributions"] = f"""WITH {POOL}, b AS ({balanced('positive', snap('Story_Point'), 'ID')}),
z AS ({balanced('with_zero', label('Story_Point'), 'ID')})
SELECT 'full' AS set, {label('Story_Point')} AS actual_story_points, count(*) AS count FROM positive GROUP BY 2 UNION ALL
SELECT 'balanced', {label('Story_Point')}, count(*) FROM b GROUP BY 2 UNION ALL
SELECT 'balanced_with_zero', {label('Story_Point')}, count(*) FROM z GROUP BY 2"""

# --- text, scale and JSON expressions ----------------------------------------------------------------
ORACLES["cleaned_texts"] = f"""WITH {ISSUES} SELECT ID, {strip('Description_Text')} AS stripped, {unquote('Title')} AS title,
  {described('Description_Text', 'Description')} AS description,
  CASE WHEN {strip('Issue_Key')} <> '' THEN Issue_Key ELSE 'GEN-' || ID END AS key, {strip('Priority')} = '' AS no_priority FROM issues"""
ORACLES["scale_values"] = f"""WITH {ISSUES} SELECT ID, {snap('Story_Point')} AS snapped, {label('Story_Point')} AS label,
  {label('Story_Point')} AS class_zero, {snap('Story_Point')} AS class, {ROUNDED} AS rounded, {shown('Story_Point')} AS shown,
  coalesce(Story_Point IN {SCALE}, false) AS on_scale FROM issues"""
ORACLES["on_scale_lines"] = f"WITH {LARGE} SELECT Story_Point, count(*) AS n FROM large WHERE Story_Point IN {SCALE} GROUP BY 1"
ORACLES["confidence_labels"] = f"""WITH {ESTIMATES} SELECT CASE WHEN rag_confidence >= 0.75 THEN 'High' WHEN rag_confidence >= 0.55 THEN 'Medium'
  ELSE 'Low' END AS label, count(*) AS n FROM estimates GROUP BY 1"""
FLAT = strip("replace(text, chr(10), ' ')")
ORACLES["shortened_texts"] = f"""SELECT doc_id, CASE WHEN length({FLAT}) <= 300 THEN {FLAT} ELSE substr({FLAT}, 1, 297) || '...' END AS one_line,
  CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS snippet, {words('text')} AS words FROM documents"""
ORACLES["mentioned_keys"] = f"""SELECT doc_id, array_to_string(list_sort({keys_in(views.MENTIONS)}), ',') AS keys FROM documents"""
ORACLES["embedding_texts"] = f"""WITH subs AS ({view(views.SUBMISSIONS)}) SELECT doc_id, md5(CASE WHEN {strip('title')} <> ''
  THEN {strip('title')} || chr(10) || chr(10) || {strip('description')} ELSE {strip('description')} END) AS with_title,
  md5({strip('description')}) AS plain FROM subs"""
BY_KEY = "CAST(split_part(query_key, '-', 2) AS BIGINT) % 13"
ORACLES["neighbour_json"] = f"""WITH {NEIGHBOURS} SELECT query_key AS issue_key, CASE WHEN {BY_KEY} = 0 THEN '[]' WHEN {BY_KEY} = 1 THEN NULL
  WHEN {BY_KEY} = 2 THEN '{{"issue_key":"X-1"}}' ELSE '[' || string_agg('{{"issue_key":"' || issue_key ||
  '","story_points":' || story_points || ',"similarity":' || CAST(similarity AS VARCHAR) || ',"title":"T ' || issue_key || '"}}', ',' ORDER BY rank)
  || ']' END AS similar_tickets_json FROM neighbours GROUP BY query_key"""
SAME_STEM = "avg(CASE WHEN split_part(issue_key, '-', 1) = split_part(query_key, '-', 1) THEN 1.0 ELSE 0.0 END)"
LINE = "string_agg(issue_key || ' (' || printf('%.2f', similarity) || ')', ', ' ORDER BY rank)"
ORACLES["neighbour_lines"] = f"""WITH {NEIGHBOURS} SELECT query_key AS issue_key, CASE WHEN {BY_KEY} > 2 THEN {LINE} ELSE '' END AS line,
  CASE WHEN {BY_KEY} > 2 THEN round({SAME_STEM}, 6) END AS same_stem, split_part(query_key, '-', 1) AS stem FROM neighbours GROUP BY query_key"""
ORACLES["odd_neighbour_json"] = f"SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '-:' || doc_id % 9 || ':0.5' WHEN 1 THEN 'K-' || doc_id || ':5:0.75' " \
    "WHEN 2 THEN 'K:-:-|7:2:-' WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN '' ELSE 'é:-:1.0' END AS items FROM documents"
ORACLES["neighbour_examples"] = f"""WITH {NEIGHBOURS}, texts AS (SELECT issue_key, title, {strip("replace(description, chr(10), ' ')")} AS flat FROM vectors)
SELECT query_key, md5(string_agg('- ' || issue_key || ' (' || story_points || ' SP, similarity ' || printf('%.2f', similarity) || '): ' ||
  coalesce(nullif(title, ''), 'Untitled') || ' — ' || CASE WHEN length(flat) <= 300 THEN flat ELSE substr(flat, 1, 297) || '...' END,
  chr(10) ORDER BY rank)) AS block FROM neighbours JOIN texts USING (issue_key) GROUP BY query_key"""
REPAIRED = f"regexp_replace({strip('raw')}, ',\\s*([}}\\]])', '\\1', 'g')"
for _word, _literal in (("True", "true"), ("False", "false"), ("None", "null")):
    REPAIRED = f"regexp_replace({REPAIRED}, '\\b{_word}\\b', '{_literal}', 'g')"
REPAIRED = f"""regexp_replace({REPAIRED}, '''([^''\\\\]*)''', '"\\1"', 'g')"""
ORACLES["repaired_replies"] = f"SELECT doc_id, {REPAIRED} AS repaired FROM ({view(views.REPLIES)})"
REPLY_FACTS = f"""facts AS (SELECT d.doc_id, form, form NOT IN (7, 8, 15) AS found,
  CASE WHEN form IN (10, 11) THEN NULL WHEN form = 12 THEN 3e9 WHEN form = 16 THEN 5 ELSE CAST(n_chars % 25 AS DOUBLE) END AS points,
  CASE WHEN form <> 13 THEN (n_chars % 9 + 1) / CAST(10 AS DOUBLE) END AS confidence,
  'Looks ' || CASE WHEN form = 9 THEN 'braces }} and {{ inside' ELSE 'small' END || ' for ' || source AS reasoning
  FROM documents d JOIN ({view(views.REPLIES)}) r ON r.doc_id = d.doc_id)""".replace("{{", "{").replace("}}", "}")
ORACLES["reply_objects"] = f"""WITH {REPLY_FACTS} SELECT doc_id, found, CASE WHEN found THEN points END AS points,
  CASE WHEN found THEN confidence END AS confidence, CASE WHEN found THEN reasoning ELSE '' END AS reasoning,
  CASE WHEN found THEN true END AS complex, CASE WHEN found THEN 'part ' || doc_id || CASE WHEN form = 14 THEN '' ELSE ':' || doc_id % 6 END || ':|:1:rest' ELSE '' END AS parts FROM facts"""
ORACLES["reply_labels"] = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'grounded' WHEN 1 THEN 'inferred' WHEN 2 THEN 'hallucinated' END AS label
  FROM documents"""
CLAIM = f"nullif(regexp_extract(coalesce(reasoning, ''), '{POINT_CLAIM}', 1), '')"
AGREES = f"coalesce({CLAIM} IS NULL OR TRY_CAST({CLAIM} AS BIGINT) = predicted_story_points, false)"
ORACLES["point_claims"] = f"WITH {RAG} SELECT issue_key, {CLAIM} AS claimed, {AGREES} AS agrees FROM rag"
BLOCK = "'# ' || title || chr(10) || '(' || issue_type || ', ' || project || ')' || chr(10) || description"
PROMPT = f"{BLOCK} || chr(10) || chr(10) || '# Size: to be found'"
ORACLES["prompt_texts"] = f"WITH {TICKETS} SELECT issue_key, {PROMPT} AS user_prompt FROM tickets"

# --- estimation ------------------------------------------------------------------------------------
ORACLES["keyword_estimates"] = f"""WITH {NORAG} SELECT issue_key, predicted_story_points, confidence, complex_flag, reasoning, subtask_count,
  subtask_points_sum, subtask_titles FROM norag"""
ORACLES["merged_replies"] = f"""WITH {ESTIMATES}, {REPLY_FACTS}, j AS (SELECT f.*, e.rag_story_points AS rp, e.rag_raw_average AS ra, e.rag_confidence AS rc,
  CASE WHEN NOT found THEN 'no JSON object in the reply' WHEN rp IS NULL AND form IN (10, 11, 12) THEN 'story_points is no whole number'
    WHEN form = 13 THEN 'confidence is no number' WHEN form = 14 THEN 'story_points of a subtask is no whole number' END AS error
  FROM facts f LEFT JOIN estimates e ON e.query_key = {key('f.doc_id')})
SELECT doc_id, error, CASE WHEN error IS NULL THEN coalesce(rp, {snap('points')}) END AS story_points,
  round(CASE WHEN error IS NULL THEN least(confidence, coalesce(rc, 0.45)) END, 6) AS confidence,
  CASE WHEN error IS NULL THEN CASE WHEN rp IS NULL THEN '{NO_RETRIEVAL_WARNING} ' ELSE '' END || reasoning END AS reasoning,
  CASE WHEN error IS NULL THEN true END AS complex,
  CASE WHEN error IS NULL THEN CASE WHEN rp IS NULL THEN 'llm:m+no-retrieval' ELSE 'rag+llm:m' END END AS source,
  CASE WHEN error IS NULL THEN rp IS NULL END AS no_rag_fallback,
  CASE WHEN error IS NULL THEN round({exact('ra', 2)}, 1) END AS rag_raw_average, CASE WHEN error IS NULL THEN 2 END AS n_subtasks FROM j"""
SCRIPTED = f"""{TICKETS}, prompted AS (SELECT *, length({PROMPT}) AS size FROM tickets), scripted AS (SELECT *, size % 7 = 0 AS failed,
  CASE WHEN size % 7 = 0 THEN 3 WHEN size % 3 = 0 THEN 2 ELSE 1 END AS attempts,
  {snap('size % 25')} AS predicted FROM prompted)"""
ORACLES["generated_replies"] = f"""WITH {SCRIPTED} SELECT issue_key, CASE WHEN failed THEN 'I would rather not say {{' ELSE
  '{{"story_points": ' || size % 25 || ', "confidence": 0.' || size % 10 || ', "reasoning": "Length ' || size ||
  '", "subtasks": [{{"title": "only part", "story_points": ' || (size % 4 + 1) || '}}]}}' END AS reply, attempts,
  CASE WHEN failed THEN 'no usable reply in 3 attempts' END AS error FROM scripted"""
ORACLES["estimate_run_without_retrieval"] = f"""WITH {SCRIPTED} SELECT issue_key, actual_story_points, failed,
  CASE WHEN NOT failed THEN predicted END AS predicted_story_points,
  CASE WHEN NOT failed THEN least(CAST(size % 10 AS DOUBLE) / 10, CAST(0.45 AS DOUBLE)) END AS confidence,
  CASE WHEN NOT failed THEN predicted >= 13 END AS complex_flag, CASE WHEN NOT failed THEN 1 END AS subtask_count,
  CASE WHEN NOT failed THEN CAST(size % 4 + 1 AS INTEGER) END AS subtask_points_sum, CASE WHEN NOT failed THEN 'only part' END AS subtask_titles,
  CASE WHEN NOT failed THEN '{NO_RETRIEVAL_WARNING} Length ' || size END AS reasoning,
  CASE WHEN NOT failed THEN 'llm:m+no-retrieval' END AS source, CASE WHEN NOT failed THEN true END AS no_rag_fallback FROM scripted"""
ORACLES["estimate_run_from_a_log"] = ORACLES["estimate_run_without_retrieval"]
ORACLES["estimate_run_outcome"] = f"""WITH {SCRIPTED} SELECT count(*) AS n, CAST(count_if(NOT failed) AS BIGINT) AS written,
  CAST(count_if(failed) AS BIGINT) AS failed FROM scripted"""
ORACLES["failed_estimates"] = f"WITH {SCRIPTED} SELECT issue_key, 'no usable reply in 3 attempts' AS error FROM scripted WHERE failed"
EXAMPLE = """'- ' || issue_key || ' (' || story_points || ' SP, similarity ' || printf('%.2f', similarity) || '): ' ||
  coalesce(nullif(title, ''), 'Untitled') || ' — ' || CASE WHEN length(flat) <= 300 THEN flat ELSE substr(flat, 1, 297) || '...' END"""
ORACLES["estimate_run_with_retrieval"] = f"""WITH {TICKETS}, sample AS (SELECT * FROM tickets),
q AS (SELECT issue_key AS query_key, {letters(strip('description'))} AS query_vector FROM sample WHERE {strip('description')} <> ''),
c AS (SELECT issue_key, actual_story_points AS story_points, {letters(strip('description'))} AS embedding FROM tickets),
found AS ({nearest("(SELECT * FROM q WHERE list_sum(query_vector) > 0)", "(SELECT * FROM c WHERE list_sum(embedding) > 0)", 5)}),
est AS ({estimated('found', 'found')}),
texts AS (SELECT issue_key, {strip('title')} AS title, {strip("replace(" + strip('description') + ", chr(10), ' ')")} AS flat FROM tickets),
examples AS (SELECT query_key, string_agg({EXAMPLE}, chr(10) ORDER BY rank) AS block FROM found JOIN texts USING (issue_key) GROUP BY query_key),
asked AS (SELECT s.issue_key, s.actual_story_points, e.*, length(CASE WHEN e.query_key IS NULL THEN {PROMPT} ELSE
  {BLOCK} || chr(10) || chr(10) || '# Size: ' || rag_story_points || chr(10) || 'settled from ' || n_neighbours ||
  ' finished tickets, whose mean by similarity is ' || printf('%.1f', rag_raw_average) || ':' || chr(10) || x.block END) AS size
  FROM sample s LEFT JOIN est e ON e.query_key = s.issue_key LEFT JOIN examples x ON x.query_key = s.issue_key)
SELECT issue_key, actual_story_points, rag_story_points, round({exact('rag_raw_average', 2)}, 1) AS rag_raw_average, rag_confidence,
  query_key IS NULL AS no_rag_fallback, CAST(coalesce(n_neighbours, 0) AS INTEGER) AS n_neighbours FROM asked WHERE size % 7 <> 0"""
SUBTASK_VALUES = ", ".join(f"('{t}', {p}, '{r}')" for t, p, r in STANDARD_SUBTASKS)
SUBTASKS = f"""{NORAG}, subtasks AS (SELECT n.issue_key, n.title AS ticket_title, n.description, s.title AS subtask_title, s.reasoning AS subtask_reasoning
  FROM norag n, (VALUES {SUBTASK_VALUES}) s(title, points, reasoning) WHERE n.complex_flag)"""
LABEL_PROMPT_LENGTH = """length('# Subtask: ' || subtask_title || chr(10) || subtask_reasoning || chr(10) || chr(10) ||
  '# Its ticket: ' || ticket_title || chr(10) || description)"""
ORACLES["labelled_subtasks"] = f"""WITH {SUBTASKS} SELECT issue_key, subtask_title, CASE {LABEL_PROMPT_LENGTH} % 5 WHEN 0 THEN 'grounded'
  WHEN 1 THEN 'inferred' WHEN 2 THEN 'hallucinated' WHEN 3 THEN 'grounded' ELSE 'inferred' END AS label FROM subtasks"""

ORACLES["reviewed_subtasks"] = f"""WITH labelled AS ({ORACLES["labelled_subtasks"]})
""" + " UNION ALL ".join(f"""SELECT '{name}' AS label, CAST(count_if(label = '{name}') AS BIGINT) AS n,
  round(CAST(count_if(label = '{name}') AS DOUBLE) / count(*), 6) AS share FROM labelled""" for name in HALLUCINATION_LABELS)

# --- scores ----------------------------------------------------------------------------------------
ORACLES["off_scale_predictions"] = f"""WITH {ISSUES} SELECT CAST(ID AS VARCHAR) AS issue_key, CAST(trunc(Story_Point) AS INTEGER) AS predicted_story_points
  FROM issues WHERE NOT coalesce(CAST(trunc(Story_Point) AS INTEGER) IN {SCALE}, false)"""


def plain_scores(source: str) -> str:
    error = "CAST(abs(predicted_story_points - actual_story_points) AS DOUBLE)"
    relative = f"({error} / nullif(actual_story_points, 0))"
    hit = lambda c: f"avg(CASE WHEN {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    return f"""SELECT count(*) AS n, round(avg({error}), 6) AS mae, round(sqrt(avg({error} * {error})), 6) AS rmse,
  round(avg({relative}), 6) AS mmre, round({hit(relative + ' <= 0.25')}, 6) AS pred25, round({hit(relative + ' <= 0.5')}, 6) AS pred50,
  round({hit(error + ' = 0')}, 6) AS exact_match_rate FROM {source}"""


def tied_rank(column: str) -> str:
    return f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / CAST(2 AS DOUBLE))"


def correlation(source: str) -> str:
    return f"""SELECT corr(a, p) AS rho, count(*) AS m FROM (SELECT {tied_rank('actual_story_points')} AS a,
  {tied_rank('predicted_story_points')} AS p FROM {source})"""


def scores(source: str) -> str:
    """Scores with p by Simpson's rule: Student's t is a cosine power over the angle, cut where nothing is left."""
    weight = "CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""SELECT s.*, round(rho, 6) AS spearman_rho, round(upper_ / lower_, 6) AS spearman_p FROM ({plain_scores(source)}) s, (
  SELECT any_value(rho) AS rho, sum({weight} * pow(greatest(cos(t0 + greatest(hi - t0, 0) * i / 20000), 0), m - 3)) * any_value(greatest(hi - t0, 0)) AS upper_,
    sum({weight} * pow(greatest(cos(hi * i / 20000), 0), m - 3)) * any_value(hi) AS lower_
  FROM (SELECT rho, m, asin(abs(rho)) AS t0, least(pi() / 2, 40 / sqrt(m)) AS hi FROM ({correlation(source)})), range(0, 20001) r(i))"""


SCORE_COLUMNS = ["n", "mae", "rmse", "mmre", "pred25", "pred50", "exact_match_rate", "spearman_rho", "spearman_p"]
ORACLES["error_metrics"] = f"WITH {RAG} {scores('rag')}"
ORACLES["error_metrics_large"] = f"WITH {RESULTS_LARGE} {scores('results_large')}"
ORACLES["rank_correlation_large"] = f"WITH {RESULTS_LARGE} SELECT m AS n, round(rho, 6) AS spearman_rho FROM ({correlation('results_large')})"
ORACLES["average_ranks"] = f"""WITH {RESULTS_LARGE} SELECT DISTINCT actual_story_points AS actual, {tied_rank('actual_story_points')} AS actual_rank
  FROM results_large"""
ORACLES["worst_misses"] = f"""WITH {NORAG} SELECT issue_key, actual_story_points, predicted_story_points,
  abs(predicted_story_points - actual_story_points) AS abs_error FROM norag ORDER BY abs_error DESC, issue_key LIMIT 10"""
PAIRS = f"""{RAG}, {NORAG}, pairs AS (SELECT r.issue_key, abs(r.predicted_story_points - r.actual_story_points) AS error_rag,
  abs(n.predicted_story_points - n.actual_story_points) AS error_norag FROM rag r JOIN norag n USING (issue_key))"""
COMPARE = """SELECT count(*) AS n_paired, round(avg(error_rag - error_norag), 6) AS mean_abs_error_delta,
  round(avg(CASE WHEN error_rag < error_norag THEN 1.0 ELSE 0.0 END), 6) AS pct_rag_closer FROM pairs"""
ORACLES["paired_errors"] = f"WITH {PAIRS} SELECT issue_key, error_rag, error_norag, count(*) AS n_pairs FROM pairs GROUP BY ALL"
ORACLES["paired_comparison"] = f"WITH {PAIRS} {COMPARE}"
ORACLES["paired_comparison_repeated_keys"] = f"""WITH {RESULTS_LARGE}, pairs AS (
  SELECT abs(a.predicted_story_points - a.actual_story_points) AS error_rag, abs(b.predicted_story_points + 1 - b.actual_story_points) AS error_norag
  FROM results_large a JOIN results_large b USING (issue_key)) {COMPARE}"""
RETRIEVAL = f"""SELECT count(*) AS n, round(avg(CASE WHEN top1 IS NULL THEN 0.0 ELSE 1.0 END), 6) AS pct_with_neighbours, round(avg(top1), 6) AS mean_top1_similarity, round(avg(topk), 6) AS mean_topk_similarity,
  round(avg(spread), 6) AS mean_neighbour_sp_spread, round(avg(stem), 6) AS mean_same_project_rate
  FROM rag LEFT JOIN (SELECT query_key, max(similarity) AS top1, avg(similarity) AS topk, max(story_points) - min(story_points) AS spread,
    {SAME_STEM} AS stem FROM neighbours GROUP BY query_key) ON query_key = rag.issue_key AND rag.vec_id % 13 > 2"""
BANDS = """SELECT 'high' AS band, count(*) AS n, round(avg(abs(predicted_story_points - actual_story_points)), 6) AS mae FROM rag WHERE rag_confidence >= 0.7
  UNION ALL SELECT 'low', count(*), round(avg(abs(predicted_story_points - actual_story_points)), 6) FROM rag WHERE rag_confidence < 0.55"""
ORACLES["retrieval_stats"] = f"WITH {RAG} {RETRIEVAL}"
ORACLES["confidence_band_errors"] = f"WITH {RAG} {BANDS}"
CONFUSION = """SELECT CAST(count_if(actual_story_points >= 8 AND complex_flag) AS BIGINT) AS true_positive,
  CAST(count_if(actual_story_points < 8 AND complex_flag) AS BIGINT) AS false_positive,
  CAST(count_if(actual_story_points >= 8 AND NOT complex_flag) AS BIGINT) AS false_negative,
  CAST(count_if(actual_story_points < 8 AND NOT complex_flag) AS BIGINT) AS true_negative FROM norag"""
ORACLES["confusion_counts"] = f"WITH {NORAG} {CONFUSION}"
ORACLES["precision_recall_f1"] = f"""WITH {NORAG}, c AS ({CONFUSION}), s AS (
  SELECT CASE WHEN true_positive + false_positive > 0 THEN true_positive / CAST(true_positive + false_positive AS DOUBLE) ELSE 0 END AS p,
    CASE WHEN true_positive + false_negative > 0 THEN true_positive / CAST(true_positive + false_negative AS DOUBLE) ELSE 0 END AS r FROM c)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s"""
GAPS = "SELECT issue_key, predicted_story_points, subtask_points_sum, subtask_points_sum - predicted_story_points AS gap, subtask_titles FROM norag WHERE complex_flag"
ORACLES["reconciliation_gaps"] = f"WITH {NORAG} {GAPS}"
ORACLES["mean_reconciliation_gap"] = f"WITH {NORAG} SELECT count(*) AS n_decomposed, round(avg(gap), 6) AS mean_gap FROM ({GAPS})"
ORACLES["ablation_report"] = f"WITH {PAIRS} " + " UNION ALL ".join([
    as_rows(scores("rag"), "rag", SCORE_COLUMNS), as_rows(scores("norag"), "norag", SCORE_COLUMNS),
    as_rows(COMPARE, "paired", ["n_paired", "mean_abs_error_delta", "pct_rag_closer"]),
    as_rows(RETRIEVAL, "retrieval", ["n", "pct_with_neighbours", "mean_top1_similarity", "mean_topk_similarity", "mean_neighbour_sp_spread", "mean_same_project_rate"]),
    as_rows(BANDS, "confidence", ["n", "mae"], "band || '_'"),
])

# --- reviews ---------------------------------------------------------------------------------------
SHEET = f"""{RAG}, lines AS (SELECT query_key, {LINE} AS line, list(issue_key) AS keys FROM neighbours GROUP BY query_key),
sheet AS (SELECT rag.*, line, keys FROM rag JOIN lines ON query_key = rag.issue_key WHERE rag.vec_id % 13 > 2)"""
ORACLES["justification_sheet"] = f"""WITH {SHEET} SELECT issue_key, title AS ticket_title, CASE WHEN length(description) > 500
  THEN substr(description, 1, 500) || '...' ELSE description END AS ticket_description_snippet, predicted_story_points, reasoning,
  line AS neighbour_keys, {', '.join(f"'' AS {c}" for c in RUBRIC_COLUMNS)} FROM sheet"""
NUMBER = "CAST(split_part(issue_key, '-', 2) AS BIGINT)"
MARKS = ", ".join(f"CASE WHEN {NUMBER} % {11 + i} = 0 THEN NULL WHEN {NUMBER} % {i + 2} = 0 THEN 1 ELSE 0 END AS {c}" for i, c in enumerate(RUBRIC_COLUMNS))
ORACLES["reviewed_justifications"] = f"""WITH {SHEET}, marked AS (SELECT {MARKS} FROM sheet),
done AS (SELECT * FROM marked WHERE {' AND '.join(f"{c} IS NOT NULL" for c in RUBRIC_COLUMNS)}),
t AS (SELECT count(*) AS labeled, (SELECT count(*) FROM marked) - count(*) AS unlabeled,
  round(({' + '.join(f"avg({c})" for c in RUBRIC_COLUMNS)}) / {len(RUBRIC_COLUMNS)}, 6) AS mean_rate FROM done)
""" + " UNION ALL ".join(f"""SELECT '{c}' AS rubric, CAST(sum({c}) AS BIGINT) AS positive, any_value(labeled) AS labeled, any_value(unlabeled) AS unlabeled,
  round(avg({c}), 6) AS rate, any_value(mean_rate) AS mean_rate FROM done, t""" for c in RUBRIC_COLUMNS)
CHECKS = f"""{SHEET}, checks AS (SELECT issue_key, {AGREES} AS consistent, true AS has_neighbours, list_has_any(cited, keys) AS cites_neighbour, cited,
  list_filter(cited, lambda k: NOT list_contains(keys, k)) AS invented FROM (SELECT *, {keys_in('reasoning')} AS cited FROM sheet))"""
ORACLES["citation_checks"] = f"""WITH {CHECKS} SELECT issue_key, consistent, has_neighbours, cites_neighbour,
  array_to_string(list_sort(cited), ',') AS cited, array_to_string(invented, ',') AS invented FROM checks"""
ORACLES["automatic_checks"] = f"""WITH {CHECKS} SELECT count(*) AS n, round(avg(CAST(cites_neighbour AS INT)), 6) AS pct_cites_neighbour,
  count(*) AS n_eligible_cite, round(avg(CAST(len(invented) = 0 AS INT)), 6) AS pct_no_invented_keys,
  round(avg(CAST(consistent AS INT)), 6) AS pct_sp_consistent FROM checks"""
SCORE = lambda c: f"CASE WHEN {strip(c)} IN ('1', '1.0') THEN 1 WHEN {strip(c)} IN ('0', '0.0') THEN 0 END"
RUBRIC = f"""rubric AS (SELECT issue_key, {', '.join(f'{SCORE(c)} AS {c}' for c in RUBRIC_COLUMNS)} FROM ({view(views.RUBRIC_SHEET)})),
done AS (SELECT * FROM rubric WHERE {' AND '.join(f'{c} IS NOT NULL' for c in RUBRIC_COLUMNS)})"""
ORACLES["fully_labelled_sheets"] = f"WITH {RUBRIC} SELECT * FROM done"
ORACLES["rubric_rates"] = f"""WITH {RUBRIC}, t AS (SELECT count(*) AS labeled, (SELECT count(*) FROM rubric) - count(*) AS unlabeled,
  round(avg({' + '.join(RUBRIC_COLUMNS)}) / {len(RUBRIC_COLUMNS)}, 6) AS mean_rate FROM done) """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS rubric, CAST(sum({c}) AS BIGINT) AS positive, any_value(labeled) AS labeled, any_value(unlabeled) AS unlabeled,
  round(avg({c}), 6) AS rate, any_value(mean_rate) AS mean_rate FROM done, t""" for c in RUBRIC_COLUMNS)
ORACLES["subtask_sheet"] = f"WITH {SUBTASKS} SELECT issue_key, ticket_title, subtask_title, subtask_reasoning, '' AS label FROM subtasks"
LABELLED = """labelled AS (SELECT 'T-' || doc_id // 4 AS issue_key, CASE doc_id % 6 WHEN 0 THEN 'grounded' WHEN 1 THEN 'inferred'
  WHEN 2 THEN 'hallucinated' END AS label FROM documents)"""
ORACLES["valid_labels"] = f"WITH {LABELLED} SELECT issue_key, count(*) AS n FROM labelled WHERE label IS NOT NULL GROUP BY 1"
ORACLES["label_rates"] = f"WITH {LABELLED} " + " UNION ALL ".join(
    f"""SELECT '{name}' AS label, CAST(count_if(label = '{name}') AS BIGINT) AS n, round({share(f"count_if(label = '{name}')", 'count(label)')}, 6) AS share
  FROM labelled""" for name in HALLUCINATION_LABELS)
ORACLES["hallucination_summary"] = f"""WITH {LABELLED}, s AS (SELECT count(label) AS labeled, count(*) - count(label) AS unlabeled,
  CAST(count_if(label = 'hallucinated') AS BIGINT) AS hallucinated, count(DISTINCT CASE WHEN label IS NOT NULL THEN issue_key END) AS tickets,
  count(DISTINCT CASE WHEN label = 'hallucinated' THEN issue_key END) AS tickets_hallucinated FROM labelled)
SELECT *, round({share('hallucinated', 'labeled')}, 6) AS hallucination_rate, round({share('tickets_hallucinated', 'tickets')}, 6) AS ticket_rate FROM s"""
ORACLES["tickets_through_split_csv"] = ORACLES["tickets_through_csv"]
ORACLES["backlog_from_split_json"] = ORACLES["backlog_from_json"]
ORACLES["kept_ablation_report"] = ORACLES["ablation_report"]
