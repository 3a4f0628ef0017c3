"""Fixed schemas and domain constants. Nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------------
SCALE = (1, 2, 3, 5, 8, 13, 21)
MAX_STORY_POINT = 100
COMPLEX_THRESHOLD = 8
COMPLEX_POINTS = 13
NO_RETRIEVAL_CONFIDENCE_CAP = 0.45
MAX_NEIGHBOURS = 50
DEFAULT_NEIGHBOURS = 10
RUBRIC_COLUMNS = ("grounded", "faithful_to_rag", "comparative", "no_hallucination", "useful")
HALLUCINATION_LABELS = ("grounded", "inferred", "hallucinated")
# ------------------------------------------------------------------------------------------------

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(text: str) -> T.StructType:
    """A schema from ``name type, ...``; unlike Spark's own DDL parser it needs no running session."""
    pairs = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ISSUES = _struct(
    "ID long, Issue_Key string, Project_ID long, Type string, Title string, Description string, "
    "Description_Text string, Priority string, Story_Point double"
)
PROJECTS = _struct("ID long, Name string")
TICKETS = _struct(
    "issue_key string, project string, issue_type string, title string, description string, "
    "actual_story_points int"
)
BACKLOG = _struct(
    "issue_key string, project string, issue_type string, title string, description string"
)
VECTORS = _struct(
    "issue_key string, title string, description string, story_points int, "
    "embedding array<float>, embedding_model string, created_at timestamp"
)
NEIGHBOUR_ITEM = "issue_key string, story_points int, similarity double, title string"
SUBTASK_ITEM = "title string, story_points int, reasoning string"
RESULTS = _struct(
    "issue_key string, project string, issue_type string, title string, description string, "
    "actual_story_points int, predicted_story_points int, confidence double, complex_flag boolean, "
    "subtask_count int, subtask_points_sum int, subtask_titles string, subtasks_json string, "
    "reasoning string, source string, rag_story_points int, rag_raw_average double, "
    "rag_confidence double, no_rag_fallback boolean, similar_tickets_json string"
)
JUSTIFICATION_REVIEW = _struct(
    "issue_key string, ticket_title string, ticket_description_snippet string, "
    "predicted_story_points int, reasoning string, neighbour_keys string, similar_tickets_json string, "
    + ", ".join(f"{c} string" for c in RUBRIC_COLUMNS)
)
HALLUCINATION_REVIEW = _struct(
    "issue_key string, ticket_title string, ticket_description string, subtask_title string, "
    "subtask_reasoning string, label string"
)
REPLIES = _struct("issue_key string, raw string")
