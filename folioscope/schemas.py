"""Row formats of the stored tables."""

from pyspark.sql import types as T


def _fields(*pairs):
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

# The exchange file holds one document, within which ids are unique.
ANNOTATION_FILE = _fields(
    ("id", _S), ("page", _I), ("type", _S), ("content_path", _S),
    ("original_text", _S), ("description_llm", _S), ("keywords_llm", _S),
)

# The store holds many: a row is known by document and id. One document may do without a name.
ANNOTATION = _fields(("doc_id", _S)).add("id", _S)
for _field in ANNOTATION_FILE.fields[1:]:
    ANNOTATION = ANNOTATION.add(_field)

# The time stays text on disk: a bad clock value must not cost the vote.
EVALUATION = _fields(
    ("timestamp", _S), ("evaluator", _S), ("approach_id", _S), ("query", _S),
    ("result_id", _S), ("result_type", _S), ("result_page", _I),
    ("result_score", _D), ("evaluation", _S),
)

RESPONSES = T.ArrayType(_fields(("user_id", _S), ("value", _I)))

RATING_RECORD = _fields(
    ("query", _S), ("result_text", _S), ("page", _S), ("score", _S),
    ("responses", RESPONSES),
)

RATING_RECORD_MULTIMODAL = _fields(
    ("query", _S), ("type", _S), ("content", _S), ("responses", RESPONSES),
)

VECTOR_ITEM = _fields(
    ("doc_id", _S), ("id", _S), ("page", _I), ("content_path", _S), ("original_text", _S),
    ("description_llm", _S), ("keywords_llm", _S), ("text_for_embedding", _S),
    ("vector", T.ArrayType(T.FloatType())), ("approach_id", _S), ("type", _S),
)
