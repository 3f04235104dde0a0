"""The text that goes into an encoder."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as X

BY_TYPE = {"text": V.TEMPLATE_TEXT, "image": V.TEMPLATE_IMAGE}


def embedding_text(templates=None, description="description_llm", keywords="keywords_llm",
                   kind="type") -> Column:
    """A dict gives a template per type (other types get an empty text); one string is
    used for every type."""
    templates = BY_TYPE if templates is None else templates
    parts = {"description": F.col(description), "keywords": F.col(keywords)}
    if isinstance(templates, str):
        return X.fill_template(templates, **parts)
    out = None
    for name, template in templates.items():
        filled = X.fill_template(template, **parts)
        out = F.when(F.col(kind) == name, filled) if out is None else out.when(F.col(kind) == name, filled)
    return out.otherwise("")


def with_embedding_text(clean: DataFrame, templates=None) -> DataFrame:
    return clean.withColumn("text_for_embedding", embedding_text(templates))


def prefixed(col, prefix=V.PASSAGE_PREFIX) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(prefix), col) if prefix else col
