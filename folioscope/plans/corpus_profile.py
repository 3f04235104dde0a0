"""The profile job: the tables behind the corpus report."""

from pyspark.sql import DataFrame

from .. import fixed_values as V
from ..operators import embedtext, profile


def tables(clean: DataFrame, stop=None) -> dict:
    """Every table of the report by name; each is computed when it is read."""
    if "text_for_embedding" not in clean.columns:
        clean = embedtext.with_embedding_text(clean)
    measured = profile.lengths(clean)
    return {
        "columns": profile.column_overview(clean),
        "first_rows": profile.first_rows(clean, ["page", "id"]),
        "pages": profile.page_count(clean),
        "items_per_page": profile.items_per_page_stats(clean),
        "lengths": profile.describe(measured, ["desc_len", "kw_count", "embed_len"]),
        "length_by_type": profile.mean_length_by_type(clean),
        "types": profile.count_by_type(clean),
        "length_histogram": profile.histogram(measured, "embed_len", V.LENGTH_BINS),
        "page_histogram": profile.histogram(clean, "page", V.PAGE_BINS),
        "top_pages": profile.top_pages(clean),
        "words": profile.word_frequency(clean, stop=stop),
        "bigrams": profile.top_ngrams(clean, stop=stop),
    }
