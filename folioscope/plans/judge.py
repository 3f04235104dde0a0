"""The judge job: votes, or search results with known relevance, to a table of metrics."""

from pyspark.sql import DataFrame

from ..operators import ratings, votes
from ..sources import evaluations as log, records as record_store
from . import approaches


def quality(evaluations: DataFrame, registry: DataFrame, approach_ids=votes.ALL_APPROACHES) -> DataFrame:
    return votes.macro(votes.prf(votes.confusion(evaluations, approach_ids)), registry)


def report(evaluations: DataFrame, registry: DataFrame, approach_ids=votes.ALL_APPROACHES) -> DataFrame:
    return votes.report(quality(evaluations, registry, approach_ids))


def report_log(spark, path) -> DataFrame:
    """The metric table of a stored evaluation log."""
    return report(log.read(spark, path), approaches.registry_table(spark))


def rating_tables(spark, path, users: DataFrame) -> dict:
    """Rated records flat, overall precision, and precision per rater."""
    records = record_store.read(spark, path)
    return {
        "ratings": ratings.flatten(records, users),
        "overall": ratings.overall(records),
        "by_user": ratings.by_user(records, users),
    }
