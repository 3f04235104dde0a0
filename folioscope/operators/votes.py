"""Votes on search results, and retrieval quality from them.

"Retrieved" means rated: an approach's precision is over the results somebody voted on.
One relevant vote, by anybody under any approach, makes an item relevant for a query.
"""

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from . import skew

ALL_APPROACHES = (
    V.APPROACH_TEXT_ONLY, V.APPROACH_HYBRID, V.APPROACH_JOINT, V.APPROACH_UNIFIED,
)


def askable(queries: DataFrame, query="query") -> DataFrame:
    """An empty query is not searched; white space counts as text."""
    return queries.filter(F.col(query) != "")


def storable(events: DataFrame, evaluator="evaluator") -> DataFrame:
    """A vote without the evaluator's name is not stored."""
    return events.filter(F.col(evaluator) != "")


def events(hits: DataFrame, votes: DataFrame, now=None, query="query") -> DataFrame:
    """Evaluation events from search hits and votes ``(evaluator, approach_id, query,
    result_id, liked)``.

    Give votes and hits that are tables (``session.stored``). Hits with a large share of the votes are
    joined without a shuffle of these votes (``operators.skew``).
    """
    keys = ["approach_id", query, "result_id"]
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if now is None else now
    shown = hits.select(
        "approach_id", query, F.col("id").alias("result_id"),
        F.col("type").alias("result_type"), F.col("page").cast("int").alias("result_page"),
        F.col("score").cast("double").alias("result_score"),
    )
    return skew.join(storable(votes), shown, keys).select(
        now.alias("timestamp"), "evaluator", "approach_id", F.col(query).alias("query"),
        "result_id", "result_type", "result_page", "result_score",
        F.when(F.col("liked"), V.VOTE_RELEVANT).otherwise(V.VOTE_NOT_RELEVANT).alias("evaluation"),
    )


def relevance(evaluation="evaluation"):
    """1 for a relevant vote, 0 for anything else and for no verdict."""
    return F.coalesce((F.col(evaluation) == V.VOTE_RELEVANT).cast("int"), F.lit(0))


def labelled(evaluations: DataFrame) -> DataFrame:
    return evaluations.withColumn("is_relevant", relevance())


def truth_sets(evaluations: DataFrame) -> DataFrame:
    """Distinct relevant results per query."""
    return (
        evaluations.filter((relevance() == 1) & F.col("query").isNotNull())
        .select("query", "result_id").distinct()
    )


def truth_size(evaluations: DataFrame) -> DataFrame:
    return truth_sets(evaluations).groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))


def _judged(evaluations, approach_ids):
    """One row per (query, result): is it relevant, and which approaches returned it.

    A hash aggregate of flags with partial aggregation, so many votes on one result
    shrink before the shuffle.
    """
    flags = [
        F.max(F.coalesce((F.col("approach_id") == a).cast("int"), F.lit(0))).alias(f"r{i}")
        for i, a in enumerate(approach_ids)
    ]
    return (
        evaluations.filter(F.col("query").isNotNull())
        .groupBy("query", "result_id")
        .agg(F.max(relevance()).alias("relevant"), *flags)
    )


def _per_query(judged, approach_ids):
    """Set sizes per query; queries without a relevant result are no part of the truth."""
    sizes = [F.sum("relevant").alias("relevant")]
    for i in range(len(approach_ids)):
        sizes.append(F.sum(f"r{i}").alias(f"n{i}"))
        sizes.append(F.sum(F.col(f"r{i}") * F.col("relevant")).alias(f"t{i}"))
    return judged.groupBy("query").agg(*sizes).filter(F.col("relevant") > 0)


def confusion(evaluations: DataFrame, approach_ids=ALL_APPROACHES) -> DataFrame:
    """True positives, false positives and false negatives per approach and query.

    Two shuffles, no join: set sizes of all approaches come from one pass.
    """
    sizes = _per_query(_judged(evaluations, approach_ids), approach_ids)
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("approach_id"), F.col(f"n{i}").alias("retrieved"),
            F.col(f"t{i}").alias("tp"),
        )
        for i, a in enumerate(approach_ids)
    ])
    return (
        sizes.select("query", "relevant", F.inline(rows))
        .filter(F.col("retrieved") > 0)
        .select(
            "approach_id", "query", "tp",
            (F.col("retrieved") - F.col("tp")).alias("fp"),
            (F.col("relevant") - F.col("tp")).alias("fn"),
        )
    )


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(confusion_rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 per query; 0 where the denominator is 0."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return (
        confusion_rows
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(
            2 * (F.col("precision") * F.col("recall")), F.col("precision") + F.col("recall")
        ))
    )


def macro(per_query: DataFrame, registry: DataFrame) -> DataFrame:
    """Mean over an approach's own queries; a registered approach without any gets 0."""
    means = per_query.groupBy("approach_id").agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
        F.count(F.lit(1)).alias("queries"),
    )
    return registry.select("approach_id").join(means, "approach_id", "left").select(
        "approach_id",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        F.coalesce("queries", F.lit(0)).cast("bigint").alias("queries"),
    )


def report(macro_rows: DataFrame) -> DataFrame:
    """The table people read. The text forms are for display; compare the numbers."""
    def percent(c):
        return F.format_string("%.2f%%", F.round(F.col(c) * 100, 2))

    return macro_rows.select(
        "approach_id", "precision", "recall", "f1",
        percent("precision").alias("precision_text"), percent("recall").alias("recall_text"),
        F.format_string("%.3f", F.round("f1", 3)).alias("f1_text"),
    )


def false_positives(evaluations: DataFrame, approach_ids=ALL_APPROACHES) -> DataFrame:
    """Returned but not relevant, for queries that have a relevant result."""
    rejected = _judged(evaluations, approach_ids).filter("relevant = 0")
    known = evaluations.filter((relevance() == 1) & F.col("query").isNotNull()) \
        .select("query").distinct()
    return _listed(rejected, approach_ids, 1).join(known, "query", "left_semi") \
        .select("approach_id", "query", "result_id")


def false_negatives(evaluations: DataFrame, approach_ids=ALL_APPROACHES) -> DataFrame:
    """Relevant but not returned, for queries the approach returned anything for."""
    wanted = _judged(evaluations, approach_ids).filter("relevant = 1")
    answered = evaluations.filter(F.col("approach_id").isin(list(approach_ids))) \
        .select("approach_id", "query").distinct()
    return _listed(wanted, approach_ids, 0) \
        .join(answered, ["approach_id", "query"], "left_semi") \
        .select("approach_id", "query", "result_id")


def _listed(judged, approach_ids, flag):
    """One row per approach whose flag has the given value."""
    rows = F.array(*[
        F.struct(F.lit(a).alias("approach_id"), F.col(f"r{i}").alias("flag"))
        for i, a in enumerate(approach_ids)
    ])
    return judged.select("query", "result_id", F.inline(rows)).filter(F.col("flag") == flag).drop("flag")


def retrieved_relevant(evaluations: DataFrame, approach_id) -> DataFrame:
    """The intersection as rows: results of one approach that are relevant. One aggregate of flags, no join."""
    return _judged(evaluations, [approach_id]).filter("relevant = 1 AND r0 = 1").select("query", "result_id")


def hits_as_evaluations(hits: DataFrame, relevant, query="query_id", id_col="id") -> DataFrame:
    """Search results in the form of votes, to measure results instead of ratings.

    ``relevant`` is a boolean column over the hits.
    """
    return hits.select(
        "approach_id", F.col(query).cast("string").alias("query"),
        F.col(id_col).cast("string").alias("result_id"),
        F.when(relevant, V.VOTE_RELEVANT).otherwise(V.VOTE_NOT_RELEVANT).alias("evaluation"),
    )
