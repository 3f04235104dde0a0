"""The jobs from the command line.

    spark-submit … -m folioscope annotate PAGES STORE --annotator module:factory
    python -m folioscope build ANNOTATIONS VECTORS --encoders module:factory [--images DIR] [--approaches A,B] [--cache DIR]
    python -m folioscope search QUERIES VECTORS OUT --encoders module:factory
    python -m folioscope records VECTORS OUT --encoders module:factory [--queries QUERIES] [--images DIR]
    python -m folioscope judge EVALUATIONS
    python -m folioscope ratings RECORDS USERS
    python -m folioscope profile ANNOTATIONS OUT

PAGES is a Parquet table (page, text); ANNOTATIONS a CSV file or a Parquet store; QUERIES and
USERS are Parquet tables. An annotator factory returns ``annotate(prompt) -> text``; an encoder
factory returns a dict of model name to ``plans.approaches.Encoder``.
"""

import argparse
import importlib

from folioscope.operators import corpus
from folioscope.plans import annotate, approaches, corpus_profile, judge, search, vector_cache
from folioscope.session import build_session, stored
from folioscope.sources import annotations, pages, vectors


def _load(name):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _annotations(spark, path):
    read = annotations.read_csv if path.endswith(".csv") else annotations.read
    return read(spark, path)


def _annotate(spark, a):
    added, failed = annotate.run(spark.read.parquet(a.pages), a.store, _load(a.annotator), a.mode)
    print(f"{added} annotations added, {failed} failed")


def _build(spark, a):
    images = pages.read_image_bytes(spark, a.images) if a.images else None
    registry = approaches.only(*a.approaches.split(",")) if a.approaches else approaches.REGISTRY
    approaches.build_store(_annotations(spark, a.annotations), _load(a.encoders)(), a.vectors, images, registry,
                           pages.qualified(spark, pages.parent(a.images)) if a.images else "",
                           vector_cache.Cache(spark, a.cache, spark.sparkContext.applicationId) if a.cache else None)
    built = vectors.read(spark, a.vectors)
    vectors.build_status(built, approaches.registry_table(spark)).show(truncate=False)
    vectors.failures(built).show(truncate=False)


def _search(spark, a):
    hits = search.answer(spark.read.parquet(a.queries), vectors.read(spark, a.vectors), _load(a.encoders)())
    hits.write.mode("overwrite").parquet(a.out)


def _records(spark, a):
    asked = spark.read.parquet(a.queries) if a.queries else search.fixed_queries(spark)
    search.write_records(asked, vectors.read(spark, a.vectors), _load(a.encoders)(), a.out,
                         pages.read_image_bytes(spark, a.images) if a.images else None,
                         pages.qualified(spark, pages.parent(a.images)) if a.images else "")


def _judge(spark, a):
    judge.report_log(spark, a.evaluations).show(truncate=False)


def _ratings(spark, a):
    for name, table in judge.rating_tables(spark, a.records, spark.read.parquet(a.users)).items():
        print(name)
        table.show(truncate=False)


def _profile(spark, a):
    clean = stored(corpus.clean(_annotations(spark, a.annotations)), "clean")
    for name, table in corpus_profile.tables(clean).items():
        table.write.mode("overwrite").parquet(f"{a.out}/{name}")


JOBS = {
    "annotate": (_annotate, ["pages", "store"], {"annotator": None, "mode": "relevant"}),
    "build": (_build, ["annotations", "vectors"], {"encoders": None, "images": "", "approaches": "", "cache": ""}),
    "search": (_search, ["queries", "vectors", "out"], {"encoders": None}),
    "records": (_records, ["vectors", "out"], {"encoders": None, "queries": "", "images": ""}),
    "judge": (_judge, ["evaluations"], {}),
    "ratings": (_ratings, ["records", "users"], {}),
    "profile": (_profile, ["annotations", "out"], {}),
}


def main(argv=None):
    parser = argparse.ArgumentParser(prog="folioscope")
    commands = parser.add_subparsers(dest="job", required=True)
    for name, (_, inputs, options) in JOBS.items():
        command = commands.add_parser(name)
        for x in inputs:
            command.add_argument(x)
        for x, default in options.items():
            command.add_argument(f"--{x}", default=default, required=default is None)
    arguments = parser.parse_args(argv)
    JOBS[arguments.job][0](build_session(), arguments)


if __name__ == "__main__":
    main()
