"""Large CSV files in byte ranges, though quoted fields hold line breaks.

Files are read as lines, which splits them anywhere. A line begins a record if the number of quotes before it in its file is even,
whichever rules the quoting follows, as a doubled quote counts two. So quotes are summed up per range, one row per range
goes to the driver, and each range learns from the sums before it whether it begins inside quotes. Tasks then put lines
together to records. Only the pieces of a record that crosses the border of ranges meet in a shuffle. Records go to ``from_csv``.
"""

from pyspark.sql import DataFrame, Window, functions as F, types as T

PIECE = "file string, start long, kind string, text string"


def _lines(spark, path):
    where = F.col("_metadata")
    return spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(
        F.col("value"), where["file_path"].alias("file"), where["file_block_start"].alias("start"))


def _begin_inside(lines):
    """{(file, range): does it begin inside quotes?} for the ranges of all files."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n")).collect()  # one row per range
    inside, file, odd = {}, None, False
    for r in sorted(sums, key=lambda r: (r["file"], r["start"])):
        odd = odd and r["file"] == file
        inside[r["file"], r["start"]] = odd
        odd, file = odd != bool(r["n"] % 2), r["file"]
    return inside


def records(spark, path) -> DataFrame:
    """(text): the records of all files of a folder, or of one file, without headers, blank lines and the ends of lines."""
    lines = _lines(spark, path)
    sent = spark.sparkContext.broadcast(_begin_inside(lines))

    def assemble(batches):
        import pyarrow as pa

        where, held, odd, first = None, [], False, False
        out = {"file": [], "start": [], "kind": [], "text": []}

        def put(kind):
            if held:
                for name, value in zip(out, (*where, kind, "\n".join(held))):
                    out[name].append(value)
                held.clear()

        def flush():
            rows = pa.RecordBatch.from_pydict(out, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("text", pa.string())]))
            for values in out.values():
                values.clear()
            return rows

        def ended():
            # inside quotes the record goes on in the next range
            put(("whole" if not odd else "tail") if first else ("head" if not odd else "middle"))

        for b in batches:
            for value, file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (file, start) != where:
                    if where is not None:
                        ended()
                    where, odd = (file, start), sent.value[file, start]
                    first, header = not odd, start == 0  # does what is held begin here?
                held.append(value)
                odd ^= value.count('"') % 2 == 1
                if not odd:
                    if header and first:
                        held.clear()
                        header = False
                    put("whole" if first else "head")
                    first = True
            yield flush()
        if where is not None:
            ended()
        yield flush()

    pieces = lines.mapInArrow(assemble, PIECE)
    whole = pieces.filter(F.col("kind") == "whole").select("text")
    # at most two pieces per range
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == "tail")
    cut = pieces.filter(F.col("kind") != "whole").withColumn("record", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    listed = F.sort_array(F.collect_list(F.struct("start", "text")))
    joined = cut.groupBy("file", "record").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n").alias("text")).select("text")
    rows = whole.unionByName(joined).select(F.regexp_replace("text", "\r$", "").alias("text"))
    return rows.filter(F.col("text") != "")


def read(spark, path, schema: T.StructType, **options) -> DataFrame:
    """The records as columns of text, by their order."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    parsed = F.from_csv("text", text.simpleString()[len("struct<"):-1].replace(":", " "), {"quote": '"', "escape": '"', **options})
    return records(spark, path).select(parsed.alias("r")).select("r.*")
