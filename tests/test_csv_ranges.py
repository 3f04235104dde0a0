"""CSV in ranges: the rows of a reader that takes each file whole, wherever the file is cut."""

import pandas as pd
import pytest

from folioscope import schemas
from folioscope.sources import csv_ranges

ROWS = [("a", "1", "text", None, 'two\nlines, "quoted"\n\n"', "d", "x, y"), ("b", "2", "image", "p", " ", '"', "k"), ("ç", "3", "text", None, "\n\n\n" + "long line " * 20 + "\n", "é\n", ","),
        ("d", "4", "text", None, None, '""\n""', "k"), ("e", "5.0", "text", None, "x", "y", 'end"')]


def whole(spark, path):
    text = ", ".join(f"{f.name} string" for f in schemas.ANNOTATION_FILE)
    return spark.read.schema(text).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def compare(spark, path, rows):
    as_set = lambda df: sorted(map(str, df.collect()))
    assert as_set(csv_ranges.read(spark, path, schemas.ANNOTATION_FILE)) == as_set(whole(spark, path))
    assert csv_ranges.read(spark, path, schemas.ANNOTATION_FILE).count() == rows


@pytest.mark.parametrize("size", [3, 7, 16, 61, 100_000])
def test_every_cut(spark, tmp_path, size):
    """Ranges of a few bytes end at every place, inside quotes, between doubled quotes and in empty lines."""
    folder = tmp_path / "files"
    folder.mkdir()
    frame = pd.DataFrame(ROWS * 2, columns=schemas.ANNOTATION_FILE.fieldNames())
    frame.to_csv(folder / "one.csv", index=False, encoding="utf-8-sig")
    frame.iloc[:3].to_csv(folder / "two.csv", index=False)
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    compare(own, str(folder), 13)


def test_other_line_ends_headers_and_blanks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b'id,page,type,content_path,original_text,description_llm,keywords_llm\r\na,1,text,,"x",d,k\r\n\r\nb,2,text,,y,"d",k\r\n')
    compare(spark, str(path), 2)
    (tmp_path / "none.csv").write_text("id,page,type,content_path,original_text,description_llm,keywords_llm\n")
    compare(spark, str(tmp_path / "none.csv"), 0)
