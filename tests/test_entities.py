from pyspark.sql import functions as F

from larkspur.functions import text


def test_words_of_all_scripts(spark):
    cases = {
        "see docs/été.py and Été.Py, café/naïve.md": ["docs/été.py", "café/naïve.md"],
        "éFastApi FastApi NextJsé and Grüße New York": ["FastApi", "New York"],
        "@été/pkg-ß x@a/b": ["@été/pkg-ß", "@a/b"],
        "Python 3.12é Python 3.13 v1.2é v2.0.1": ["Python 3.13", "v2.0.1"],
        "https://bücher.example x http://a.b/c http://local HTTP://A.B http://A.B": ["bücher.example", "a.b"],
        "": [],
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want array<string>")
    for r in rows.select("t", "want", text.entities(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_first_spellings_in_order(spark):
    one = spark.createDataFrame([(["B", "a", "b", "A", "c"],), ([],)], "x array<string>")
    assert [r.y for r in one.select(text.distinct_ignoring_case(F.col("x")).alias("y")).collect()] == [["B", "a", "c"], []]
