from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from traitloom.functions import text
from traitloom.sources.lines import cells_of


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_before_and_after(spark):
    assert one(spark, "w[1]x[2]", lambda v: text.before(v, "[")) == "w"
    assert one(spark, "plain", lambda v: text.before(v, "[")) == "plain"
    assert one(spark, "lethal, with \t x[1] ", lambda v: text.after(v, "with")) == "x[1]"
    assert one(spark, "a with b with c", lambda v: text.after(v, "with")) == "b with c"
    assert one(spark, "viable", lambda v: text.after(v, "with")) == ""


def test_tokens_quotes_and_parts(spark):
    assert one(spark, " GO:1 ! name", text.first_token) == "GO:1"
    assert one(spark, "'\"GO:1\"'", text.strip_quotes) == "GO:1"
    assert one(spark, "o'b'c", text.dash_quotes) == "o-b-c"
    assert one(spark, " a , 1,x ", lambda v: text.stripped_parts(v, ",")) == ["a", "1", "x"]
    assert one(spark, "a1b2", lambda v: text.all_matches(v, "[0-9]")) == ["1", "2"]


def test_tag_and_value_split_on_the_first_colon(spark):
    line = "name: a: b"
    assert one(spark, line, text.tag_of) == "name"
    assert one(spark, line, text.value_of) == "a: b"


def test_strip_drops_all_white_space(spark):
    assert one(spark, "　\t 1a1 \x1f\n", text.strip) == "1a1"


CASES = {
    "a\tb": ["a", "b"],
    "\ta\t\t": ["", "a", "", ""],
    '"a\tb"\tc': ["a\tb", "c"],
    'x\t"say ""hi"""\t': ["x", 'say "hi"', ""],
    'in"side\tb': ['in"side', "b"],
    '"a"tail\tb': ["atail", "b"],
    '""\tb': ["", "b"],
}


def test_cells(spark):
    for line, cells in CASES.items():
        assert one(spark, line, cells_of) == cells, line


@settings(max_examples=15, deadline=None)
@given(some.lists(some.lists(some.text('ab" \t', max_size=6), min_size=1, max_size=4), min_size=1, max_size=20))
def test_cells_read_what_a_csv_writer_wrote(spark, rows):
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, delimiter="\t", lineterminator="\n")
    writer.writerows(rows)
    lines = out.getvalue().split("\n")[:-1]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, v string")
    read = df.select("i", cells_of(F.col("v"))).orderBy("i").collect()
    assert [row[1] for row in read] == list(csv.reader(lines, delimiter="\t"))
