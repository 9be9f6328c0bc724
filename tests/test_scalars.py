import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as f
from quillmill.functions.calculator import calculate_one
from quillmill.sources import files as io


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("0.1 + 0.2", "0.3"), ("2**10", "1024"), ("7 // 2", "3"), ("(1 + 2) * 3", "9"), ("-3 + 1", "-2"), ("1 << 4", "16"), ("6 & 3", "2"), ("6 ^ 3", "5"), ("~5", "-6"), ("5 % 3", "2"),
        ("12345678901234567890 * 10", "123456789012345678900"), ("1/4", "0.25"), ("10 - 10", "0"), ("100 * 1.0", "100"),
    ],
)
def test_calculate(expression, expected):
    assert calculate_one(expression) == (expected, None)


@pytest.mark.parametrize("expression, reason", [("1/0", "division by zero"), ("1 +", "syntax"), ("1.5 & 1", "bit operators need integers"), ("abs(1)", "not an arithmetic expression"), ("", "empty"), (None, "empty"), ("9**99999", "exponent too large"), ("5 % 0", "InvalidOperation")])
def test_calculate_errors(expression, reason):
    assert calculate_one(expression) == (None, reason)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_sentences_and_overlap(spark):
    s = F.col("t")
    assert one(spark, f.sentences(s), t="See e.g. this. Then 3 more! 好。对") == ["See e.g. this.", "Then 3 more!", "好。", "对"] or one(spark, f.sentences(s), t="See e.g. this. Then 3 more! 好。对") == ["See e.g. this.", "Then 3 more! 好。", "对"]
    assert one(spark, f.overlap_suffix(s, 4), t="One two three. Four five. six.") == "Four five." or one(spark, f.overlap_suffix(s, 5), t="One two three. Four five. six.") == "Four five. six."
    assert one(spark, f.overlap_suffix(s, 2), t="abcde fgh ijk lmn.") == "lmn."
    assert one(spark, f.split_long_text(s, 3), t="a b c d") == ["a b c", "d"]
    assert one(spark, f.has_cjk(s), t="a中") and not one(spark, f.has_cjk(s), t="a")


def test_tags(spark):
    tagged = f.append_tool_tags(F.col("t"), F.array(F.lit("a p.1")), F.lit(True))
    assert one(spark, tagged, t="x") == "x\n[calculated]\n[sources: a p.1]"
    assert one(spark, f.strip_known_tags(tagged), t="x") == "x" and one(spark, f.strip_known_tags(F.col("t")), t="[calculated]") == ""


def test_expression_and_ids(spark):
    assert one(spark, f.normalize_expression(F.col("t")), t="$1,234,567 + 5%") == "1234567 + (5/100)"
    assert one(spark, f.parse_chunk_id(F.col("t")), t="b/x.pdf/pNone/0007").asDict() == {"book_id": "b", "source_file": "x.pdf", "page": None, "seq": 7}
    assert one(spark, f.parse_chunk_id(F.col("t")), t="junk").seq is None


def test_files(spark, tmp_path):
    for n in ("b.PDF", "a.txt", "c.xyz"):
        (tmp_path / n).write_text(n)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_text("d")
    assert [r["filename"] for r in io.read_corpus_files(spark, [str(tmp_path)]).collect()] == ["b.PDF"]
    cases = tmp_path / "cases.jsonl"
    cases.write_text('{"id": "1", "type": "calc", "question": "q"}\n\n{"id": "2", "type": "noop", "question": "r"}\n')
    assert io.read_cases_jsonl(spark, str(cases)).count() == 2
    io.write_result_csv(spark.createDataFrame([("1", "calc", 9)], "id string, type string, extra int"), str(tmp_path / "out"))
    assert "extra" not in spark.read.csv(str(tmp_path / "out"), header=True).columns
    assert io.read_manifest(spark, str(tmp_path / "none")).count() == 0
