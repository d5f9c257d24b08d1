import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import hashing, text, usage

LETTERS, OPTIONS = list("ABCD"), ["Speeding up", "Merging left", "Add a lane", "Waiting"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("reply", "letter", "method"),
    [
        # one or more for each step of SURVEY 2.9.1, in its order
        (None, None, "unparseable"),
        ("  \n ", None, "unparseable"),
        ("<think>A, surely A</think>", None, "unparseable"),
        ("answer: d", "D", "answer_tag"),
        ("Answer: B. On reflection, answer: D", "D", "answer_tag"),
        ("<think>Answer: A</think> So, Answer: B", "B", "answer_tag"),
        ("Answer: C" + " and so on" * 60, "C", "first_letter"),
        (r"we get \boxed{B} here", "B", "boxed"),
        ("(C).", "C", "sole_letter"),
        ("It rained all day\nso the road is wet\nD.", "D", "final_line"),
        ("the car is merging left now", "B", "option_text"),
        ("merging left or waiting", None, "ambiguous"),
        ("my pick would be C here", "C", "first_letter"),
        ("B or else D", None, "ambiguous"),
        ("no idea at all", None, "unparseable"),
        # the letter needs no boundary after it
        ("Answer: Add a lane", "A", "answer_tag"),
    ],
)
def test_extraction(spark, reply, letter, method):
    a = lambda xs: F.array(*[F.lit(x) for x in xs])
    got = one(spark, reply, lambda c: text.extracted(c, a(LETTERS), a(OPTIONS)))
    assert (got["letter"], got["method"]) == (letter, method)
    if method == "ambiguous":
        assert got["candidates"] == ["B", "D"]


def test_letter_that_is_no_option(spark):
    a = lambda xs: F.array(*[F.lit(x) for x in xs])
    assert one(spark, "Answer: G", lambda c: text.extracted(c, a("AB"), a(OPTIONS[:2])))["letter"] is None


@pytest.mark.parametrize(
    ("question", "letters", "options"),
    [
        ("What next? Please select the correct answer from the following options: A. Back up. B. Drive on. C. Brake.", "ABC", ["Back up", "Drive on", "Brake"]),
        ("Pick one: A. go B. stop", "AB", ["go", "stop"]),
        ("Pick one: A. go B. stop D. wait", "AB", ["go", "stop D. wait"]),
        ("No options here.", "", []),
        ("B. first A. second", "", []),
        ("A.  B. stop", "", []),
        ("", "", []),
    ],
)
def test_split(spark, question, letters, options):
    got = one(spark, question, text.split_question)
    assert ("".join(got["letters"]), got["option_texts"]) == (letters, options)


@pytest.mark.parametrize(("answer", "letter"), [("B", "B"), ("C. Back up", "C"), ("add a LANE!", "C"), ("Reverse", None), ("", None), ("E", None)])
def test_gold(spark, answer, letter):
    a = lambda xs: F.array(*[F.lit(x) for x in xs])
    assert one(spark, answer, lambda c: text.gold_letter(c, a(LETTERS), a(OPTIONS))) == letter


def test_tags(spark):
    stem = "What is  <c1,CAM_FRONT,1.5,2.0> near <c2, CAM_BACK, 3,4>?"
    assert one(spark, stem, text.strip_tags) == "What is the referenced object near the referenced object?"
    assert one(spark, stem, text.cameras) == ["CAM_FRONT", "CAM_BACK"]
    assert one(spark, "none", text.cameras) == ["CAM_FRONT"]
    assert one(spark, "a <c1,CAM_FRONT,x> b  c", text.template) == "a <OBJ> b c"


def test_counterbalance(spark):
    df = spark.range(3).select(text.counterbalanced(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit("y"), F.col("id")).alias("o"))
    assert [r["o"] for r in df.collect()] == [["y", "x", "z"], ["x", "y", "z"], ["x", "z", "y"]]


def test_usage(spark):
    payload = '{"usage":{"prompt_tokens":9,"completion_tokens":295,"total_tokens":304,"completion_tokens_details":{"reasoning_tokens":182},"prompt_tokens_details":{"cached_tokens":0}},"choices":[{"message":{"content":"","reasoning_content":"because"}}]}'
    got = one(spark, payload, usage.extracted)
    assert (got["prompt_tokens"], got["completion_tokens"], got["reasoning_tokens"], got["cached_prompt_tokens"], got["reasoning_tokens_reported"]) == (9, 295, 182, 0, True)
    assert one(spark, payload, usage.reply)["text"] == "because"
    assert one(spark, "{}", usage.extracted)["reasoning_tokens_reported"] is False


def test_question_id(spark):
    import hashlib
    import json

    parts = ['q"uote', "tab\t", "né"]
    want = hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]
    df = spark.createDataFrame([tuple(parts)], "a string, b string, c string")
    assert df.select(hashing.question_id(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want
