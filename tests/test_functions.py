import pytest
from pyspark.sql import functions as F

from weftline.functions import citations as C
from weftline.functions import grading as G
from weftline.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v])).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("see Section 318 of it", ["Section 318"]), ("Sec. 173 and §420 or § 421", ["Sec. 173", "§420", "§ 421"]), ("धारा 154 के", ["धारा 154"]), ("Section 66A", ["Section 66A"]),
        ("section 318(4)(b)", ["section 318(4)(b)"]), ("Sections 34 and 120B", ["Sections 34"]), ("this section is important", []), ("dissection 42", []), ("Section 34IPC", []), ("Article 21", ["Article 21"]), (None, []),
    ],
)
def test_citations(spark, text, want):
    assert one(spark, C.extract("t"), t=text) == want


@pytest.mark.parametrize("words, want", [("seven", "7"), ("twenty five", "25"), ("five thousand", "5000"), ("2 lakh", "200000"), ("twenty five lakh rupees", "2500000 rupees"), ("twenty fifteen", "20 15"), ("one two", "1 2"), ("seven eleven crore", "7 110000000"), ("", "")])
def test_fold_numerals(spark, words, want):
    assert one(spark, F.array_join(T.fold_numerals(T.split_words("t")), " "), t=words) == want


@pytest.mark.parametrize("word, want", [("penalties", "penalty"), ("killing", "kill"), ("ed", "ed"), ("class", "class"), ("dies", "die"), ("reportedly", "report"), ("boxes", "box"), ("cats", "cat"), ("सजाs", "सजाs"), ("1234s", "1234"), ("red", "red"), ("caress", "caress"), ("bed", "bed")])
def test_stem(spark, word, want):
    assert one(spark, T.stem(F.col("t")), t=word) == want


def test_strict_normal(spark):
    assert one(spark, T.strict_normal("t"), t="Pay 10,00,000 within Seven days; §5(2)") == "pay 1000000 within 7 days section 5(2)"
    assert one(spark, T.strict_normal("t"), t="भारतीय संहिता।") == "भारतीय संहिता"


@pytest.mark.parametrize(
    "fact, response, strict",
    [
        ("Section 103(2) alpha act", "Under section 103(2) of the Alpha Act you may", True), ("Section 103 alpha", "section 1031 alpha", False), ("Section 103 alpha", "section 103A alpha", False),
        ("Section 5 beta", "Section 5 of alpha", False), ("up to 7 years", "imprisonment of up to seven years", True), ("two days", "within 3 days", False),
    ],
)
def test_fact_present(spark, fact, response, strict):
    assert one(spark, G.fact_present("f", "r"), f=fact, r=response) is strict


@pytest.mark.parametrize(
    "fact, response, score",
    [
        ("imprisonment up to 10 years", "imprisonment that extends to 10 years", 1.0), ("imprisonment up to 10 years", "imprisonment up to 3 years", 0.0), ("pay fine quickly today please", "paying fine quickly today", 0.8),
        ("the of", "anything", 0.0), ("Section 9 alpha", "Section 9 alpha", 1.0), ("five thousand rupees", "Rs. 5,000", 1.0),
    ],
)
def test_score_fact(spark, fact, response, score):
    got = one(spark, G.score_fact("f", "r", stopwords=(*T.STOPWORDS, "up", "that")), f=fact, r=response)
    assert got["score"] == pytest.approx(score)


def test_record_columns(spark):
    df = spark.createDataFrame([(["Section 9 alpha", "pay the fine"], ["jail for life"], "Section 9 alpha says: pay the fine"), ([], [], "x"), (["pay the fine"], ["pay the fine"], "pay the fine")], "q array<string>, b array<string>, r string")
    rows = df.select(*[c.alias(k) for k, c in G.record_columns("q", "b", "r").items()]).collect()
    assert [r["fact_recall"] for r in rows] == [1.0, 0.0, 0.0]
    assert [r["all_facts"] for r in rows] == [True, False, False]
    assert (rows[0]["citation_recall"], rows[1]["citation_recall"], rows[1]["substance_recall"]) == (1.0, None, None)


def test_judge_and_lint(spark):
    df = spark.createDataFrame([(["a fine"], ["jail"], "You pay a fine under Section 4.", "qa"), (["a fine"], [], "I must decline", "safety_abstention")], "q array<string>, b array<string>, r string, t string")
    a, b = df.select(*[c.alias(k) for k, c in G.judge_columns("q", "b", "r", "t").items()]).collect()
    assert a["auto_strict_correct"] and a["extracted_citations"] == ["Section 4"] and not a["abstained"]
    assert b["abstained"] and b["is_safety_row"] and not b["auto_strict_correct"] and b["required_facts_missing"] == ["a fine"]
    assert one(spark, G.lint("f"), f="12") == ["bare number"]
    assert one(spark, G.lint("f"), f="the") == ["empty"]
    assert one(spark, G.lint("f"), f="Section 4 must apply") == []
    assert one(spark, G.lint("f"), f="you must pay it all right now or else lose everything") == ["too long", "proposition"]


def test_resolution(spark):
    statutes = spark.createDataFrame([("alpha_2023", "9"), ("beta_2019", "5"), ("guidance", "tips")], "act_id string, section string")
    mappings = spark.createDataFrame([("OLD", "7", "ALPHA", "9")], "old_act string, old_section string, new_act string, new_section string")
    far = "x " * 100
    texts = {1: "Section 9 of the alpha act", 2: f"The beta code helps. {far} Under Section 5 you may", 3: "Section 9 alpha and Section 5 beta", 4: "Section 99 alpha", 5: "no law", 6: "Section 7 old code", 7: f"alpha and beta. {far} Section 9"}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    strict = {r["id"]: r["verified"] for r in C.verify(df, "id", "t", C.whitelist(statutes)).collect()}
    assert strict == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False}
    lax = {r["id"]: r["verified"] for r in C.verify(df, "id", "t", C.whitelist(statutes, mappings)).collect()}
    assert lax[6]
    refs = C.reference_keys(df, "id", "t", statutes, mappings).collect()
    assert {(r["id"], r["ref"]) for r in refs} == {(1, "alpha_2023:9"), (2, "beta_2019:5"), (3, "alpha_2023:9"), (3, "beta_2019:5"), (6, "alpha_2023:9"), (7, "alpha_2023:9")}


def test_ambiguous_numbers(spark):
    statutes = spark.createDataFrame([("alpha_2023", "9"), ("beta_2019", "9")], "act_id string, section string")
    none = spark.createDataFrame([], "old_act string, old_section string, new_act string, new_section string")
    df = spark.createDataFrame([(1, "Section 9 please", None), (2, "Section 9 please", "dom"), (3, "Section 9 on cheques", None)], "id int, t string, d string")
    idf = spark.createDataFrame([("cheques", 2.0), ("on", 0.1)], "token string, idf double")
    posts = spark.createDataFrame([("beta_2019:9", "cheques"), ("alpha_2023:9", "on"), ("beta_2019:9", "on")], "ref string, token string")
    got = C.reference_keys(df, "id", "t", statutes, none, idf=idf, postings=posts, domain="d", domain_acts={"dom": ("alpha_2023",)}).collect()
    assert {(r["id"], r["ref"]) for r in got} == {(2, "alpha_2023:9"), (3, "beta_2019:9")}


def test_small_functions(spark):
    assert one(spark, T.before_last("t", "_s"), t="a_s1_s2") == "a_s1"
    assert one(spark, T.before_last("t", "_"), t="plain") == "plain"
    assert one(spark, G.mcq_letter("t"), t="it is (c).") == "C"
    assert one(spark, G.mcq_letter("t"), t="none") is None
    assert one(spark, G.unique_match("t", "([0-9]+) days"), t="5 days or 5 days") == "5"
    assert one(spark, G.unique_match("t", "([0-9]+) days"), t="5 days or 6 days") is None
    assert one(spark, G.script_matches("l", "t"), l="hindi", t="abc") is False
    assert one(spark, T.unit_vector("v"), v=[3.0, 4.0]) == [0.6, 0.8] and one(spark, T.unit_vector("v"), v=[0.0]) == [0.0]
    assert one(spark, T.jaccard(T.split_words("a"), T.split_words("b")), a="x y", b="") == 0.0
    assert one(spark, C.within_context("t", "k"), t="Section 4 and Section 5", k=["alpha:4"]) is False


def test_reference_similarity_normalises_each_text_once(spark):
    from weftline.functions.text import reference_similarity

    df = spark.createDataFrame([("a two b", "a 2 c"), ("Same, text", "Same, text"), (", ,", ", ,"), ("x", None), ("", "y")], "a string, b string")
    got = df.select(reference_similarity("a", "b").alias("s"))
    assert [r["s"] for r in got.collect()] == [0.5, 1.0, 0.0, 0.0, 0.0]
    # twice where the texts differ, once where they are equal
    assert got._jdf.queryExecution().analyzed().toString().count("lower(") <= 3


def test_texts_are_not_shuffled_for_reference_keys(spark):
    from weftline.functions import citations as C

    df = spark.createDataFrame([(1, "Section 3 alpha, Section 4 of the old code, Section 3 alpha")], "id int, t string")
    statutes = spark.createDataFrame([("alpha_2023", "3"), ("alpha_2023", "5")], "act_id string, section string")
    mappings = spark.createDataFrame([("OLD", "4", "ALPHA", "5")], "old_act string, old_section string, new_act string, new_section string")
    refs = C.reference_keys(df, "id", "t", statutes, mappings)
    assert sorted((r["ref"], r["ord"]) for r in refs.collect()) == [("alpha_2023:3", 1), ("alpha_2023:5", 2)]
    plan = refs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    physical = refs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert sum("hashpartitioning(id" in line for line in physical.splitlines()) == 1
