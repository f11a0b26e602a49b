import pytest
from pyspark.sql import functions as F

from termwise.operators import conversation, questions
from termwise.operators.conversation import recent_transcript

ROUTES = [
    ("Tell me the graduation rate among 2020 entrants", False, "sql"),
    ("Does the pdf say who is kept?", False, "rag"),
    ("Which caveats are mentioned in the annex?", False, "rag"),
    ("Please summarise what I sent you", False, "rag"),
    ("Per the report, how is the graduation rate worked out?", False, "both"),
    ("and then?", False, "clarify"),
    ("and then?", True, "clarify"),
    ("Would you go into a little more of that one point?", False, "sql"),
    ("Would you go into a little more of that one point?", True, "rag"),
    ("please chart those numbers", True, "sql"),
    ("visualise", False, "sql"),
    ("  one\t two \n three  ", False, "clarify"),
]


def test_route(spark):
    df = spark.createDataFrame(ROUTES, "question string, documents boolean, expected string")
    for r in questions.route_questions(df, F.col("documents")).collect():
        assert r["route"] == r["expected"], r


RESOLVED = [
    ("Degrees completed last year, by school", "202490", " (most recent cohort_year: 2023)"),
    ("Pell share, current year", "202490", " (current cohort_year: 2024)"),
    ("How did retention move last semester", "202490", " (previous major term: 202410, Spring 2024)"),
    ("against the previous term", "202410", " (previous major term: 202390, Fall 2023)"),
    # Summer has no major term of its own to step back from.
    ("last semester then", "202450", " (previous major term: 202450, Summer 2024)"),
    ("headcount for the current term", "202490", " (current term: 202490, Fall 2024)"),
    ("attrition, PAST 4 years", "202490", " (cohort_years 2020-2024)"),
    ("were recent cohorts better", "202490", " (data available through: 202490, Fall 2024)"),
    ("of the 2017 entrants, who was here in Spring 2021?", "202490", ""),
    ("past year against this semester", "202477", " (most recent cohort_year: 2023) (current term: 202477, Unknown 2024)"),
]


@pytest.mark.parametrize("term", sorted({r[1] for r in RESOLVED}))
def test_resolve(spark, term):
    asked = spark.createDataFrame([(q, q + added) for q, t, added in RESOLVED if t == term],
                                  "question string, expected string")
    data = spark.createDataFrame([("201510",), (term,)], "term_code string")
    for r in questions.resolve_terms(asked, data).collect():
        assert r["resolved"] == r["expected"]


CHARTS = [
    ("Plot degrees per school", True), ("I want a chart of attrition", True),
    ("graph credits against gpa", True), ("Visualize headcount", True),
    ("Tell me the rate among 2020 entrants", False), ("Where does the data lineage chart live?", False),
    ("Draw the dependency graph of the models", False), ("Would a knowledge graph help?", False),
    ("What is the chart of cohorts supposed to mean?", False), ("What does that graph measure", False),
    ("Do you see any trend?", False), ("headcount trends by semester", True),
    ("attrition trend over time, please", True), ("By term, are there trends?", True),
]


def test_chart_intent(spark):
    df = spark.createDataFrame(CHARTS, "question string, expected boolean")
    for r in questions.chart_intent(df).collect():
        assert r["wants_chart"] is r["expected"], r


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(
        [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(30)] + [(2, 0, "system", "hello")],
        "conv_id long, turn long, role string, text string")


def test_window_keeps_the_last_twenty(messages, rows):
    kept = conversation.last_messages(messages).filter("conv_id = 1").select("turn")
    assert sorted(r[0] for r in kept.collect()) == list(range(10, 30))


def test_roles(messages):
    got = {r["role"] for r in conversation.api_roles(messages).filter("conv_id = 2").collect()}
    assert got == {"model"}


def test_transcript(messages):
    got = {r["conv_id"]: (r["transcript"], r["n_messages"]) for r in recent_transcript(messages).collect()}
    assert got[1] == ("user: m24\nassistant: m25\nuser: m26\nassistant: m27\nuser: m28\nassistant: m29", 6)
    assert got[2] == ("system: hello", 1)


def test_context_is_optional(spark, messages):
    asked = spark.createDataFrame([(2, "and now?"), (3, "first")], "conv_id long, question string")
    got = {r["conv_id"]: r["question_in_context"] for r in conversation.with_context(asked, messages).collect()}
    assert got == {2: "Said before:\nsystem: hello\n\nNow asked: and now?", 3: "first"}


def test_rank_is_cut_before_the_shuffle(messages):
    plan = conversation.last_messages(messages)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange", 1)[1]
