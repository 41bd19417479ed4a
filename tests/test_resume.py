"""Resume readers: parallel, and each step worked out once."""

from pyspark.sql import functions as F

from rolecall.catalog import queries
from rolecall.operators.sets import distinct_ignoring_case
from rolecall.plans import resume, resume_text
from rolecall.plans.views import Tables

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def mentions(df, column, mark="MARK"):
    return plan_of(df.select(column.alias("r"))).count(mark)


def test_lists_are_worked_out_once(spark):
    df = spark.createDataFrame([("a",)], "x string")
    lines = F.split("x", "MARK")
    assert mentions(df, distinct_ignoring_case(lines)) == 1
    assert mentions(df, resume_text.read_experience(lines)) == 1
    assert mentions(df, resume_text.read_education(lines, F.lit(2024))) == 1


def test_distinct_ignoring_case(spark):
    rows = [([" Go", "go", "", None, "SQL", "GO ", "Sql", "Rust"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "v array<string>").select(distinct_ignoring_case(F.col("v")).alias("v"))
    assert [r.v for r in df.collect()] == [["Go", "SQL", "Rust"], [], None]


def test_reviews_are_not_filtered_by_their_own_checks(spark):
    from rolecall.catalog.resume import _resumes

    reviewed = resume.review_checks(resume.review_resumes(_resumes(Tables(spark, SMALL))))
    assert "Filter" not in plan_of(reviewed)


def test_customers_of_one_file_are_dealt_to_all_cores(spark):
    for key in ("L12_extract_profile", "L13_extract_sections", "L14_merge_resume", "L15_review_resumes", "L18_layout_blocks"):
        assert "RepartitionByExpression" in plan_of(queries()[key](spark, SMALL)), key


def test_layout_facts_are_read_off_each_resume(spark):
    from rolecall.catalog.resume import _resumes, layout_facts

    resumes = _resumes(Tables(spark, SMALL))
    facts = layout_facts(resumes)
    assert "Generate" not in plan_of(facts)  # rows of blocks would be sorted by resume, over a dozen each
    rows = resume.layout_rows(resumes).groupBy("user_id").count()
    told = facts.join(rows, "user_id").select(F.sum((F.col("blocks") != F.col("count")).cast("int")).alias("wrong"), F.count("*").alias("n")).first()
    assert told.wrong == 0 and told.n == resumes.count()


def test_keyword_gap_reads_only_jobs_and_resumes_of_a_pair(spark):
    plan = plan_of(queries()["L17_keyword_gap"](spark, SMALL))
    assert plan.count("LeftSemi") == 2


def test_mentions_of_odd_keywords(spark):
    rows = [("c++ and go", "C++", True), ("c++ and go", "C", False), ("golang", "Go", False), ("use go.", "Go", True), ("asp.net", ".Net", False), ("", "Go", False), (None, "Go", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, k string, e boolean")
    found = df.select("e", resume._mentions(F.col("t"), F.col("k")).alias("m")).collect()
    assert [r.m for r in found] == [r.e for r in found]
