"""Accept and reject tables for the text readers."""

import pytest
from pyspark.sql import functions as F

from rolecall.functions import classify, display_text, salary, text
from rolecall.functions.experience import parse_experience
from rolecall.plans import suggest


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["r"] for r in df.select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()]


def test_salary_accepts(spark):
    cases = {
        "Compensation: ₹12,00,000 – ₹18,00,000 a year": (1_200_000, 1_800_000),
        "the pay range is INR 20L to 30L": (2_000_000, 3_000_000),
        "CTC 8 - 12 LPA": (800_000, 1_200_000),
        "budget of Rs. 1.5 - 2 Cr": (15_000_000, 20_000_000),
        "Salary of ₹9 LPA": (900_000, 900_000),
        # The monthly figure is passed over, the yearly one taken.
        "salary ₹40,000 - ₹50,000 per month, which is a package of 5 - 6 LPA": (500_000, 600_000),
        # No believable range, but its upper end stands by itself.
        "CTC 1 - 9 LPA": (900_000, 900_000),
        "Stipend is nil. Fixed pay " + "x" * 140 + " 7-9 LPA": (700_000, 900_000),
    }
    got = column(spark, list(cases), salary.parse_inr_salary)
    assert [tuple(b) if b else None for b in got] == list(cases.values())


def test_salary_rejects(spark):
    cases = [
        "we moved ₹10 - 20 crore last year",
        "salary ₹500 - ₹600 per hour",
        "salary 25 - 35",
        "salary " + "x" * 200 + " 7-9 LPA",  # too far away
        "CTC 30,000 - 40,000 INR",  # below any yearly pay
        "",
    ]
    assert column(spark, cases, salary.parse_inr_salary) == [None] * len(cases)


@pytest.mark.parametrize(
    "title, body, want",
    [
        ("SRE (2-4 yrs)", "", (2, 4)),
        ("Dev", "You bring at least three years of Java experience.", (3, None)),
        ("Dev", "Requirements: 5 to 8 years' experience", (5, 8)),
        ("Dev", "Experience\n- 4 - 6 yrs", (4, 6)),
        ("Dev", "up to 2 years experience", (0, 2)),
        ("Dev", "between 3 and 5 years of experience", (3, 5)),
        ("Dev", "a 4-year degree. 6+ years experience", (6, None)),
        ("Fresher developer", "", (0, 1)),
        ("Dev", "Freshers can also apply", (0, 1)),
        ("Dev", "Freshers need not apply. No freshers please", None),
        ("Dev", "Founded 12 years ago", None),
        ("Dev", "With 20 years of experience, we build ships", None),
        ("Dev", "2 years of warranty and experience", None),
        ("Dev", "9 - 3 years of experience", None),
    ],
)
def test_experience(spark, title, body, want):
    row = spark.createDataFrame([(title, body)], "a string, t string").select(parse_experience(F.col("a"), F.col("t")).alias("r")).first()
    assert (row["r"]["min"], row["r"]["max"]) == (want or (None, None))


def test_experience_column(spark):
    df = spark.createDataFrame([("a", "3 years experience"), ("b", "nothing"), ("c", None)], "a string, t string")
    got = df.select(parse_experience(F.col("a"), F.col("t")).alias("r")).collect()
    assert [(r["r"]["min"], r["r"]["max"]) for r in got] == [(3, None), (None, None), (None, None)]


def test_places(spark):
    rows = [
        (["Bangalore • Remote, US | Poona"], None, (["Bengaluru"], False)),
        (["Remote - India"], None, ([], True)),
        (["Vapi, Gujarat"], None, (["Vapi"], False)),
        (["Lahore, Punjab, Pakistan"], None, None),
        (["India"], "REMOTE", ([], True)),
        (["Remote, Worldwide"], "REMOTE", None),
        (["Pune or Mumbai; Pune"], None, (["Pune", "Mumbai"], False)),
        ([], None, None),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, l array<string>, w string")
    got = df.select("i", classify.india_location(F.col("l"), F.col("w")).alias("r")).orderBy("i").collect()
    assert [(list(r["r"]["cities"]), r["r"]["remote"]) if r["r"] else None for r in got] == [r[2] for r in rows]


def test_disciplines_and_levels(spark):
    titles = {
        "Senior Security Engineer": ("SECURITY", "SENIOR", "FULL_TIME"),
        "Site Reliability Engineer II": ("INFRASTRUCTURE", "MID", "FULL_TIME"),
        "Mechanical Design Engineer": (None, "MID", "FULL_TIME"),
        "Embedded Software Engineer, Manufacturing": ("ENGINEERING", "MID", "FULL_TIME"),
        "Account Executive": (None, "MID", "FULL_TIME"),
        "Engineering Manager": ("ENGINEERING", "MANAGER", "FULL_TIME"),
        "Product Manager": ("PRODUCT", "MID", "FULL_TIME"),
        "Design Intern (Contract)": ("DESIGN", "INTERN", "INTERNSHIP"),
        "SDE I": ("ENGINEERING", "JUNIOR", "FULL_TIME"),
        "Freelance UX Designer": ("DESIGN", "MID", "CONTRACT"),
    }
    none = F.lit(None).cast("string")
    assert column(spark, list(titles), lambda t: classify.classify_discipline(t, none)) == [v[0] for v in titles.values()]
    assert column(spark, list(titles), classify.classify_level) == [v[1] for v in titles.values()]
    assert column(spark, list(titles), classify.classify_employment_type) == [v[2] for v in titles.values()]


def test_tags(spark):
    df = spark.createDataFrame(
        [
            ("Go Developer", "Go and Rust. We go fast, swift and rust free."),
            ("React Native Engineer", "React Native, React, React"),
            ("x", "SQL Server and SQL"),
            ("x", "postgres, Postgresql, dotnet, .NET"),
            ("Senior .net developer", "ASP.net and .Net Core."),
            ("x", "An internet of things, .network and planet"),
        ],
        "a string, t string",
    )
    got = [r["r"] for r in df.select(classify.extract_tags(F.col("a"), F.col("t")).alias("r")).collect()]
    assert got == [["Go", "Rust"], ["React Native", "React"], ["SQL", "SQL Server"], ["PostgreSQL", ".NET"], [".NET"], []]


def test_html(spark):
    html = [
        "<p>A &amp;lt; B &#8377;5 &#x41;</p><ul><li>one</li>\n\n<li> two</li></ul>",
        "<h3> Big <b>news</b> </h3>text<br>next",
        "<script>x < y</script><style>p{}</style>kept",
        "&unknown; stays",
    ]
    assert column(spark, html, text.html_to_text) == [
        "A &lt; B ₹5 A\n\n- one\n- two",
        "## Big news\n\ntext\nnext",
        "kept",
        "&unknown; stays",
    ]


def test_slugs_and_keys(spark):
    assert column(spark, ["Crème & Brûlée — Ltd.", "  --x--  "], text.slugify) == ["creme-brulee-ltd", "x"]
    assert column(spark, ["Node.js & C++.", "Développeur C#"], text.normalize_text) == ["node.js and c++", "developpeur c#"]
    assert column(spark, ["Sr. Software Engineer II - Bangalore"], classify.dedupe_title_key) == ["senior software engineer 2"]
    assert column(spark, ["Sr. SDE (Contract) - Pune", "Product Designer, Payouts"], suggest.suggest_title_key) == [
        "senior sde",
        "product designer payouts",
    ]
    assert column(spark, ["Backend Engineer - Core, Remote - India", "Data [x] Lead | Mumbai"], suggest.clean_title) == [
        "Backend Engineer - Core",
        "Data Lead",
    ]


def test_small_formats(spark):
    assert column(spark, ["https://a.b/c?x=1", "http://A.b:8/", "junk"], display_text.safe_referrer) == ["a.b/c", "a.b:8/", None]
    long = "word " * 20
    assert column(spark, [long, "short"], lambda t: display_text.truncate_words(t, 30)) == ["word word word word word…", "short"]
    amounts = ["18", "18 LPA", "₹18,00,000", "1.2 Cr", "900", "a lot"]
    assert column(spark, amounts, salary.parse_inr_amount) == [1_800_000, 1_800_000, 1_800_000, 12_000_000, None, None]


def test_printed_lines_keep_every_character_of_their_rule(spark):
    lines = ["ﬁne ½ … №5 ⑩ ﬁﬁ", "plain", "", None, "😀 a\tb ｆｕｌｌ → 🄐 x", "é́ 中 ⒇."]
    want = [
        None if line is None else "".join(text._PRINT_MANY.get(c, c) for c in line.translate(str.maketrans("\t" + text._PRINT_FROM, " " + text._PRINT_TO)))
        for line in lines
    ]
    want = [None if line is None else "".join(c for c in line if " " <= c <= "~") for line in want]
    assert column(spark, lines, text.printable) == want


def test_printing_looks_up_no_plain_character(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(text.printable(F.col("t")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_special_characters_are_tried_as_few_ranges(spark):
    assert text._PRINT_SPECIAL.count("-") * 3 < len(text._PRINT_MANY)
    chars = sorted(text._PRINT_MANY)
    assert column(spark, ["".join(chars)], lambda t: F.regexp_extract_all(t, F.lit(text._PRINT_SPECIAL), F.lit(0))) == [chars]


def test_skills_that_no_text_names_cost_no_struct(spark):
    df = spark.createDataFrame([("SQL and data", "Kafka, SQL"), ("", ""), (None, None)], "a string, b string")
    found = df.select(classify.extract_tags(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in found.collect()] == [["SQL", "Kafka"], [], []]
    assert " ELSE 0 " not in found._jdf.queryExecution().optimizedPlan().toString()


def test_experience_compiles_no_pattern_per_value(monkeypatch):
    """`split` compiles its pattern for every value unless it is one plain character."""
    from rolecall.functions import experience

    patterns = []
    keep = F.split
    monkeypatch.setattr(experience.F, "split", lambda text, pattern, *limit: patterns.append(pattern) or keep(text, pattern, *limit))
    experience.parse_experience(F.col("title"), F.col("text"))
    assert patterns and all(len(p) == 1 for p in patterns)
