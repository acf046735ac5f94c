import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bindery.functions import codes, dates, isbn, keys, register, text


def values(spark, make, given):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    return [r["v"] for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


DATES = [
    ("2013-10-31", "2013-10-31", False), ("2013-1-5", "2013-01-05", False), ("2013-10", "2013-10-01", True), ("2013", "2013-01-01", True), ("2013/10/31", "2013-10-31", True), ("2013-02-30", None, False),
    ("1 de enero de 2013", "2013-01-01", False), ("31st October 2013", "2013-10-31", False), ("July 2013", "2013-07-01", True), ("2013 July", "2013-07-01", True), ("January 7, 2025", "2025-01-07", False),
    ("Marketing 2013", "2013-03-01", True), ("abr 2013", None, False), ("", None, False), (None, None, False), ("31 February 2013", None, False), ("0000", None, False), ("  2013 ", "2013-01-01", True),
]


def test_dates(spark):
    found = values(spark, dates.parse_date, [d[0] for d in DATES])
    assert [(r["iso"], r["partial"]) for r in found] == [d[1:] for d in DATES]


def test_dates_compat_rejects_month_day_year(spark):
    assert values(spark, lambda c: dates.parse_date(c, compat=True)["iso"], ["January 7, 2025", "7 January 2025"]) == [None, "2025-01-07"]


def test_currency(spark):
    cases = {"EUR": "EUR", "eur": "EUR", "usd.": "USD", "$": "USD", "€12.34": "EUR", "R$": "BRL", "R$ 5": "USD", "12 EUR each": "EUR", "XXX": None, "": None, " ": None, None: None, "¥": "JPY"}
    assert values(spark, codes.normalize_currency, cases) == list(cases.values())


def test_language(spark):
    cases = {"EN": "en", "en-us": "en-US", "pt-br": "pt-BR", "english": "english", "zh-Hans": "zh-Hans", "e": "e", "": None, None: None}
    assert values(spark, codes.normalize_language, cases) == list(cases.values())
    assert values(spark, codes.valid_language, ["en", "en-US", "english", "zh-Hans", "e", None]) == [True, True, False, True, False, False]


def test_price(spark):
    cases = {"12,50": 12.5, "1.234,56": None, "-3": -3.0, "€ 9.99": 9.99, "": None, None: None, "abc": None}
    assert values(spark, codes.parse_price, cases) == list(cases.values())


def test_isbn(spark):
    given = ["0-306-40615-2", "080442957x", "9780306406157", "9780306406158", "0306406153", "", None]
    assert [tuple(r) for r in values(spark, isbn.normalize, given)] == [("0306406152", "9780306406157"), ("080442957X", "9780804429573"), (None, "9780306406157"), *[(None, None)] * 4]


def test_isbn_extract(spark):
    given = ["ISBN 0306406152.", "9780306406157; 0-306-40615-2", "0306406152 9780306406157", "x0306406152", None, "1234567890"]
    assert values(spark, isbn.extract, given) == [["0306406152", "9780306406157"], ["0306406152", "9780306406157"], ["9780306406157"], [], [], []]


def _isbn10(core: str) -> str:
    rest = (11 - sum((10 - i) * int(d) for i, d in enumerate(core)) % 11) % 11
    return core + ("X" if rest == 10 else str(rest))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(0, 10**9 - 1), min_size=20, max_size=20))
def test_isbn10_converts_to_valid_13(spark, cores):
    tens = [_isbn10(f"{c:09d}") for c in cores]
    assert all(values(spark, lambda c: isbn.is_valid10(c) & isbn.is_valid13(isbn.to13(c)), tens))


def test_main_title(spark):
    cases = {"A: B - C": "a", "A - B: C": "a   b", "Ünï — cödé": "uni", "A—B": "a", "A-B": "a", "Numsense! Data": "numsense  data", "Straße": "stra e", "": None, None: None, " :x": None}
    assert values(spark, text.main_title, cases) == list(cases.values())


def test_nfkd_fold(spark):
    assert values(spark, text.fold_nfkd, ["ﬁn é", None]) == ["fin e", None]


def test_whitespace_and_blank(spark):
    assert values(spark, text.normalize_whitespace, [" a  \tb ", "  ", None]) == ["a b", None, None]
    assert values(spark, text.nonblank, [" a ", "\t ", None]) == [" a ", None, None]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="aEé \t-x", max_size=12), min_size=10, max_size=10))
def test_idempotent(spark, given):
    for f in (text.normalize_whitespace, codes.normalize_language, codes.normalize_currency):
        once = values(spark, f, given)
        assert values(spark, f, once) == [x or None for x in once]


def test_lists(spark):
    assert values(spark, text.listify, ["a, b;a;;", "", None]) == [["a", "b", "a"], [], None]
    assert values(spark, lambda c: text.distinct_in_order(text.listify(c)), ["b,a,b"]) == [["b", "a"]]


def test_ratings(spark):
    given = ["really liked it 4.12 avg rating — 1,234 ratings", "4.00 avg rating — 1 rating", "none", None]
    assert values(spark, text.rating, given) == [4.12, 4.0, None, None]
    assert values(spark, text.ratings_count, given) == [1234, None, None, None]


def test_token_overlap(spark):
    df = spark.createDataFrame([("a b c", "a b"), ("", "a"), (None, "a")], "x string, y string")
    assert [r[0] for r in df.select(text.token_overlap("x", "y")).collect()] == [2 / 3, 0.0, 0.0]


def test_canonical_key_of_nulls(spark):
    import hashlib

    df = spark.createDataFrame([(" A ", None)], "t string, a string")
    assert df.select(keys.canonical_key("t", "a")).first()[0] == hashlib.sha1(b"a|||").hexdigest()


def test_redacted(spark):
    assert values(spark, text.redact, ["https://x/?q=a&key=secret&b=1", "https://x/?key=s"]) == ["https://x/?q=a&key=***&b=1", "https://x/?key=***"]


def test_sql_functions(spark):
    register.register(spark)
    assert tuple(spark.sql("SELECT clean_isbn('0-3x'), parse_price('1,5'), year_or_minus_one('x'), normalize_ws(' a  b ')").first()) == ("03X", 1.5, -1, "a b")


@pytest.mark.parametrize(("html", "expected"), [
    ("<meta itemprop='price' content='12,50'> € 12.5", (12.5, "EUR")),
    ("<p>£ 7.99</p>", (7.99, "GBP")),
    ("<p>R 5</p>", (5.0, None)),
    ("<p>nothing</p>", (None, None)),
    (None, (None, None)),
])
def test_page_price(spark, html, expected):
    assert tuple(values(spark, codes.page_price, [html])[0]) == expected
