"""Queries of the scalar functions, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import codes, dates, isbn, keys, register, similarity, text
from bindery.operators import quality, survivorship
from bindery.plans.derived import isbn10, isbn13, sql_check10, sql_check13, sql_core, sql_isbn10, sql_isbn13, table

def _k() -> F.Column:
    return F.col("p_partkey")


def _given13() -> F.Column:
    """Valid, every seventh with a wrong check digit, every fifth hyphenated."""
    whole = isbn13(_k())
    wrong = F.concat(F.substring(whole, 1, 12), ((F.substring(whole, 13, 1).cast("int") + 1) % 10).cast("string"))
    value = F.when(_k() % 7 == 0, wrong).otherwise(whole)
    return F.when(_k() % 5 == 0, F.concat(F.substring(value, 1, 3), F.lit("-"), F.substring(value, 4, 10))).otherwise(value)


def isbn13_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = isbn.clean(_given13())
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("isbn"), isbn.is_valid13(c).alias("valid"))


def isbn10_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(_k() % 7 == 0, F.translate(isbn10(_k()), "0123456789X", "1234567890X")).otherwise(F.lower(isbn10(_k())))
    c = isbn.clean(given)
    return table(spark, sf_dir, "part").select("p_partkey", isbn.is_valid10(c).alias("valid"), isbn.check10(F.substring(isbn10(_k()), 1, 9)).alias("check_digit"))


def isbn10_to_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", isbn.to13(isbn10(_k())).alias("isbn13"))


def isbn_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(_k() % 3 == 0, isbn10(_k())).when(_k() % 3 == 1, _given13()).otherwise(F.lit("n/a"))
    both = isbn.normalize(given)
    return table(spark, sf_dir, "part").select("p_partkey", both["isbn10"].alias("isbn10"), both["isbn13"].alias("isbn13"))


def isbn_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentence = F.concat(F.lit("ISBN "), isbn10(_k()), F.lit("; see also "), isbn13(_k(), "979"), F.lit(" end. Ref 12345."))
    found = isbn.extract(sentence)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("found"), isbn.first13(found).alias("first13"))


def isbn_from_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.when(_k() % 2 == 0, F.concat(F.lit("https://x.example/vid?isbn="), isbn13(_k()), F.lit("&a=1")))
    return table(spark, sf_dir, "part").select("p_partkey", isbn.from_links(link, F.concat(F.lit("http://y.example/"), isbn13(_k(), "979"))).alias("isbn13"))


def _given_date() -> F.Column:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 9
    months = F.array(*map(F.lit, ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")))
    spanish = F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), F.element_at(months, F.month(d)), F.lit(" de "), F.year(d).cast("string"))
    forms = ("yyyy-MM-dd", "yyyy-M-d", "yyyy-MM", "yyyy", "yyyy/MM/dd")
    out = F.when(k == 5, spanish).when(k == 6, F.date_format(d, "MMMM d, yyyy")).when(k == 7, F.date_format(d, "yyyy MMMM")).when(k == 8, F.lit("not a date"))
    for i, form in enumerate(forms):
        out = out.when(k == i, F.date_format(d, form))
    return out


def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dates.parse_date(_given_date())
    return table(spark, sf_dir, "orders").select("o_orderkey", d["iso"].alias("iso"), d["partial"].alias("partial"), dates.year_or(d["iso"]).alias("year"))


def date_normalize_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dates.parse_date(_given_date(), compat=True)
    return table(spark, sf_dir, "orders").select("o_orderkey", d["iso"].alias("iso"), d["partial"].alias("partial"))


def date_valid_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("ok", dates.parse_date(_given_date())["iso"].isNotNull())
    return rows.groupBy("o_orderpriority").agg(quality.percent(F.col("ok")).alias("pct"))


def date_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    told = F.concat(F.lit("Hardcover. Published "), F.when(k == 0, F.date_format(d, "MMMM d, yyyy")).when(k == 1, F.date_format(d, "MMMM yyyy")).when(k == 2, F.date_format(d, "yyyy")).otherwise("soon"), F.lit(" by House"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.published(told).alias("published"))


def _given_language() -> F.Column:
    k, lang = F.col("doc_id") % 4, F.col("lang")
    return F.when(k == 0, F.concat(F.upper(lang), F.lit("-us"))).when(k == 1, F.concat(lang, F.lit("-Hans"))).when(k == 2, F.concat(F.lit("  "), F.upper(lang), F.lit(" "))).otherwise("english")


def language_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", codes.normalize_language(_given_language()).alias("language"))


def language_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", codes.valid_language(codes.normalize_language(_given_language())).alias("valid"))


#: Given currencies by the last digit of the order's key, and what they mean.
_MONEY = (("$", "USD"), ("€12.34", "EUR"), ("usd.", "USD"), ("R$", "BRL"), ("R$ 5", "USD"), ("12 EUR each", "EUR"), ("XXX", None), ("", None), (None, None), ("gbp", "GBP"))


def _given_currency() -> F.Column:
    k, out = F.col("o_orderkey") % 10, F.when(F.lit(False), "")
    for i, (given, _) in enumerate(_MONEY):
        out = out.when(k == i, F.lit(given))
    return out


def currency_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = codes.normalize_currency(_given_currency())
    return table(spark, sf_dir, "orders").select("o_orderkey", c.alias("currency"), codes.valid_currency(c).alias("valid"), codes.valid_currency(_given_currency()).alias("valid_as_given"))


def currency_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    country = F.element_at(F.array(*map(F.lit, ("es", "US", "gb", "UK", "de", "XX"))), n % 6 + 1)
    link = F.concat(F.lit("https://www.shop.example."), F.lower(country), F.lit("/buy"))
    told = codes.currency_of_link(link)
    return table(spark, sf_dir, "nation").select("n_nationkey", codes.currency_of_country(country).alias("by_country"), told["currency"].alias("by_link"), told["country"].alias("link_country"), codes.repaired_currency(F.when(n % 2 == 0, "$"), country).alias("repaired"))


def _cents() -> tuple[F.Column, F.Column]:
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return F.expr("cast(round(p_retailprice * 100) as bigint) div 100").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")


def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, part = _cents()
    k = _k() % 5
    given = F.when(k == 0, F.concat(whole, F.lit(","), part)).when(k == 1, F.concat(F.lit("€ "), whole, F.lit("."), part)).when(k == 2, F.concat(F.lit("1."), whole, F.lit(","), part)).when(k == 3, F.lit("-3")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", codes.parse_price(given).alias("price"))


def sale_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    null, k = F.lit(None), _k() % 4
    offer = F.struct(F.struct((F.col("p_size").cast("bigint") * 1_000_000).alias("amountInMicros"), F.lit(" eur ").alias("currencyCode")).alias("listPrice"))
    sale = F.struct(
        F.when(k < 2, "es").alias("country"),
        F.lit("FOR_SALE").alias("saleability"),
        F.lit("https://www.books.example.de/x").alias("buyLink"),
        F.struct(F.when(k == 0, F.col("p_retailprice")).alias("amount"), F.lit("usd").alias("currencyCode")).alias("retailPrice"),
        F.when((k == 0) | (k == 1), F.array(offer)).otherwise(null).alias("offers"),
    )
    p = codes.sale_price(sale)
    return table(spark, sf_dir, "part").select("p_partkey", p["amount"].alias("amount"), p["currency"].alias("currency"), p["country"].alias("country"))


def whitespace_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.normalize_whitespace(F.concat(F.lit(" \t "), "text", F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("bigint").alias("n"))


def main_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.main_title("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("bigint").alias("n"))


def match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = text.main_title(F.concat("p_name", F.lit(" - "), "p_brand"))
    author = text.match_author(F.when(_k() % 4 != 0, F.concat(F.lit(" "), "p_type", F.lit("  Jr "))))
    return table(spark, sf_dir, "part").select("p_partkey", text.match_key(title, author).alias("match_key"), text.match_key(title, author, "None").alias("match_key_compat"))


def _next_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_brand"))
    q = p.select((_k() - 1).alias("k"), F.col("t").alias("t2"), F.col("p_type").alias("type2"))
    return p.join(q, _k() == F.col("k"))


def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = text.normalize_for_comparison("t"), text.normalize_for_comparison("t2")
    return _next_pairs(spark, sf_dir).select("p_partkey", F.levenshtein(a, b).cast("bigint").alias("distance"), F.round(similarity.title_ratio(a, b), 6).alias("ratio"))


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = text.normalize_for_comparison("t"), text.normalize_for_comparison("t2")
    return _next_pairs(spark, sf_dir).select("p_partkey", F.round(text.token_overlap(a, b), 6).alias("overlap"))


def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = similarity.match_score(F.col("t"), F.col("p_type"), isbn13(_k()), F.col("t2"), F.concat_ws(";", "type2", F.lit("Other")), isbn13(_k() + F.when(_k() % 2 == 0, 0).otherwise(1)))
    return _next_pairs(spark, sf_dir).select("p_partkey", F.round(score, 6).alias("score"))


def listify_uniq(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat_ws("", "p_name", F.lit("; "), "p_type", F.lit(" , "), "p_brand", F.lit(";;"), "p_name")
    listed = text.listify(given)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(listed).cast("bigint").alias("n"), F.array_join(text.distinct_in_order(listed), "|").alias("parts"), text.first_part(given).alias("first_part"))


def tags_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.join_list(F.array("p_name", F.lit(""), F.lit(None).cast("string"), "p_brand")).alias("tags"))


def rating_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    told = F.concat(F.lit("really liked it 4."), F.lpad((_k() % 100).cast("string"), 2, "0"), F.lit(" avg rating — "), F.when(_k() % 3 == 0, F.concat(n, F.lit(",012 ratings"))).when(_k() % 3 == 1, F.concat(n, F.lit(" ratings"))).otherwise("1 rating"))
    return table(spark, sf_dir, "part").select("p_partkey", text.rating(told).alias("rating"), text.ratings_count(told).alias("ratings_count"), text.absolute_url(F.concat(F.lit("/book/"), n), "https://site.example").alias("url"))


def canonical_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", keys.canonical_key(F.concat(F.lit(" "), "p_name"), F.when(_k() % 3 != 0, F.col("p_type")), "p_brand", "p_size").alias("canonical_key"))


def book_id_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = isbn.normalize(_given13())["isbn13"]
    return table(spark, sf_dir, "part").select("p_partkey", keys.book_id(norm, norm.isNotNull(), keys.canonical_key("p_name", "p_type")).alias("book_id"))


def semantic_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _given_date().alias("fecha_publicacion"), F.when(F.col("o_orderkey") % 2 == 0, "EN-us").otherwise("english").alias("idioma"), _given_currency().alias("moneda"), F.lit("12,50").alias("precio"))
    return survivorship.semantic(rows).select("o_orderkey", "fecha_publicacion", "fecha_publicacion_parcial", "fecha_publicacion_valida", "idioma", "idioma_valido", "moneda", "moneda_valida", "precio")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("bindery_part")
    return spark.sql("SELECT p_partkey, clean_isbn(concat('x-', p_partkey, 'x')) AS cleaned, normalize_ws(concat('  ', p_name, '  ')) AS name, parse_price(concat('€', p_size, ',5')) AS price, year_or_minus_one(concat('20', lpad(cast(p_size AS string), 2, '0'), '-x')) AS year FROM bindery_part")


_K13 = f"CASE WHEN p_partkey % 7 = 0 THEN '978' || {sql_core('p_partkey')} || CAST(({sql_check13(chr(40) + chr(39) + '978' + chr(39) + ' || ' + sql_core('p_partkey') + chr(41))} + 1) % 10 AS VARCHAR) ELSE {sql_isbn13('p_partkey')} END"


def _date_sql(six: str) -> str:
    return f"""CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01')
      WHEN 3 THEN strftime(o_orderdate, '%Y-01-01') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 6 THEN {six} WHEN 7 THEN strftime(o_orderdate, '%Y-%m-01') END"""


_PARTIAL = "o_orderkey % 9 IN (2, 3, 4, 7)"
_ISO = _date_sql("strftime(o_orderdate, '%Y-%m-%d')")
_CUR = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN " + (f"'{m}'" if m else "NULL") for i, (_, m) in enumerate(_MONEY)) + " END"
_LANG = "CASE doc_id % 4 WHEN 0 THEN lang || '-US' WHEN 1 THEN lang || '-Hans' WHEN 2 THEN lang ELSE 'english' END"
_PAIRS = """p AS (SELECT a.p_partkey, lower(replace(a.p_name || ' ' || a.p_brand, '#', '')) AS x, lower(replace(b.p_name || ' ' || b.p_brand, '#', '')) AS y, lower(a.p_type) AS ta, lower(b.p_type) AS tb
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""
_OVER = "CAST(len(list_intersect(list_distinct(string_split({0}, ' ')), list_distinct(string_split({1}, ' ')))) AS DOUBLE) / greatest(len(list_distinct(string_split({0}, ' '))), len(list_distinct(string_split({1}, ' '))))"
_RATIO = "greatest(0.0, 1 - CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y)))"

ORACLE = {
    "isbn13_validate": f"SELECT p_partkey, {_K13} AS isbn, p_partkey % 7 <> 0 AS valid FROM part",
    "isbn10_validate": f"SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN {sql_check10('s')} = (CASE WHEN substr(s, 10, 1) = 'X' THEN 10 ELSE CAST(substr(s, 10, 1) AS INTEGER) END) ELSE true END AS valid, c AS check_digit FROM (SELECT p_partkey, translate({sql_isbn10('p_partkey')}, '0123456789X', '1234567890X') AS s, substr({sql_isbn10('p_partkey')}, 10, 1) AS c FROM part)",
    "isbn10_to_13": f"SELECT p_partkey, {sql_isbn13('p_partkey')} AS isbn13 FROM part",
    "isbn_normalize": f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {sql_isbn10('p_partkey')} END AS isbn10, CASE WHEN p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 7 <> 0) THEN {sql_isbn13('p_partkey')} END AS isbn13 FROM part",
    "isbn_extract_text": f"SELECT p_partkey, {sql_isbn10('p_partkey')} || ',' || {sql_isbn13('p_partkey')} || ',' || {sql_isbn13('p_partkey', '979')} AS found, {sql_isbn13('p_partkey')} AS first13 FROM part",
    "isbn_from_links": f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {sql_isbn13('p_partkey')} ELSE {sql_isbn13('p_partkey', '979')} END AS isbn13 FROM part",
    "date_normalize": f"SELECT o_orderkey, {_ISO} AS iso, {_PARTIAL} AS partial, CASE WHEN o_orderkey % 9 = 8 THEN -1 ELSE CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders",
    "date_normalize_compat": f"SELECT o_orderkey, {_date_sql('NULL')} AS iso, {_PARTIAL} AS partial FROM orders",
    "date_valid_pct": "SELECT o_orderpriority, round(100.0 * count(*) FILTER (o_orderkey % 9 <> 8) / CAST(count(*) AS DOUBLE), 2) AS pct FROM orders GROUP BY 1",
    "date_published": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%B %Y') WHEN 2 THEN strftime(o_orderdate, '%Y') END AS published FROM orders",
    "language_normalize": f"SELECT doc_id, {_LANG} AS language FROM documents",
    "language_valid": "SELECT doc_id, doc_id % 4 <> 3 AS valid FROM documents",
    "currency_normalize": f"SELECT o_orderkey, {_CUR} AS currency, {_CUR} IS NOT NULL AS valid, o_orderkey % 10 = 9 AS valid_as_given FROM orders",
    "currency_by_country": "SELECT n_nationkey, c AS by_country, c AS by_link, CASE WHEN c IS NOT NULL THEN upper(k) END AS link_country, CASE WHEN n_nationkey % 2 = 0 THEN 'USD' ELSE c END AS repaired FROM (SELECT n_nationkey, k, CASE upper(k) WHEN 'ES' THEN 'EUR' WHEN 'US' THEN 'USD' WHEN 'GB' THEN 'GBP' WHEN 'UK' THEN 'GBP' WHEN 'DE' THEN 'EUR' END AS c FROM (SELECT n_nationkey, ['es', 'US', 'gb', 'UK', 'de', 'XX'][n_nationkey % 6 + 1] AS k FROM nation))",
    "price_parse": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN round(p_retailprice, 2) WHEN 1 THEN round(p_retailprice, 2) WHEN 3 THEN CAST(-3 AS DOUBLE) END AS price FROM part",
    "sale_price": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN CAST(p_size AS DOUBLE) END AS amount, CASE p_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'EUR' END AS currency, CASE WHEN p_partkey % 4 < 2 THEN 'ES' ELSE 'DE' END AS country FROM part",
    "whitespace_normalize": r"SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)",
    "main_title": r"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM (SELECT doc_id, nullif(lower(trim(regexp_replace(strip_accents(trim(regexp_replace(
      CASE WHEN contains(text, ':') THEN split_part(text, ':', 1) WHEN contains(text, ' - ') THEN split_part(text, ' - ', 1) WHEN contains(text, ' — ') THEN split_part(text, ' — ', 1)
        WHEN contains(text, '—') THEN split_part(text, '—', 1) WHEN contains(text, '-') THEN split_part(text, '-', 1) ELSE text END, '\s+', ' ', 'g'))), '[^0-9A-Za-z\s]', ' ', 'g'))), '') AS t FROM documents)""",
    "match_key": "SELECT p_partkey, lower(p_name) || '|' || CASE WHEN p_partkey % 4 <> 0 THEN lower(p_type) || ' jr' ELSE '' END AS match_key, lower(p_name) || '|' || CASE WHEN p_partkey % 4 <> 0 THEN lower(p_type) || ' jr' ELSE 'None' END AS match_key_compat FROM part",
    "levenshtein_pairs": f"WITH {_PAIRS} SELECT p_partkey, CAST(levenshtein(x, y) AS BIGINT) AS distance, round({_RATIO}, 6) AS ratio FROM p",
    "token_overlap": f"WITH {_PAIRS} SELECT p_partkey, round({_OVER.format('x', 'y')}, 6) AS overlap FROM p",
    "match_score": f"WITH {_PAIRS} SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN 100.0 ELSE 0.0 END + ({_RATIO} * 40.0 + {_OVER.format('x', 'y')} * 20.0) + {_OVER.format('ta', chr(40) + 'tb || ' + chr(39) + 'other' + chr(39) + chr(41))} * 40.0, 6) AS score FROM p",
    "listify_uniq": "SELECT p_partkey, CAST(4 AS BIGINT) AS n, p_name || '|' || p_type || '|' || p_brand AS parts, p_name AS first_part FROM part",
    "tags_join": "SELECT p_partkey, p_name || ';' || p_brand AS tags FROM part",
    "rating_parse": "SELECT p_partkey, CAST('4.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS rating, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size * 1000 + 12 AS BIGINT) WHEN 1 THEN CAST(p_size AS BIGINT) END AS ratings_count, 'https://site.example/book/' || p_size AS url FROM part",
    "canonical_sha1": "SELECT p_partkey, sha1(lower(p_name) || '|' || CASE WHEN p_partkey % 3 <> 0 THEN lower(p_type) ELSE '' END || '|' || lower(p_brand) || '|' || p_size) AS canonical_key FROM part",
    "book_id_key": f"SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN {sql_isbn13('p_partkey')} ELSE sha1(lower(p_name) || '|' || lower(p_type) || '||') END AS book_id FROM part",
    "semantic_bundle": f"SELECT o_orderkey, {_ISO} AS fecha_publicacion, {_PARTIAL} AS fecha_publicacion_parcial, o_orderkey % 9 <> 8 AS fecha_publicacion_valida, CASE WHEN o_orderkey % 2 = 0 THEN 'en-US' END AS idioma, o_orderkey % 2 = 0 AS idioma_valido, {_CUR} AS moneda, {_CUR} IS NOT NULL AS moneda_valida, CAST(12.5 AS DOUBLE) AS precio FROM orders",
    "sql_functions": "SELECT p_partkey, 'X' || p_partkey || 'X' AS cleaned, p_name AS name, CAST(p_size || '.5' AS DOUBLE) AS price, CAST('20' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS INTEGER) AS year FROM part",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE}
