"""Queries of sources, sinks and streams, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import codes, text
from bindery.operators import quality
from bindery.operators.shared import folder
from bindery.plans import pipeline
from bindery.plans.derived import isbn13, sql_isbn13, table
from bindery.sources import html, http, lookup, readers, schemas, sinks
from bindery.streaming import streams


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    given = {"gb_id": F.concat(F.lit("g"), k.cast("string")), "title": F.concat(F.lit('"A, '), "p_name", F.lit('"')), "authors": F.concat_ws(";", "p_type", F.lit("B")), "isbn13": F.when(k % 3 == 0, isbn13(k)), "price_amount": F.col("p_size") / 2, "paginas": F.when(k % 2 == 0, F.col("p_size"))}
    fields = [c.split() for c in schemas.VOLUME.split(", ")]
    return table(spark, sf_dir, "part").select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_csv(_volumes(spark, sf_dir), path := folder(spark, "volumes"))
    return readers.read_volumes(spark, path).select("gb_id", "title", "authors", "isbn13", "price_amount", "paginas", "publisher")


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "part").withColumn("tags", text.listify(F.concat_ws(";", "p_name", "p_type")))
    sinks.write_parquet(told, path := folder(spark, "parts"))
    return spark.read.parquet(path).select("p_partkey", F.array_join("tags", "|").alias("tags"), "p_retailprice")


def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result page's worth of records written as one document and read again."""
    k = F.col("s_suppkey")
    records = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.lit("A").alias("author"), (F.col("s_acctbal") / 100).alias("rating"), k.alias("ratings_count"), F.lit(None).cast("string").alias("pub_date"))
    sinks.write_envelope(records, path := folder(spark, "envelope"), order="ratings_count", source="test", query="all")
    return readers.read_records(spark, path).select("title", "author", "rating", F.col("input_index").cast("bigint").alias("input_index"), "pub_date")


def audit_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "nation").select(F.lit("ambiguous_gb_candidates").alias("event"), F.col("n_name").alias("match_title"), F.col("n_nationkey").cast("bigint").alias("gr_index"))
    path = folder(spark, "rules")
    for part in (events.where("gr_index < 10"), events.where("gr_index >= 10")):
        sinks.append_events(part, path)
    return spark.read.schema(schemas.EVENT).json(path).select("event", "match_title", "gr_index")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    calls = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("ts_utc"), F.lit("enrich").alias("step"), F.lit("api").alias("source_name"), F.concat(F.lit("https://api.example/v?q="), k, F.lit("&key=abc"), k, F.lit("&max=5")).alias("url_or_file"), F.col("value").alias("duration_s"))
    return sinks.request_log(calls).select("ts_utc", "url_or_file", "duration_s", "status_code")


def candidate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [c.split() for c in schemas.CANDIDATE.split(", ")]
    given = {"gb_id": F.col("o_orderkey").cast("string"), "score": F.col("o_totalprice")}
    scored = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("rec_id"), F.col("o_custkey").alias("input_index"), F.col("o_orderkey").alias("pos"), *(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))
    return sinks.trace(scored).select("rec_id", "best_score", F.size("candidates").cast("bigint").alias("n"), F.array_join(F.transform("candidates", lambda c: c["gb_id"]), ",").alias("ids"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("a"), F.lit(None).cast("string").alias("b")), {"ignoreNullFields": "false"}).alias("j"))


def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.tagged(table(spark, sf_dir, "nation"), "world", "nation.parquet").groupBy("source_name", "source_file").agg(F.count(F.lit(1)).alias("n"))


def query_string_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    q = lookup.query_string(F.when(k % 4 == 0, isbn13(k)), F.when(k % 4 != 1, F.col("p_name")), F.when(k % 4 == 2, F.col("p_type")), subject=F.when(k % 4 == 3, F.concat_ws(";", "p_brand", F.lit("Other"))))
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("q"), F.url_encode(q).alias("encoded"))


def lookup_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups through a client that answers offline with the query's length."""
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("query"))
    return lookup.lookup(asked, lambda q: f'{{"n": {len(q)}}}').select("n_nationkey", F.get_json_object("body", "$.n").cast("bigint").alias("n"))


def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the data source, one partition each, from an offline function."""
    spark.dataSource.register(lookup.PagedSource)
    pages = spark.read.format("paged").option("pages", "3").option("fetch", "bindery.plans.source_queries:offline_page").load()
    return pipeline.scan_pages(pages, limit=4, base="https://site.example", page="page").select("title", "author", "rating", "ratings_count", "book_url")


def offline_page(page: int) -> str:
    row = '<tr><td><a class="bookTitle" href="/b/{0}"><span>Book {0}</span></a><a class="authorName"><span>Author {1}</span></a><span class="minirating">3.{0} avg rating — {0},000 ratings</span></td></tr>'
    return '<table class="tableList">' + "".join(row.format(k, k % 2) for k in range(2 * page - 2, 2 * page + 1)) + "</table>"


def api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API items built from parts, parsed from JSON and flattened."""
    k = F.col("p_partkey")
    info = F.struct(F.col("p_name").alias("title"), F.array("p_type", F.lit("")).alias("authors"), F.lit("EN-us").alias("language"), F.lit("BOOK").alias("printType"), F.concat(F.lit("http://x.example/"), isbn13(k, "979")).alias("infoLink"), F.when(k % 2 == 0, F.array(F.struct(F.lit("ISBN_13").alias("type"), isbn13(k).alias("identifier")))).alias("industryIdentifiers"))
    sale = F.struct(F.struct(F.col("p_retailprice").alias("amount"), F.lit("€").alias("currencyCode")).alias("retailPrice"))
    body = F.to_json(F.struct(F.array(F.struct(k.cast("string").alias("id"), info.alias("volumeInfo"), sale.alias("saleInfo"))).alias("items")))
    items = table(spark, sf_dir, "part").select("p_partkey", F.explode(readers.parse_items(body)).alias("item"))
    return items.select("p_partkey", lookup.item_isbn13(F.col("item")).alias("any_isbn13"), *lookup.item_row(F.col("item"))).select("p_partkey", "gb_id", "any_isbn13", "isbn13", "authors", "language", "price_amount", "price_currency", "formato")


def lookup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of lookups with their limit; none without a query."""
    q = F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.replace("n_name", F.lit(" "), F.lit("+")), F.lit("+inauthor:x")))
    return table(spark, sf_dir, "nation").select("n_nationkey", lookup.request_url(q, "https://api.example/v", 5, country="ES").alias("url"))


def paged_scan_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a scan reads until it has five records, after one failed call."""
    failed = iter([True])

    def fetch(page: int) -> str:
        if page == 2 and next(failed, False):
            raise OSError
        return offline_page(page)

    pages = http.search_pages(fetch, lambda page: len(html.result_rows(page)), max_records=5, max_pages=9, pause=0.0)
    return spark.createDataFrame([(k, len(html.result_rows(page))) for k, page in pages], "page bigint, n bigint")


def csv_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a CSV file numbered by their place in it."""
    sinks.write_csv(_volumes(spark, sf_dir).repartition(1).sortWithinPartitions(F.length("gb_id"), "gb_id"), path := folder(spark, "volumes"))
    return readers.scan_order(readers.read_volumes(spark, path)).select("gb_id", F.col("_csv_row").alias("csv_row"))


def sanitized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a table cannot hold as they are, written and read again."""
    k = F.col("event_id")
    told = table(spark, sf_dir, "events").select("event_id", F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), F.create_map(F.lit("type"), "event_type").alias("held"), F.lit(None).alias("nothing"))
    sinks.write_parquet(told, path := folder(spark, "sanitized"))
    return spark.read.parquet(path).select("event_id", "value", "held", F.col("nothing").cast("string").alias("nothing"))


def whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    given = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", sinks.whole_number(given).alias("n"))


def metrics_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that fail, and the counts that are written in their place."""
    books = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("book_id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("titulo"))
    broken = books.agg(F.raise_error(F.lit("broken")).cast("bigint").alias("filas_totales"))
    told = quality.safe_metrics(broken, books)
    return told.select("filas_totales", F.col("nulos_por_campo")["titulo"].alias("nulls_titulo"), F.col("nulos_por_campo")["isbn13"].alias("nulls_isbn13"), "completitud_promedio")


def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.nullif(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit(""))
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.size(links).cast("bigint").alias("n_links"), F.get(links, F.lit(0)).alias("first_link"))


def html_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the pages, every third with a price tag added."""
    tagged = F.concat("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<meta itemprop='price' content='EUR "), F.col("page_id").cast("string"), F.lit(",50'>"))).otherwise(""))
    p = codes.page_price(tagged)
    return table(spark, sf_dir, "pages").select("page_id", p["amount"].alias("amount"))


def html_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("<div id='details'>Published "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" ISBN 0306406152</div><p>$ "), F.col("o_orderkey").cast("string"), F.lit(".25</p>"))
    d = html.page_details(page, use_isbn=True)
    return table(spark, sf_dir, "orders").select("o_orderkey", d["pub_date"].alias("pub_date"), d["price_amount"].alias("amount"), d["price_currency"].alias("currency"), d["isbn10"].alias("isbn10"), d["isbn13"].alias("isbn13"))


def html_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda k, name: F.concat(F.lit('<tr><td><a class="bookTitle" href="/book/'), k, F.lit('"><span>'), name, F.lit('</span></a><a class="authorName"><span> A &amp; B </span></a><span class="minirating">4.10 avg rating — 1,234 ratings</span></td></tr>'))
    pages = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('<table class="tableList">'), row(F.col("n_nationkey").cast("string"), F.col("n_name")), row(F.lit("x"), F.lit("Second")), F.lit("</table><table><tr><td>no</td></tr></table>")).alias("html"))
    return html.parse_results(pages, base="https://site.example", keep=("n_nationkey",)).select("n_nationkey", F.col("pos").cast("bigint").alias("pos"), "title", "author", "rating", "ratings_count", "book_url")


def detail_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    records = table(spark, sf_dir, "part").select(k.alias("p_partkey"), F.concat(F.lit("/b/"), k.cast("string")).alias("book_url"), F.lit(None).cast("string").alias("isbn10"), F.when(k % 2 == 0, F.lit("old")).alias("isbn13"), F.lit("2001").alias("pub_date"), F.lit(1.0).alias("price_amount"), F.lit("USD").alias("price_currency"))
    there = k % 3 == 0
    details = table(spark, sf_dir, "part").select(F.concat(F.lit("/b/"), k.cast("string")).alias("book_url"), F.lit(None).cast("string").alias("isbn10"), F.when(there, "new").alias("isbn13"), F.when(there, "2002").alias("pub_date"), F.lit(None).cast("double").alias("price_amount"), F.when(there, "EUR").alias("price_currency"))
    return html.enrich_records(records, details).select("p_partkey", "isbn13", "pub_date", "price_amount", "price_currency")


def _run(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    top = folder(spark, "stream")

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={k}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out").select(*stream.columns)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in a stream, each once within the watermark."""
    return _run(streams.first_seen(_events(spark, sf_dir), ["user_id"], "ts", "3650 days").select("user_id"), spark, "append")


def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), "n_name")
    stream = _events(spark, sf_dir).withColumn("key", F.col("user_id") % 25)
    return _run(streams.looked_up(stream, names, "key").select("event_id", "n_name"), spark, "append")


ORACLE = {
    "csv_roundtrip": f"SELECT 'g' || p_partkey AS gb_id, '\"A, ' || p_name || '\"' AS title, p_type || ';B' AS authors, CASE WHEN p_partkey % 3 = 0 THEN {sql_isbn13('p_partkey')} END AS isbn13, p_size / CAST(2 AS DOUBLE) AS price_amount, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS paginas, NULL AS publisher FROM part",
    "parquet_roundtrip": "SELECT p_partkey, p_name || '|' || p_type AS tags, p_retailprice FROM part",
    "json_envelope": "SELECT s_name AS title, 'A' AS author, s_acctbal / 100 AS rating, row_number() OVER (ORDER BY s_suppkey) - 1 AS input_index, NULL AS pub_date FROM supplier",
    "audit_jsonl": "SELECT 'ambiguous_gb_candidates' AS event, n_name AS match_title, CAST(n_nationkey AS BIGINT) AS gr_index FROM nation",
    "request_log": "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts_utc, 'https://api.example/v?q=' || event_id || '&key=***&max=5' AS url_or_file, value AS duration_s, NULL AS status_code FROM events",
    "candidate_trace": "SELECT CAST(o_custkey AS VARCHAR) AS rec_id, max(o_totalprice) AS best_score, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"a\":\"' || event_type || '\",\"b\":null}' AS j FROM events",
    "source_tags": "SELECT 'world' AS source_name, 'nation.parquet' AS source_file, count(*) AS n FROM nation",
    "query_string_build": f"SELECT p_partkey, q, replace(replace(replace(q, '+', '%2B'), ':', '%3A'), '#', '%23') AS encoded FROM (SELECT p_partkey, replace(CASE p_partkey % 4 WHEN 0 THEN 'isbn:' || {sql_isbn13('p_partkey')} WHEN 2 THEN p_name || '+inauthor:' || p_type WHEN 3 THEN p_name || '+subject:' || p_brand END, ' ', '+') AS q FROM part)",
    "lookup_bodies": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(length(n_name) AS BIGINT) END AS n FROM nation",
    "paged_scan": "SELECT 'Book ' || k AS title, 'Author ' || (k % 2) AS author, CAST('3.' || k AS DOUBLE) AS rating, CAST(k || '000' AS BIGINT) AS ratings_count, 'https://site.example/b/' || k AS book_url FROM range(0, 4) t(k)",
    "api_items": f"SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS gb_id, CASE WHEN p_partkey % 2 = 0 THEN {sql_isbn13('p_partkey')} ELSE {sql_isbn13('p_partkey', '979')} END AS any_isbn13, CASE WHEN p_partkey % 2 = 0 THEN {sql_isbn13('p_partkey')} END AS isbn13, p_type AS authors, 'en-US' AS language, p_retailprice AS price_amount, 'EUR' AS price_currency, 'BOOK' AS formato FROM part",
    "lookup_urls": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN 'https://api.example/v?maxResults=5&country=ES&q=' || replace(n_name, ' ', '+') || '+inauthor%3Ax' END AS url FROM nation",
    "paged_scan_stop": "SELECT CAST(k AS BIGINT) AS page, CAST(3 AS BIGINT) AS n FROM range(1, 3) t(k)",
    "csv_row_numbers": "SELECT 'g' || p_partkey AS gb_id, row_number() OVER (ORDER BY p_partkey) AS csv_row FROM part",
    "sanitized_values": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, '{\"type\":\"' || event_type || '\"}' AS held, CAST(NULL AS VARCHAR) AS nothing FROM events",
    "whole_numbers": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_partkey END AS n FROM part",
    "metrics_fallback": "SELECT count(*) AS filas_totales, count(*) FILTER (p_partkey % 3 = 0) AS nulls_titulo, count(*) AS nulls_isbn13, CAST(0 AS DOUBLE) AS completitud_promedio FROM part",
    "html_title_links": "SELECT page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '') AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)[1] AS first_link FROM pages",
    "html_price": r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id || '.50' AS DOUBLE) ELSE TRY_CAST(replace(regexp_extract(html, '([€£¥R$])\s?([0-9]+[0-9.,]*)', 2), ',', '.') AS DOUBLE) END AS amount FROM pages",
    "html_details": "SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS pub_date, CAST(o_orderkey || '.25' AS DOUBLE) AS amount, 'USD' AS currency, '0306406152' AS isbn10, '9780306406157' AS isbn13 FROM orders",
    "html_list_rows": "SELECT n_nationkey, CAST(pos AS BIGINT) AS pos, CASE WHEN pos = 0 THEN n_name ELSE 'Second' END AS title, 'A & B' AS author, CAST(4.1 AS DOUBLE) AS rating, CAST(1234 AS BIGINT) AS ratings_count, 'https://site.example/book/' || CASE WHEN pos = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'x' END AS book_url FROM nation, range(0, 2) t(pos)",
    "detail_enrichment": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'old' WHEN p_partkey % 3 = 0 THEN 'new' END AS isbn13, CASE WHEN p_partkey % 3 = 0 THEN '2002' ELSE '2001' END AS pub_date, CAST(1 AS DOUBLE) AS price_amount, CASE WHEN p_partkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS price_currency FROM part",
    "stream_first_seen": "SELECT DISTINCT user_id FROM events",
    "stream_lookup": "SELECT event_id, n_name FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE}
