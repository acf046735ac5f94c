"""The batch jobs against a server on this machine."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from bindery import __main__ as cli
from bindery.config import Settings
from bindery.operators import quality
from bindery.plans import pipeline
from bindery.plans.source_queries import offline_page
from bindery.sources import http, readers, sinks


class _Site(BaseHTTPRequestHandler):
    """Pages, volumes and failures; keeps what it was asked."""

    asked: list[tuple[str, dict, str]] = []
    busy: Counter = Counter()

    def do_GET(self):
        where, given = urlsplit(self.path).path, {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        self.asked.append((where, given, self.headers["User-Agent"]))
        status, body = 200, ""
        if where == "/busy" and self.busy[where] < 2:
            self.busy[where] += 1
            status = 429
        elif where in ("/gone", "/down"):
            status = 404 if where == "/gone" else 503
        elif where == "/search":
            body = offline_page(int(given["page"]))
        elif where == "/volumes":
            items = [{"id": f"v{k}", "volumeInfo": {"title": given["q"].split("+")[0], "authors": ["A"], "publishedDate": str(2000 + k), "industryIdentifiers": [{"type": "ISBN_13", "identifier": "9780306406157"}] if k == 1 else []}} for k in range(8)]
            body = json.dumps({"items": items})
        self.send_response(status)
        self.send_header("Content-Type", "text/plain; charset=utf-8")
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    _Site.asked, _Site.busy = [], Counter()
    server = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def quick(**given):
    return http.Client(backoff=0.001, timeout=5, **given)


def test_busy_servers_are_asked_again(site):
    answer = quick().get(f"{site}/busy")
    assert (answer.status, answer.attempts, answer.body) == (200, 3, "")
    assert (quick().get(f"{site}/gone").status, quick().get(f"{site}/gone").attempts) == (404, 1)
    down = quick(attempts=5).get(f"{site}/down")
    assert (down.status, down.attempts, down.body, down.notes) == (503, 5, None, "HTTP 503")
    with pytest.raises(OSError):
        quick().fetch(f"{site}/down")


def test_no_server_is_a_failure_without_status():
    answer = quick(attempts=2).get("http://127.0.0.1:9/")
    assert answer.status is None and answer.body is None and answer.attempts == 2 and answer.notes


def test_calls_are_logged_with_time_and_agents_in_turn(spark, site, tmp_path):
    df = spark.createDataFrame([(0, f"{site}/search?page=1&key=abc"), (1, f"{site}/gone"), (2, None)], "n int, url string").coalesce(1)
    rows = http.called(df, quick(agents=("one", "two"))).withColumn("url_or_file", F.col("url"))
    found = {r["n"]: r for r in rows.collect()}
    assert "Book 0" in found[0]["body"] and found[0]["status_code"] == "200" and found[0]["duration_s"] > 0
    assert found[1]["body"] is None and found[1]["status_code"] == "404" and found[2]["ts_utc"] is None
    assert {found[0]["user_agent"], found[1]["user_agent"]} == {"one", "two"}
    sinks.append_requests(rows.where("url is not null"), path := f"file://{tmp_path}/log")
    logged = spark.read.option("header", True).csv(path).collect()
    assert len(logged) == 2 and not any("abc" in r["url_or_file"] for r in logged)


@pytest.mark.parametrize(("fails", "max_records", "max_pages", "expected"), [((), 15, 3, [1, 2, 3]), ((), 4, 9, [1, 2]), ((), 3, 9, [1]), ((2,), 15, 3, [1, 2, 3]), ((2, 3), 15, 3, [1]), ((1, 2), 15, 3, [])])
def test_paged_scan_stops(fails, max_records, max_pages, expected):
    """Enough records, enough pages, or two failed calls end the scan; ``fails`` are the calls that fail."""
    calls, pauses = [], []

    def fetch(page):
        calls.append(page)
        if len(calls) in fails:
            raise OSError
        return "abc"

    assert [k for k, _ in http.search_pages(fetch, len, max_records, max_pages, 0.8, sleep=pauses.append)] == expected
    assert len(pauses) == max(0, len(calls) - 1) and set(pauses) <= {0.8}


def test_settings():
    with pytest.raises(ValueError, match="must be set"):
        Settings.from_env({"GOOGLE_BOOKS_API_KEY": " "})
    told = Settings.from_env({"GOOGLE_BOOKS_API_KEY": "k", "GOOGLE_BOOKS_COUNTRY": "ES", "GB_PUBLISHER": "Big House", "GOODREADS_USE_ISBN": "true"})
    assert (told.rate_limit, told.country, told.use_isbn, told.fallback_query()) == (0.6, "ES", True, "inpublisher:Big+House")


def test_the_three_jobs(spark, site, tmp_path):
    records, volumes, out = (f"file://{tmp_path}/{x}" for x in ("records", "found", "out"))
    cli.main(["scan", "--url", f"{site}/search", "--query", "data", "--out", records, "--max-records", "4", "--pause", "0"])
    held = readers.read_records(spark, records).orderBy("input_index").collect()
    assert [r["title"] for r in held] == ["Book 0", "Book 1", "Book 2", "Book 3"]
    cli.main(["enrich", "--url", f"{site}/volumes", "--records", records, "--out", volumes], {"GOOGLE_BOOKS_API_KEY": "secret", "GOOGLE_BOOKS_RATE_LIMIT": "0"})
    asked = [a for a in _Site.asked if a[0] == "/volumes"]
    assert len(asked) == 4 and all(a[1]["maxResults"] == "5" and a[1]["key"] == "secret" for a in asked)
    logged = spark.read.option("header", True).csv(f"{volumes}/requests").collect()
    assert len(logged) == 4 and not any("secret" in r["url_or_file"] for r in logged)
    traced = spark.read.json(f"{volumes}/candidates").collect()
    assert len(traced) == 4 and all(len(r["candidates"]) == 5 for r in traced)
    best = readers.read_volumes(spark, f"{volumes}/volumes.csv").collect()
    assert [r["gb_id"] for r in best] == ["v1"] * 4
    cli.main(["integrate", "--records", records, "--volumes", f"{volumes}/volumes.csv", "--out", out])
    detail = spark.read.parquet(f"{out}/book_source_detail.parquet")
    assert Counter(r["source_name"] for r in detail.collect()) == {"goodreads": 4, "google_books": 4}
    for source in ("goodreads", "google_books"):
        assert sorted(r["row_number"] for r in detail.where(F.col("source_name") == source).collect()) == [1, 2, 3, 4]
    assert spark.read.parquet(f"{out}/dim_book.parquet").count() > 0


def test_rows_of_several_files_are_numbered_without_gaps(spark, tmp_path):
    top = f"file://{tmp_path}/volumes"
    for k in range(3):
        df = spark.createDataFrame([(f"g{k}{i}",) + (None,) * 13 for i in range(3 - k)], ", ".join(f"{c} string" for c in "gb_id title subtitle authors publisher pub_date language categories isbn13 isbn10 price_amount price_currency paginas formato".split()))
        df.coalesce(1).write.mode("append").option("header", True).csv(top)
    rows = readers.scan_order(readers.read_volumes(spark, top)).collect()
    assert sorted(r["_csv_row"] for r in rows) == list(range(1, 7))
    by_file = {}
    for r in sorted(rows, key=lambda r: r["_csv_row"]):
        by_file.setdefault(r["gb_id"][1], []).append(r["gb_id"])
    assert all(v == sorted(v) for v in by_file.values())


def test_enrich_in_compat_walks_the_candidates(spark):
    asked = spark.createDataFrame([("r", 0, "T", "A", None)], "rec_id string, input_index long, title string, author string, isbn13 string")
    found = spark.createDataFrame([("r", 0, "a", "T", "A", "9780306406157", "9780306406157", "2000"), ("r", 1, "b", "T", "A", None, None, "2010")], "rec_id string, pos int, gb_id string, title string, authors string, isbn13 string, listed_isbn13 string, publishedDate string").withColumns({c: F.lit(None).cast("double" if c == "price_amount" else "string") for c in ("price_amount", "price_currency", "price_country")})
    assert [pipeline.enrich(asked, found, compat)[0].first()["gb_id"] for compat in (False, True)] == ["a", "b"]


def test_numbering_spreads_one_group(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("o"), F.when(F.col("id") % 10 > 0, "big").otherwise(F.when(F.col("id") % 20 == 0, "small")).alias("g"))
    rows = readers.numbered(df, "n", "o", by=["g"]).collect()
    for g in ("big", "small", None):
        own = sorted((r["o"], r["n"]) for r in rows if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert sum(r["n"] for r in readers.running_total(df, "n", F.lit(1).cast("bigint"), "o").collect()) == 5000 * 5001 // 2


def test_parquet_takes_what_it_cannot_hold(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, null AS v, map('k', 1) AS m, interval 1 day AS i, double('NaN') AS d, array(1, 2) AS l, cast('x' AS binary) AS b")
    sinks.write_parquet(df, path := f"file://{tmp_path}/t")
    row = spark.read.parquet(path).first()
    assert row["a"] == 1 and row["v"] is None and row["m"] == '{"k":1}' and row["d"] is None and row["l"] == [1, 2] and "1" in row["i"]
    told = sinks.as_text(df).first()
    assert told["l"] == "[1,2]" and told["b"] == "x" and told["a"] == "1"


def test_whole_numbers(spark):
    df = spark.createDataFrame([(" 7 ",), ("7.0",), ("7.5",), ("x",), (None,), ("9223372036854775807",)], "s string")
    assert [r[0] for r in df.select(sinks.whole_number("s")).collect()] == [7, 7, None, None, None, 9223372036854775807]


def test_metrics_survive_a_failure(spark):
    df = spark.createDataFrame([("a", None), ("b", "t")], "book_id string, titulo string")
    broken = df.select(F.raise_error(F.lit("no")).alias("filas_totales"))
    told = quality.safe_metrics(broken, df).first()
    assert told["filas_totales"] == 2 and told["nulos_por_campo"]["titulo"] == 1 and told["porcentaje_fechas_validas"] == 0.0 and told["filas_por_fuente"] == {}
    assert quality.safe_metrics(quality.metrics(df.withColumn("source_name", F.lit("s"))), df).first()["filas_por_fuente"] == {"s": 2}
