"""Lookups: query strings, REST calls through an injected client, paged scans, and items to rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bindery.functions import codes, isbn, text
from bindery.sources import http


def query_string(isbn13: Column, title: Column, author: Column, publisher: Column | None = None, subject: Column | None = None, lccn: Column | None = None, oclc: Column | None = None) -> Column:
    """``isbn:`` alone for a valid ISBN; else title and the named fields, joined by plus; null if all are missing."""
    valid = isbn.normalize(isbn13)["isbn13"]
    named = lambda name, c: F.lit(None).cast("string") if c is None else F.concat(F.lit(name), text.nonblank(c))
    parts = [text.nonblank(title), named("inauthor:", author), named("inpublisher:", publisher), named("subject:", None if subject is None else F.trim(text.first_part(subject))), named("lccn:", lccn), named("oclc:", oclc)]
    free = F.nullif(F.replace(F.concat_ws("+", *parts), F.lit(" "), F.lit("+")), F.lit(""))
    return F.when(valid.isNotNull(), F.concat(F.lit("isbn:"), valid)).otherwise(free)


def request_url(query: Column, base: str, max_results: int = 5, key: str | None = None, country: str | None = None) -> Column:
    """The address that asks for at most ``max_results`` candidates of a query; null without a query."""
    return F.concat(F.lit(http.volumes_url(base, "", max_results, key, country)), F.replace(F.url_encode(query), F.lit("%2B"), F.lit("+")))


def with_retries(call: Callable[[], str | None], attempts: int = 4, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The call's result; after the last failed attempt, None."""
    for k in range(attempts):
        try:
            return call()
        except OSError:
            if k + 1 < attempts:
                sleep(backoff * 2**k)
    return None


def lookup(queries: DataFrame, fetch: Callable[[str], str | None], query: str = "query", pause: float = 0.0, attempts: int = 4) -> DataFrame:
    """``queries`` with the body that ``fetch`` returns for each query; null without a query or after failures.

    ``fetch`` runs on the executors; each partition calls it one query at a time, ``pause`` seconds apart.
    """
    schema = queries.select("*", F.lit(None).cast("string").alias("body")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for q in batch.column(query).to_pylist():
                bodies.append(with_retries(lambda q=q: fetch(q), attempts) if q else None)
                if q and pause:
                    time.sleep(pause)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string())], names=[*batch.schema.names, "body"])

    return queries.mapInArrow(run, schema)


class _Page(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class PagedSource(DataSource):
    """Search pages as a data source: one input partition for each page.

    Options: ``pages``, and ``fetch`` as ``module:function`` that takes a page number and returns its HTML.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Page(k + 1) for k in range(int(self.options.get("pages", "3")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, function = self.options["fetch"].split(":")
        html = with_retries(lambda: getattr(importlib.import_module(module), function)(partition.page), 5, 0.6)
        if html is not None:
            yield partition.page, html


def item_isbn13(item: Column) -> Column:
    """The ISBN-13 that an item lists, else the first in its links."""
    ids = F.map_from_entries(F.filter(F.transform(item["volumeInfo"]["industryIdentifiers"], lambda i: F.struct(i["type"], i["identifier"])), lambda i: i["type"].isNotNull()))
    listed = F.coalesce(F.try_element_at(ids, F.lit("ISBN_13")), F.try_element_at(ids, F.lit("ISBN-13")))
    return F.coalesce(text.nonblank(listed), isbn.from_links(item["selfLink"], item["volumeInfo"]["infoLink"], item["volumeInfo"]["canonicalVolumeLink"]))


def item_row(item: Column) -> list[Column]:
    """The flat columns of an item."""
    v, sale = item["volumeInfo"], item["saleInfo"]
    listed = lambda kind: F.get(F.filter(v["industryIdentifiers"], lambda i: i["type"] == kind), F.lit(0))["identifier"]
    ten, thirteen = listed("ISBN_10"), listed("ISBN_13")
    norm = isbn.normalize(F.coalesce(thirteen, ten))
    retail = sale["retailPrice"]
    code = F.upper(F.trim(retail["currencyCode"]))
    return [
        item["id"].alias("gb_id"),
        v["title"].alias("title"),
        v["subtitle"].alias("subtitle"),
        F.nullif(text.join_list(v["authors"]), F.lit("")).alias("authors"),
        v["publisher"].alias("publisher"),
        v["publishedDate"].alias("pub_date"),
        codes.normalize_language(v["language"]).alias("language"),
        F.nullif(text.join_list(v["categories"]), F.lit("")).alias("categories"),
        F.coalesce(norm["isbn13"], thirteen).alias("isbn13"),
        F.coalesce(norm["isbn10"], ten).alias("isbn10"),
        retail["amount"].alias("price_amount"),
        F.when(code.rlike("^[A-Z]{3}$"), code).otherwise(codes.currency_of_symbol(code)).alias("price_currency"),
        v["pageCount"].alias("paginas"),
        F.trim(F.coalesce(text.nonblank(v["printType"]), v["format"])).alias("formato"),
    ]
