"""HTML: result tables and detail pages, from stored pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from bindery.functions import codes, dates, isbn, text


class _Rows(HTMLParser):
    """The rows of tables of one class: per row its text and the texts and links of marked elements."""

    _VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, table_class: str) -> None:
        super().__init__(convert_charrefs=True)
        self.table_class, self.rows, self.open, self.tables = table_class, [], [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        if tag in self._VOID:
            return
        marks = {m for m in ("bookTitle", "authorName", "minirating") if m in classes}
        inside = set().union(*(o[2] for o in self.open)) if self.open else set()
        if tag == "table" and self.table_class in classes:
            self.tables += 1
        if tag == "tr" and self.tables:
            self.rows.append({"text": [], "bookTitle": None, "authorName": None, "minirating": None, "href": None})
        if self.rows and self.tables:
            row = self.rows[-1]
            if tag == "a" and "bookTitle" in marks and row["href"] is None:
                row["href"] = given.get("href") or ""
            for mark in ("bookTitle", "authorName"):
                if tag == "span" and mark in inside and row[mark] is None:
                    row[mark] = []
                    marks = marks | {f"={mark}"}
            if tag == "span" and "minirating" in marks and row["minirating"] is None:
                row["minirating"] = []
                marks = marks | {"=minirating"}
        self.open.append((tag, self.table_class in classes and tag == "table", marks))

    def handle_endtag(self, tag: str) -> None:
        if any(o[0] == tag for o in self.open):
            while self.open:
                name, table, _ = self.open.pop()
                self.tables -= table
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.rows and self.tables:
            row = self.rows[-1]
            row["text"].append(data)
            for _, _, marks in self.open:
                for mark in marks:
                    if mark.startswith("="):
                        row[mark[1:]].append(data)


def result_rows(page: str | None) -> list[dict]:
    """The rows of a page's result tables."""
    parser = _Rows("tableList")
    parser.feed(page or "")
    parser.close()
    return parser.rows


@udtf(returnType="pos int, title string, author string, minirating string, href string, row_text string")
class ResultRows:
    """The result rows of a search page."""

    def eval(self, html: str) -> Iterator[tuple]:
        told = lambda x: None if x is None else "".join(x).strip()
        for k, row in enumerate(result_rows(html)):
            yield k, told(row["bookTitle"]), told(row["authorName"]), told(row["minirating"]), row["href"], "".join(row["text"])


def parse_results(pages: DataFrame, html: str = "html", base: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each result on each page: pos, title, author, rating, ratings_count, book_url, isbn10, isbn13."""
    spark = pages.sparkSession
    spark.udtf.register("result_rows", ResultRows)
    found = pages.select(*keep, F.col(html).alias("__html")).lateralJoin(spark.tvf.result_rows(F.col("__html").outer()) if hasattr(spark.tvf, "result_rows") else ResultRows(F.col("__html").outer()))
    mini = F.replace(F.col("minirating"), F.lit("\n"), F.lit(" "))
    url = text.absolute_url("href", base)
    isbns = isbn.extract(F.concat_ws(" ", F.col("row_text"), F.coalesce(url, F.lit(""))))
    first10 = F.get(F.filter(F.transform(isbns, lambda x: isbn.normalize(x)["isbn10"]), lambda x: x.isNotNull()), F.lit(0))
    return found.select(*keep, "pos", "title", "author", text.rating(mini).alias("rating"), text.ratings_count(mini).alias("ratings_count"), url.alias("book_url"), first10.alias("isbn10"), isbn.first13(isbns).alias("isbn13"))


def visible_text(html: Column | str) -> Column:
    """The text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(text.col(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), r"(?U)\s+", " "))


def page_details(html: Column | str, use_isbn: bool = False, url: Column | None = None) -> Column:
    """(isbn10, isbn13, pub_date, price_amount, price_currency) of a detail page."""
    h = text.col(html)
    block = F.nullif(F.coalesce(*(F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in (r"""(?is)id=["'](?:details|bookDataBox|description)["'][^>]*>(.*?)</div>""", r"""(?is)<div[^>]*class=["'][^"']*\bdetails\b[^"']*["'][^>]*>(.*?)</div>"""))), F.lit(""))
    price = codes.page_price(h)
    found = isbn.extract(F.concat_ws(" ", visible_text(h), url if url is not None else F.lit(""))) if use_isbn else F.array().cast("array<string>")
    first10 = F.get(F.filter(found, lambda x: F.length(x) == 10), F.lit(0))
    return F.struct(first10.alias("isbn10"), isbn.first13(found).alias("isbn13"), dates.published(visible_text(F.coalesce(block, h))).alias("pub_date"), price["amount"].alias("price_amount"), price["currency"].alias("price_currency"))


def enrich_records(records: DataFrame, details: DataFrame, key: str = "book_url") -> DataFrame:
    """Missing ISBNs are filled from details; date, price and currency are replaced where details have them."""
    d = details.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in ("isbn10", "isbn13", "pub_date", "price_amount", "price_currency")))
    joined = records.join(d, F.col(key) == F.col("__key"), "left")
    filled = {c: F.coalesce(text.nonblank(c), f"__{c}") for c in ("isbn10", "isbn13")}
    replaced = {c: F.coalesce(f"__{c}", c) for c in ("pub_date", "price_amount", "price_currency")}
    return joined.withColumns(filled | replaced).select(*records.columns)


def first_results(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` distinct results that have title and author.

    Of results with the same title and author, but for case and outer space, the first counts, before the check
    for missing ones.
    """
    from bindery.operators.dedup import keep_first

    key = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("title", "author")]
    return keep_first(rows, key, [F.col(o) for o in order]).where(text.nonblank("title").isNotNull() & text.nonblank("author").isNotNull()).orderBy(*order).limit(limit)
