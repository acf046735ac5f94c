"""The three batch entry points: scan result pages, enrich records, integrate two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.config import Settings
from bindery.functions import codes, isbn, keys, text
from bindery.operators import dedup, matching, quality, ranking, shared, survivorship
from bindery.operators.survivorship import CORE, EXTRA, LEFT, RIGHT, Policy
from bindery.sources import html, http, lookup, readers, schemas, sinks

COPIED = ["editorial", "fecha_publicacion", "idioma", "categoria", "precio", "moneda", "paginas", "formato", "autores"]


def scan_pages(pages: DataFrame, limit: int = 15, base: str = "", page: str = "page_id") -> DataFrame:
    """Stored result pages to at most ``limit`` distinct records, in page order."""
    rows = html.parse_results(pages, base=base, keep=(page,))
    return html.first_results(rows, [page, "pos"], limit)


def enrich(records: DataFrame, candidates: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(volumes, trace): per record the best candidate, and all candidates with their scores.

    The best is the first by score, ISBN, year and position; in ``compat`` it is what an in-order walk ends with,
    which ``ranking.best_by_fold`` tells and which tests the ISBNs that an item lists, where a column has them.
    """
    pairs = records.select("rec_id", "input_index", F.col("title").alias("q_title"), F.col("author").alias("q_author"), F.col("isbn13").alias("q_isbn")).join(candidates, "rec_id", "left")
    scored = ranking.scored(pairs, "q_title", "q_author", "q_isbn", "title", "authors", "isbn13")
    found = scored.where(F.col("gb_id").isNotNull())
    return ranking.best_by_walk(found, "rec_id") if compat else ranking.best_candidate(found, "rec_id"), sinks.trace(scored)


def normalize_left(df: DataFrame, compat: bool = False) -> DataFrame:
    """Records under canonical names with match keys; ``gr_index`` is their position."""
    renamed = df.withColumnsRenamed({"title": "titulo", "author": "autor_principal", "pub_date": "fecha_publicacion", "price_amount": "precio", "price_currency": "moneda", "language": "idioma", "input_index": "gr_index"})
    fold = text.fold_nfkd if compat else text.fold_latin
    title = F.coalesce(text.main_title("titulo", fold), text.normalize_whitespace(F.lower("titulo")))
    out = renamed.withColumns({"isbn13": F.trim(text.nonblank("isbn13")), "isbn10": F.trim(text.nonblank("isbn10")), "_match_title": title, "_match_author": text.match_author("autor_principal")})
    return out.withColumn("_match_key", text.match_key("_match_title", "_match_author", "None" if compat else ""))


def normalize_right(df: DataFrame, compat: bool = False) -> DataFrame:
    """Volumes under canonical names with lists, primary author and match keys; ``_csv_row`` is their position."""
    renamed = df.withColumnsRenamed({"title": "titulo", "authors": "autores", "publisher": "editorial", "pub_date": "fecha_publicacion", "language": "idioma", "categories": "categoria", "price_amount": "precio", "price_currency": "moneda"})
    lists = renamed.withColumns({"autores": text.distinct_in_order(text.listify("autores")), "categoria": text.distinct_in_order(text.listify("categoria")), "isbn13": F.trim(text.nonblank("isbn13")), "isbn10": F.trim(text.nonblank("isbn10")), "idioma": codes.normalize_language("idioma")})
    fold = text.fold_nfkd if compat else text.fold_latin
    out = lists.withColumn("autor_principal", F.get("autores", F.lit(0))).withColumns({"_match_title": text.main_title("titulo", fold), "_match_author": text.match_author("autor_principal")})
    return out.withColumn("_match_key", text.match_key("_match_title", "_match_author"))


def link(left: DataFrame, right: DataFrame, policy: Policy, held=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(merged, events): ISBNs assigned by key and by unique title, then the prioritised full outer join.

    ``held`` may write what is used more than once.
    """
    copied = [c for c in COPIED if c in right.columns]
    assigned, events = matching.unique_title_match(held(matching.first_match(left, right, copied), "by_key"), right, copied)
    return matching.merge(held(assigned, "assigned"), right, policy.compat), events


def build_dim(merged: DataFrame, policy: Policy, run_ts: str) -> DataFrame:
    """Canonical rows: semantic values, survivors with provenance, keys, and one row per key."""
    rows = survivorship.canonicalized(merged.where(F.col("_source_type") != "gb_only"))
    base = rows.withColumns({c: survivorship.coalesced(rows, c) for c in ("fecha_publicacion", "idioma", "precio", "moneda")})
    told = survivorship.semantic(base, policy.compat)
    if policy.compat:  # values that failed come back raw
        refill = {c: F.coalesce(F.col(c).cast("string"), *(F.col(c + s).cast("string") for s in ("_gr", "_gb") if c + s in told.columns)) for c in ("fecha_publicacion", "idioma", "moneda")}
        refill["precio"] = F.coalesce("precio", *(codes.parse_price(F.col("precio" + s).cast("string")) for s in ("_gr", "_gb") if "precio" + s in told.columns))
        told = told.withColumns(refill)
    else:  # the canonical values are final
        told = told.drop(*(c + s for c in ("fecha_publicacion", "idioma", "precio", "moneda") for s in ("_gr", "_gb")))
    fields = tuple(f for f in (*CORE, *EXTRA) if any(f + s in told.columns for s in ("", "_gr", "_gb")))
    kept = survivorship.survivors(told, fields, policy)
    norm = isbn.normalize("isbn13")["isbn13"]
    kept = kept.withColumn("isbn13_norm", norm).withColumn("isbn13_valido", F.col("isbn13_norm").isNotNull())
    key = F.coalesce("isbn13_norm", keys.canonical_key("titulo", "autor_principal", "editorial" if "editorial" in fields else None))
    kept = kept.withColumn("canonical_key", key)
    own = F.col("isbn13") if policy.compat else F.col("isbn13_norm")
    kept = kept.withColumns({"book_id": keys.book_id(own, F.col("isbn13_valido"), "canonical_key"), "ts_ultima_actualizacion": F.lit(run_ts)})
    flags = ["fecha_publicacion_valida", "fecha_publicacion_parcial", "idioma_valido", "moneda_valida"]
    out = kept.select("gr_index_gr", *fields, *flags, "isbn13_norm", "isbn13_valido", "canonical_key", "book_id", "provenance", "ts_ultima_actualizacion").withColumnRenamed("gr_index_gr", "gr_index")
    return out if policy.compat else dedup.keep_best(out, "book_id", ["titulo", "autor_principal", "isbn13"], "gr_index")


def build_detail(left: DataFrame, right: DataFrame, run_ts: str, left_file: str = "records", right_file: str = "volumes") -> DataFrame:
    """All rows of both sources, numbered within their source, with candidate keys."""
    both = left.withColumns({"source_name": F.lit(LEFT), "source_file": F.lit(left_file), "_order": F.col("gr_index").cast("bigint")}).unionByName(right.withColumns({"source_name": F.lit(RIGHT), "source_file": F.lit(right_file), "_order": F.col("_csv_row").cast("bigint")}), allowMissingColumns=True)
    norm = isbn.normalize("isbn13")["isbn13"]
    candidate = F.coalesce(norm, keys.canonical_key("titulo", "autor_principal"))
    numbered = readers.numbered(both, "row_number", "_order", by=["source_name"]).drop("_order")
    return numbered.withColumns({"ts_ingest": F.lit(run_ts), "book_id_candidato": candidate, "isbn13_valido": norm.isNotNull()})


def metrics_relation(dim: DataFrame) -> DataFrame:
    """The relation that compatible metrics count: one row per isbn13, all rows without one collapsed."""
    return dedup.keep_first(dim, [F.col("isbn13")], [F.col("gr_index")])


def integrate(records: DataFrame, volumes: DataFrame, run_ts: str, policy: Policy | None = None, held=lambda df, name: df) -> dict[str, DataFrame]:
    """dim, detail, metrics and events of two sources; ``input_index`` and ``_csv_row`` order them.

    ``held`` gets each table that several results use, with its name, and returns it, written or as it is.
    """
    chosen = policy or Policy()
    left, right = held(normalize_left(records, chosen.compat), "left"), held(normalize_right(volumes, chosen.compat), "right")
    merged, events = link(left, right, chosen, held)
    dim, detail = held(build_dim(merged, chosen, run_ts), "dim"), held(build_detail(left, right, run_ts), "detail")
    told = quality.metrics(metrics_relation(dim) if chosen.compat else dim, detail)
    summary = told.select(F.lit("integrate_run_summary").alias("event"), F.lit(run_ts).alias("ts_utc"), F.col("filas_totales").alias("records_input"))
    return {"merged": merged, "dim": dim, "detail": detail, "metrics": told, "events": events.withColumn("ts_utc", F.lit(run_ts)).unionByName(summary, allowMissingColumns=True)}


def run(spark: SparkSession, records: str, volumes: str, out: str, run_ts: str, policy: Policy | None = None) -> None:
    """Read both sources, integrate, and write dim, detail, metrics and the event log below ``out``.

    Normalisation and linkage run once: what several targets use is written, dim and detail as targets and the rest
    in the shared folder.
    """
    targets = {"dim": f"{out}/dim_book.parquet", "detail": f"{out}/book_source_detail.parquet"}

    def held(df: DataFrame, name: str) -> DataFrame:
        if name not in targets:
            return shared.stored(df, name)
        sinks.write_parquet(df, targets[name])
        return spark.read.parquet(targets[name])

    volumes_read = readers.scan_order(readers.read_volumes(spark, volumes))
    found = integrate(readers.read_records(spark, records), volumes_read, run_ts, policy, held)
    metrics = quality.safe_metrics(found["metrics"], found["dim"])
    sinks.write_metrics(metrics, f"{out}/quality_metrics")
    sinks.append_events(found["events"], f"{out}/rules")


def run_scan(spark: SparkSession, client: http.Client, url: str, query: str, out: str, run_ts: str, max_records: int = 15, max_pages: int = 3, pause: float = 0.8) -> None:
    """Search pages, one after the other as each decides about the next, to an envelope of records at ``out``."""
    count = lambda page: len(html.result_rows(page))
    held = list(http.search_pages(lambda k: client.fetch(http.search_url(url, query, k)), count, max_records, max_pages, pause, sleep=client.sleep))
    pages = spark.createDataFrame(held, "page int, html string")
    records = scan_pages(pages, max_records, url, "page")
    order = readers.numbered(records.withColumn("_place", F.monotonically_increasing_id()), "_n", "_place").drop("_place")
    fields = [c.split()[0] for c in schemas.RECORD.split(", ")]
    kinds = dict(c.split() for c in schemas.RECORD.split(", "))
    full = order.select("_n", *(F.col(c).cast(kinds[c]) if c in records.columns else F.lit(None).cast(kinds[c]).alias(c) for c in fields))
    sinks.write_envelope(full, out, order="_n", source="goodreads", base_url=url, query=query, user_agent=client.agents[0], fetched_at=run_ts)


def run_enrich(spark: SparkSession, client: http.Client, url: str, records: str, out: str, settings: Settings, compat: bool = False) -> None:
    """Look up every record of an envelope; write volumes, the candidate trace and the request log below ``out``.

    A record asks for at most ``settings.max_results`` candidates.  The answers are written before they are used, so
    each address is asked once unless a task is lost.
    """
    rows = readers.read_records(spark, records).withColumn("rec_id", F.col("input_index").cast("string"))
    q = F.coalesce(lookup.query_string(F.col("isbn13"), F.col("title"), F.col("author")), F.lit(settings.fallback_query()))
    asked = rows.select("rec_id", "input_index", "title", "author", "isbn13", q.alias("query"))
    asked = asked.withColumn("url", lookup.request_url(F.col("query"), url, settings.max_results, settings.api_key, settings.country))
    answers = shared.stored(http.called(asked, client, pause=settings.rate_limit), "answers")
    calls = answers.where("url is not null").select("ts_utc", F.lit("enrich").alias("step"), F.lit("google_books").alias("source_name"), F.col("url").alias("url_or_file"), "status_code", "duration_s", "user_agent", "notes")
    sinks.append_requests(calls, f"{out}/requests")
    items = answers.select("rec_id", F.posexplode(F.slice(readers.parse_items(F.col("body")), 1, settings.max_results)).alias("pos", "item"))
    item = F.col("item")
    flat = items.select("rec_id", "pos", *lookup.item_row(item), lookup.item_isbn13(item).alias("any_isbn13"))
    found = flat.select("rec_id", "pos", "gb_id", F.col("any_isbn13").alias("isbn13"), F.col("isbn13").alias("listed_isbn13"), "title", "authors", F.col("pub_date").alias("publishedDate"), "price_amount", "price_currency", F.lit(settings.country).cast("string").alias("price_country"), F.struct(*(c for c in flat.columns if c not in ("rec_id", "any_isbn13"))).alias("volume"))
    best, trace = enrich(asked, shared.stored(found, "candidates"), compat)
    sinks.write_csv(best.select("volume.*").drop("pos"), f"{out}/volumes.csv")
    sinks.write_trace(trace, asked, f"{out}/candidates")
