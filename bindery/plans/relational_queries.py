"""Queries of ranking, deduplication, linkage, survivorship and quality, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text
from bindery.operators import dedup, matching, quality, ranking, survivorship
from bindery.plans import pipeline
from bindery.plans.derived import LINKED, isbn13, linked, sources, table
from bindery.sources import readers

RUN_TS = "2025-01-01T00:00:00+00:00"


# Ranking ------------------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five candidates for every part: the parts after it.

    Both sides grow with the table, so neither is broadcast, however small its files are.
    """
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("rec_id"), F.concat_ws(" ", "p_name", "p_brand").alias("q_title"), F.col("p_type").alias("q_author"), F.lit(None).cast("string").alias("q_isbn"), F.posexplode(F.sequence(F.lit(1), F.lit(5))).alias("pos", "step"))
    found = p.select(F.col("p_partkey").alias("gb_id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.col("p_type").alias("authors"), F.when(F.col("p_partkey") % 3 == 0, isbn13(F.col("p_partkey"))).alias("isbn13"), (F.lit(1990) + F.col("p_size")).cast("string").alias("publishedDate"))
    pairs = asked.join(found.hint("merge"), F.col("rec_id") + F.col("step") == F.col("gb_id"))
    return ranking.scored(pairs, "q_title", "q_author", "q_isbn", "title", "authors", "isbn13")


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_candidate(_candidates(spark, sf_dir), "rec_id").select("rec_id", "gb_id", F.round("score", 6).alias("score"))


def candidate_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.max_score(_candidates(spark, sf_dir), "rec_id").select("rec_id", F.round("best_score", 6).alias("best_score"))


def best_candidate_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_by_walk(_candidates(spark, sf_dir), "rec_id").select("rec_id", "gb_id")


def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec_id"), "o_orderkey", F.col("o_totalprice").alias("score"), F.lit(None).cast("string").alias("isbn13"), F.lit(None).cast("string").alias("publishedDate"), F.col("o_orderkey").alias("pos"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rec_id"), "c_name")
    return ranking.top_one_lookup(customers, orders, "rec_id").select(F.col("rec_id").alias("c_custkey"), F.col("best_o_orderkey").alias("o_orderkey"), F.col("best_score").alias("total"))


def running_match_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labelled, F.col("doc_id") == F.col("l_doc"), "left")
    total = readers.running_total(rows, "total", F.col("l_doc").isNotNull().cast("bigint"), "doc_id")
    return total.select("doc_id", F.when(F.col("l_doc").isNotNull(), F.col("total")).alias("csv_row_number"))


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "n", "p_retailprice", "p_partkey").select("p_partkey", "n")


def row_numbers_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.with_ordinal(table(spark, sf_dir, "documents").select("source", "doc_id"), "n", "doc_id", by=["source"])


# Deduplication, order, limits ---------------------------------------------------------------------------------


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.lower(F.trim("text"))).alias("title"))
    return dedup.keep_first(rows, [F.col("title"), F.col("lang")], [F.col("doc_id")]).select("doc_id", "lang")


def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"), "quality", "toxic")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labels, F.col("doc_id") == F.col("l_doc"), "left")
    return dedup.keep_best(rows, "source", ["lang", "quality", "toxic"], "doc_id").select("source", "doc_id", "quality")


def dedup_null_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"), "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, F.col("doc_id") == F.col("l_doc"), "left").drop("l_doc")
    return dedup.keep_first(rows, [F.col("quality")], [F.col("doc_id")])


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(table(spark, sf_dir, "part"), "p_name", 10)


def sort_nulls_last_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("name"))
    return rows.orderBy(F.asc_nulls_last("name"), F.desc("p_partkey")).limit(25)


# Linkage ------------------------------------------------------------------------------------------------------


def join_isbn_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = linked(spark, sf_dir)
    return matching.isbn_join(left, right).select(F.col("gr_index_gr").alias("gr_index"), F.col("_csv_row_gb").alias("csv_row"))


def join_key_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = linked(spark, sf_dir)
    return matching.key_join(left, right, compat=True).select(F.col("gr_index_gr").alias("gr_index"), F.col("_csv_row_gb").alias("csv_row"))


def lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = linked(spark, sf_dir)
    return matching.first_match(left, right, ["editorial"]).select("gr_index", "isbn13", "isbn13_source_row", F.col("editorial_gb").alias("editorial"))


def lookup_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = linked(spark, sf_dir)
    return matching.unique_title_match(matching.first_match(left, right, []), right, [])[0].select("gr_index", "isbn13", F.col("isbn13_source_row").alias("source_row"))


def ambiguous_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = linked(spark, sf_dir)
    events = matching.unique_title_match(matching.first_match(left, right, []), right, [])[1]
    return events.select("match_title", "gr_index", F.array_join(F.transform("gb_candidate_rows", lambda x: x.cast("string")), ",").alias("candidate_rows"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.link(*linked(spark, sf_dir), survivorship.Policy())[0]


def anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).where(F.col("_source_type") == "gb_only").select(F.col("_csv_row_gb").alias("csv_row"))


def merge_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select(F.col("gr_index_gr").alias("gr_index"), F.col("_csv_row_gb").alias("csv_row"), F.col("_source_type").alias("source_type"))


def integrate_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sources(spark, sf_dir)
    dim = pipeline.integrate(left, right, RUN_TS)["dim"]
    return dim.select("gr_index", "isbn13_norm", "book_id", "titulo", "moneda", "fecha_publicacion", F.get_json_object("provenance", "$.moneda").alias("moneda_source"))


def integrate_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sources(spark, sf_dir)
    detail = pipeline.integrate(left, right, RUN_TS)["detail"]
    return detail.select("source_name", "row_number", F.coalesce("gr_index", "_csv_row").alias("key"), "isbn13_valido", F.array_join("autores", "|").alias("autores"))


def integrate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sources(spark, sf_dir)
    told = pipeline.integrate(left, right, RUN_TS)["metrics"]
    return told.select("filas_totales", F.col("nulos_por_campo")["isbn13"].alias("nulls_isbn13"), "duplicados_book_id", F.col("filas_por_fuente")["goodreads"].alias("left_rows"), F.col("filas_por_fuente")["google_books"].alias("right_rows"))


# Survivorship -------------------------------------------------------------------------------------------------


def _two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, F.col("p_name")).when(k % 6 == 1, F.lit(" ")).alias("titulo_gr"), F.col("p_type").alias("titulo_gb"), F.when(k % 5 == 0, F.lit("House")).alias("editorial_gb"), F.when(k % 3 == 0, F.lit("es")).alias("idioma"), F.when(k % 4 == 0, F.lit("en")).alias("idioma_gr"))


def coalesce_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _two_sided(spark, sf_dir)
    return df.select("p_partkey", survivorship.coalesced(df, "titulo").alias("titulo"), survivorship.coalesced(df, "idioma").alias("idioma"), survivorship.coalesced(df, "editorial").alias("editorial"))


def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = survivorship.Policy(priority={"idioma": ("", "_gr")})
    out = survivorship.survivors(_two_sided(spark, sf_dir), ("titulo", "editorial", "idioma"), policy)
    source = lambda name: F.get_json_object("provenance", f"$.{name}").alias(f"{name}_source")
    return out.select("p_partkey", "titulo", "editorial", "idioma", source("titulo"), source("editorial"), source("idioma"))


def canonicalize_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.canonicalized(_two_sided(spark, sf_dir)).select("p_partkey", "idioma")


# Quality ------------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"), "quality", "toxic")
    docs = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("l_doc"), "left")
    return docs.select(F.col("doc_id").alias("book_id"), F.md5("text").alias("isbn13"), F.col("lang").alias("idioma"), F.col("quality").cast("string").alias("titulo"), F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("source_name"), (F.col("quality") == 1).alias("idioma_valido"), (F.col("toxic") == 0).alias("isbn13_valido"), F.lit(" ").alias("moneda"))


def quality_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bundle(_labelled(spark, sf_dir), ("book_id", "titulo", "isbn13", "idioma", "moneda"))


def nulls_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir)
    return df.agg(*quality.null_counts(df, ("book_id", "titulo", "source_name", "moneda")))


def rows_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rows_per_source(_labelled(spark, sf_dir), ("source_name",))


def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir)
    return df.agg(quality.duplicates(df, "isbn13").alias("isbn13"), quality.duplicates(df, "idioma").alias("idioma"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir)
    return df.groupBy("idioma").agg(quality.completeness(df, ("titulo", "source_name", "moneda", "book_id")).alias("completeness"))


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assertions(quality_bundle(spark, sf_dir)).select("metric", F.round("value", 2).alias("value"), "threshold", "passed")


def blocking_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("titulo"))
    return quality.blocking(rows)


# Unions -------------------------------------------------------------------------------------------------------


def union_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


def union_recombine(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = linked(spark, sf_dir)
    having, lacking = left.where("isbn13 IS NOT NULL"), left.where("isbn13 IS NULL")
    return having.unionByName(lacking).select("gr_index", "isbn13")


def has_any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _two_sided(spark, sf_dir)
    return df.agg(*(F.bool_or(F.col(c).isNotNull()).alias(c) for c in df.columns), F.bool_or(text.nonblank(F.lit(" ")).isNotNull()).alias("blank"))


_SCORED = """p AS (SELECT p_partkey, lower(replace(p_name || ' ' || p_brand, '#', '')) AS t, lower(p_type) AS a, p_size FROM part),
pairs AS (SELECT x.p_partkey AS rec_id, y.p_partkey AS gb_id, y.p_partkey - x.p_partkey - 1 AS pos, y.p_partkey % 3 = 0 AS has_isbn, 1990 + y.p_size AS year, x.t AS x, y.t AS y, x.a AS ta, y.a AS tb
  FROM p x JOIN range(1, 6) s(k) ON true JOIN p y ON y.p_partkey = x.p_partkey + s.k),
scored AS (SELECT *, 0.0 + (greatest(0.0, 1 - CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y))) * 40.0
  + CAST(len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' ')))) AS DOUBLE) / greatest(len(list_distinct(string_split(x, ' '))), len(list_distinct(string_split(y, ' ')))) * 20.0)
  + CASE WHEN ta = tb THEN 1.0 ELSE 0.0 END * 40.0 AS score FROM pairs)"""
_LAB = """d AS (SELECT documents.doc_id AS book_id, md5(text) AS isbn13, lang AS idioma, CAST(quality AS VARCHAR) AS titulo, CASE WHEN documents.doc_id % 10 <> 0 THEN source END AS source_name,
  quality = 1 AS idioma_valido, toxic = 0 AS isbn13_valido FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)"""
_BUNDLE = """SELECT count(*) AS filas_totales, CAST(0 AS BIGINT) AS nulls_book_id, count(*) FILTER (titulo IS NULL) AS nulls_titulo, count(*) FILTER (isbn13 IS NULL) AS nulls_isbn13, count(*) FILTER (idioma IS NULL) AS nulls_idioma, count(*) AS nulls_moneda,
  CAST(0 AS DOUBLE) AS porcentaje_fechas_validas, round(100.0 * count(*) FILTER (idioma_valido) / CAST(count(*) AS DOUBLE), 2) AS porcentaje_idiomas_validos, CAST(0 AS DOUBLE) AS porcentaje_monedas_validas, round(100.0 * count(*) FILTER (isbn13_valido) / CAST(count(*) AS DOUBLE), 2) AS porcentaje_isbn13_validos,
  round(avg((4 + CASE WHEN titulo IS NOT NULL THEN 1 ELSE 0 END) / CAST(5 AS DOUBLE)) * 100, 2) AS completitud_promedio, count(isbn13) - count(DISTINCT isbn13) AS duplicados_isbn13, count(book_id) - count(DISTINCT book_id) AS duplicados_book_id FROM d"""
_TWO = """t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 6 = 1 THEN ' ' END AS gr, p_type AS gb, CASE WHEN p_partkey % 5 = 0 THEN 'House' END AS ed, CASE WHEN p_partkey % 3 = 0 THEN 'es' END AS base, CASE WHEN p_partkey % 4 = 0 THEN 'en' END AS lang_gr FROM part)"""

ORACLE = {
    "best_candidate": f"WITH {_SCORED} SELECT rec_id, gb_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, has_isbn DESC, year DESC, pos) AS n FROM scored) WHERE n = 1",
    "best_candidate_fold": f"WITH {_SCORED}, held AS (SELECT rec_id, list({{'gb_id': gb_id, 'score': score, 'isbn': CAST(has_isbn AS BOOLEAN), 'year': year}} ORDER BY pos) AS c FROM scored GROUP BY rec_id) SELECT rec_id, list_reduce(c, lambda b, x: CASE WHEN x.score > b.score OR (x.score = b.score AND ((x.isbn AND NOT b.isbn) OR x.year > b.year)) THEN x ELSE b END).gb_id AS gb_id FROM held",
    "candidate_max_score": f"WITH {_SCORED} SELECT rec_id, round(max(score), 6) AS best_score FROM scored GROUP BY rec_id",
    "lateral_top1": "SELECT c_custkey, o_orderkey, o_totalprice AS total FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) o ON o_custkey = c_custkey AND n = 1",
    "running_match_number": "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(count(l.doc_id) OVER (ORDER BY d.doc_id) AS BIGINT) END AS csv_row_number FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "row_numbers": "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS n FROM part",
    "row_numbers_by_source": "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) AS n FROM documents",
    "dedup_keep_first": "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY md5(lower(trim(text))), lang",
    "dedup_keep_best": "SELECT source, doc_id, quality FROM (SELECT d.doc_id, source, quality, row_number() OVER (PARTITION BY source ORDER BY (CASE WHEN quality IS NOT NULL THEN 2 ELSE 0 END) DESC, d.doc_id) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE n = 1",
    "dedup_null_collapse": "SELECT min(d.doc_id) AS doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality",
    "duplicate_groups": "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 ORDER BY n DESC, p_name LIMIT 10",
    "sort_nulls_last_limit": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name FROM part ORDER BY name NULLS LAST, p_partkey DESC LIMIT 25",
    "join_isbn_left": f"WITH {LINKED} SELECT l.gr_index, r1.csv_row FROM l LEFT JOIN r1 ON l.isbn13 = r1.isbn13 WHERE l.isbn13 IS NOT NULL",
    "join_key_nullsafe": f"WITH {LINKED} SELECT l.gr_index, r.csv_row FROM l LEFT JOIN r ON coalesce(l.mk, 'None|None') = coalesce(r.mk, 'None|None') WHERE l.isbn13 IS NULL",
    "lookup_first_match": f"WITH {LINKED} SELECT gr_index, coalesce(isbn13, got) AS isbn13, got_row AS isbn13_source_row, CASE WHEN got_row IS NOT NULL THEN 'House ' || (got_row % 5) END AS editorial FROM a1",
    "lookup_unique_match": f"WITH {LINKED} SELECT gr_index, isbn13, source_row FROM assigned",
    "ambiguous_events": f"WITH {LINKED} SELECT mt AS match_title, gr_index, array_to_string(all_rows, ',') AS candidate_rows FROM a2 WHERE i1 IS NULL AND n > 1",
    "anti_unmatched": f"WITH {LINKED} SELECT csv_row FROM merged WHERE source_type = 'gb_only'",
    "merge_full": f"WITH {LINKED} SELECT gr_index, csv_row, source_type FROM merged",
    "integrate_dim": f"""WITH {LINKED}, x AS (SELECT m.gr_index, coalesce(m.isbn13, r.isbn13) AS isbn13, m.csv_row,
        coalesce(CASE WHEN m.gr_index % 100 <> 7 THEN a.p_name || ' ' || a.p_brand || ': a story' END, CASE WHEN m.csv_row % 100 <> 7 THEN upper(b.p_name || ' ' || b.p_brand) END) AS title,
        coalesce(CASE WHEN m.gr_index % 100 <> 7 THEN a.p_type END, CASE WHEN m.csv_row % 100 <> 7 THEN b.p_type END) AS author
      FROM merged m JOIN part a ON a.p_partkey = m.gr_index LEFT JOIN part b ON b.p_partkey = m.csv_row LEFT JOIN r ON r.csv_row = m.csv_row WHERE source_type <> 'gb_only'),
      y AS (SELECT *, coalesce(isbn13, sha1(coalesce(lower(title), '') || '|' || coalesce(lower(author), '') || '|' || CASE WHEN csv_row IS NULL THEN '' ELSE 'house ' || (csv_row % 5) END || '|')) AS book_id,
        (CASE WHEN title IS NULL THEN 0 ELSE 1 END) + (CASE WHEN author IS NULL THEN 0 ELSE 1 END) AS filled FROM x),
      z AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY filled DESC, gr_index) AS n FROM y)
      SELECT gr_index, isbn13 AS isbn13_norm, book_id, title AS titulo, CASE WHEN gr_index % 4 = 0 THEN 'USD' WHEN csv_row IS NOT NULL THEN 'EUR' END AS moneda,
        CASE WHEN gr_index % 2 = 0 THEN '2020-01-' || lpad(CAST(gr_index % 28 + 1 AS VARCHAR), 2, '0') WHEN csv_row IS NOT NULL THEN '2019-01-01' END AS fecha_publicacion,
        CASE WHEN gr_index % 4 = 0 OR csv_row IS NOT NULL THEN 'merged' END AS moneda_source FROM z WHERE n = 1""",
    "integrate_detail": f"WITH {LINKED} SELECT 'goodreads' AS source_name, row_number() OVER (ORDER BY gr_index) AS row_number, gr_index AS key, isbn13 IS NOT NULL AS isbn13_valido, NULL AS autores FROM l UNION ALL SELECT 'google_books', row_number() OVER (ORDER BY csv_row), csv_row, isbn13 IS NOT NULL, CASE WHEN mt IS NOT NULL THEN p_type || '|Other' END FROM r JOIN part ON p_partkey = csv_row",
    "coalesce_priority": f"WITH {_TWO} SELECT p_partkey, coalesce(gr, gb) AS titulo, coalesce(base, lang_gr) AS idioma, ed AS editorial FROM t",
    "survivors": f"WITH {_TWO} SELECT p_partkey, coalesce(nullif(trim(gr), ''), gb) AS titulo, ed AS editorial, coalesce(base, lang_gr) AS idioma, CASE WHEN nullif(trim(gr), '') IS NOT NULL THEN 'goodreads' ELSE 'google_books' END AS titulo_source, CASE WHEN ed IS NOT NULL THEN 'google_books' END AS editorial_source, CASE WHEN base IS NOT NULL THEN 'merged' WHEN lang_gr IS NOT NULL THEN 'goodreads' END AS idioma_source FROM t",
    "canonicalize_suffixes": f"WITH {_TWO} SELECT p_partkey, coalesce(base, lang_gr) AS idioma FROM t",
    "quality_bundle": f"WITH {_LAB} {_BUNDLE}",
    "nulls_by_column": f"WITH {_LAB} SELECT count(*) FILTER (book_id IS NULL) AS nulls_book_id, count(*) FILTER (titulo IS NULL) AS nulls_titulo, count(*) FILTER (source_name IS NULL) AS nulls_source_name, count(*) AS nulls_moneda FROM d",
    "rows_per_source": f"WITH {_LAB} SELECT coalesce(source_name, 'unknown') AS source, count(*) AS n FROM d GROUP BY 1",
    "duplicate_counts": f"WITH {_LAB} SELECT count(isbn13) - count(DISTINCT isbn13) AS isbn13, count(idioma) - count(DISTINCT idioma) AS idioma FROM d",
    "completeness": f"WITH {_LAB} SELECT idioma, round(avg((2 + CASE WHEN titulo IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN source_name IS NOT NULL THEN 1 ELSE 0 END) / CAST(4 AS DOUBLE)) * 100, 2) AS completeness FROM d GROUP BY idioma",
    "assertions": f"WITH {_LAB}, b AS ({_BUNDLE}), u AS (UNPIVOT (SELECT porcentaje_fechas_validas, porcentaje_idiomas_validos, porcentaje_monedas_validas, porcentaje_isbn13_validos, completitud_promedio, CAST(duplicados_isbn13 AS DOUBLE) AS duplicados_isbn13, CAST(duplicados_book_id AS DOUBLE) AS duplicados_book_id FROM b) ON COLUMNS(*) INTO NAME metric VALUE v) SELECT metric, round(v, 2) AS value, CAST(t AS DOUBLE) AS threshold, CASE WHEN metric LIKE 'dup%' THEN v <= t ELSE v >= t END AS passed FROM (SELECT metric, v, CASE metric WHEN 'porcentaje_idiomas_validos' THEN 95.0 WHEN 'porcentaje_monedas_validas' THEN 95.0 WHEN 'duplicados_isbn13' THEN 0.0 WHEN 'duplicados_book_id' THEN 0.0 ELSE 90.0 END AS t FROM u)",
    "blocking_assertions": "SELECT count(*) AS n, count(*) AS titled, CAST(0 AS BIGINT) AS twice, true AS passed FROM part",
    "union_detail": "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier",
    "union_recombine": f"WITH {LINKED} SELECT gr_index, isbn13 FROM l",
    "has_any_value": f"WITH {_TWO} SELECT bool_or(p_partkey IS NOT NULL) AS p_partkey, bool_or(gr IS NOT NULL) AS titulo_gr, bool_or(gb IS NOT NULL) AS titulo_gb, bool_or(ed IS NOT NULL) AS editorial_gb, bool_or(base IS NOT NULL) AS idioma, bool_or(lang_gr IS NOT NULL) AS idioma_gr, false AS blank FROM t",
}
ORACLE["integrate_metrics"] = f"SELECT (SELECT count(*) FROM ({ORACLE['integrate_dim']})) AS filas_totales, (SELECT count(*) FROM ({ORACLE['integrate_dim']}) WHERE isbn13_norm IS NULL) AS nulls_isbn13, CAST(0 AS BIGINT) AS duplicados_book_id, (SELECT count(*) FROM part WHERE p_partkey % 3 <> 2) AS left_rows, (SELECT count(*) FROM part WHERE p_partkey % 3 <> 0) AS right_rows"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE}


