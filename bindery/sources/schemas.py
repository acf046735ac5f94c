"""Declared schemas of sources and targets."""

from __future__ import annotations

RECORD = "title string, author string, rating double, ratings_count bigint, book_url string, isbn10 string, isbn13 string, pub_date string, price_amount double, price_currency string"
METADATA = "source string, base_url string, query string, user_agent string, fetched_at string, record_count bigint"
ENVELOPE = f"metadata struct<{', '.join(f.replace(' ', ':', 1) for f in METADATA.split(', '))}>, records array<struct<{', '.join(f.replace(' ', ':', 1) for f in RECORD.split(', '))}>>"
VOLUME = "gb_id string, title string, subtitle string, authors string, publisher string, pub_date string, language string, categories string, isbn13 string, isbn10 string, price_amount double, price_currency string, paginas int, formato string"
CANDIDATE = "gb_id string, score double, isbn13 string, title string, authors string, publishedDate string, price_amount double, price_currency string, price_country string"
TRACE = f"rec_id string, input_index bigint, csv_row_number bigint, title string, author string, isbn13_input string, best_score double, candidates array<struct<{', '.join(f.replace(' ', ':', 1) for f in CANDIDATE.split(', '))}>>"
ITEM = """id string, selfLink string,
volumeInfo struct<title:string,subtitle:string,authors:array<string>,publisher:string,publishedDate:string,language:string,
categories:array<string>,pageCount:int,printType:string,format:string,infoLink:string,canonicalVolumeLink:string,
industryIdentifiers:array<struct<type:string,identifier:string>>>,
saleInfo struct<country:string,saleability:string,buyLink:string,retailPrice:struct<amount:double,currencyCode:string>,
offers:array<struct<listPrice:struct<amountInMicros:bigint,currencyCode:string>>>>"""
REQUEST_LOG = "ts_utc string, step string, source_name string, url_or_file string, status_code string, rows_fetched string, duration_s double, user_agent string, notes string"
EVENT = "event string, ts_utc string, match_title string, gr_index bigint, gb_candidate_rows array<bigint>, records_input bigint, notes string"
