"""Language and currency codes, and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.text import col, let

#: Currency codes that are accepted.
CURRENCIES = (
    "USD", "EUR", "GBP", "JPY", "CNY", "AUD", "CAD", "CHF", "MXN", "BRL",
    "SEK", "NOK", "DKK", "INR", "KRW", "ZAR", "SGD", "HKD", "NZD", "TRY",
    "RUB", "AED", "SAR", "COP", "CLP", "ARS", "THB", "IDR", "MYR", "PHP",
    "PLN", "HUF", "ILS", "VND", "EGP", "TWD", "KWD", "QAR", "BHD", "OMR",
)
#: Currency by symbol, in the order in which a text is searched for them.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "R$": "BRL"}
#: Currency by country or top-level domain.
COUNTRIES = {"ES": "EUR", "US": "USD", "GB": "GBP", "UK": "GBP", "DE": "EUR", "FR": "EUR", "IT": "EUR"}
#: Language tags that are accepted as they are.
LANGUAGES = ("en", "en-US", "en-GB", "es", "es-ES", "pt-BR", "fr", "de", "it")


def _trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def normalize_language(c: Column | str) -> Column:
    """Lower case first, two-letter parts after it upper case, others untouched; null for null and empty."""
    parts = F.split(_trimmed(c), "-")
    told = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 2, F.upper(p)).otherwise(p))
    return F.when(col(c) != "", F.array_join(told, "-"))


def valid_language(c: Column | str) -> Column:
    s = _trimmed(c)
    return F.coalesce((F.length(s) >= 2) & (s.isin(*LANGUAGES) | s.rlike(r"^[a-zA-Z]{2,3}(?:-[a-zA-Z0-9]{2,8})*$")), F.lit(False))


def normalize_currency(c: Column | str) -> Column:
    """The code in a text: its letters, the symbol that it is, a symbol in it, or its first three capitals."""
    return let(_trimmed(c), _currency)


def _currency(s: Column) -> Column:
    up = F.upper(s)
    letters = F.regexp_replace(up, r"\P{L}", "")
    out = F.when(s == "", None).when(letters.isin(*CURRENCIES), letters)
    for symbol, code in SYMBOLS.items():
        out = out.when(s == symbol, code)
    for symbol, code in SYMBOLS.items():
        out = out.when(F.contains(s, F.lit(symbol)), code)
    three = F.regexp_extract(up, "([A-Z]{3})", 1)
    return out.when(three.isin(*CURRENCIES), three)


def valid_currency(c: Column | str) -> Column:
    return F.coalesce(F.upper(_trimmed(c)).isin(*CURRENCIES), F.lit(False))


def currency_of_symbol(c: Column | str) -> Column:
    return _looked_up(SYMBOLS, col(c))


def currency_of_country(c: Column | str) -> Column:
    return _looked_up(COUNTRIES, F.upper(_trimmed(c)))


def currency_of_link(c: Column | str) -> Column:
    """(currency, country) by the top-level domain of an address."""
    # Fixed value: the country's part of an address.
    domain = F.upper(F.regexp_extract(col(c), r"https?://(?:www\.)?[^/]+\.([a-z]{2,3})(?:/|$)", 1))
    code = _looked_up(COUNTRIES, domain)
    return F.struct(code.alias("currency"), F.when(code.isNotNull(), domain).alias("country"))


def parse_price(c: Column | str) -> Column:
    """A price string as a number: comma as point, other marks dropped; null if that is no number."""
    return F.regexp_replace(F.replace(col(c).cast("string"), F.lit(","), F.lit(".")), r"[^0-9.\-]", "").try_cast("double")


def sale_price(sale: Column | str) -> Column:
    """(amount, currency, country) of a sale: retail price, else first offer in micros, else currency by domain."""
    s = col(sale)
    country = F.upper(F.trim(F.coalesce(s["country"], s["saleability"])))
    offer = F.get(F.filter(s["offers"], lambda o: o["listPrice"]["amountInMicros"].isNotNull()), F.lit(0))["listPrice"]
    priced = lambda amount, currency: F.struct(amount.cast("double").alias("amount"), F.upper(F.trim(currency)).alias("currency"), country.alias("country"))
    link = currency_of_link(s["buyLink"])
    by_link = F.struct(F.lit(None).cast("double").alias("amount"), link["currency"].alias("currency"), link["country"].alias("country"))
    return F.when(s["retailPrice"]["amount"].isNotNull(), priced(s["retailPrice"]["amount"], s["retailPrice"]["currencyCode"])).when(offer.isNotNull(), priced(offer["amountInMicros"] / 1_000_000, offer["currencyCode"])).otherwise(by_link)


def repaired_currency(currency: Column | str, country: Column | str) -> Column:
    """A currency normalised, mapped from its symbol, or told by the country, whichever comes first."""
    c = col(currency)
    return F.coalesce(F.when(_trimmed(c).rlike("^[A-Za-z]{3}$"), F.upper(_trimmed(c))), normalize_currency(c), currency_of_country(country))


def page_price(html: Column | str) -> Column:
    """(amount, currency) on a page: price meta tag, else symbol before a number, else an element of a price class.

    A bare R counts as a symbol and gives a price without a currency.
    """
    h = col(html)
    meta = F.regexp_extract(h, r"""(?is)<meta\b(?=[^>]*\bitemprop=["']price["'])[^>]*\bcontent=["']([^"']*)["']""", 1)
    by_meta = F.replace(F.regexp_replace(meta, "[^0-9.,-]", ""), F.lit(","), F.lit(".")).try_cast("double")
    # A symbol before an amount, and the classes of price elements.
    marked = r"([€£¥R$])\s?([0-9]+[0-9.,]*)"
    amount = lambda text: F.replace(F.regexp_extract(text, marked, 2), F.lit(","), F.lit(".")).try_cast("double")
    classed = F.regexp_replace(F.regexp_extract(h, r"""(?is)class=["'][^"']*\b(?:buyButton|price|retailPrice|purchase)\b[^"']*["'][^>]*>(.*?)</""", 1), "<[^>]*>", "")
    near = F.call_function("regexp_extract", h, F.concat(F.lit(r"([€$£¥R])\s?"), F.substring(by_meta.cast("bigint").cast("string"), 1, 3)), F.lit(1))
    symbol = F.when(by_meta.isNotNull(), near).when(amount(h).isNotNull(), F.regexp_extract(h, marked, 1)).otherwise(F.regexp_extract(classed, marked, 1))
    return F.struct(F.coalesce(by_meta, amount(h), amount(classed)).alias("amount"), currency_of_symbol(symbol).alias("currency"))
