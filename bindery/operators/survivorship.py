"""One value per field from several sources, and where it came from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import codes, dates, text

LEFT, RIGHT = "goodreads", "google_books"
#: Fields that the left source leads, and those that the right source may fill.
CORE = ("titulo", "autor_principal", "rating", "ratings_count", "book_url", "isbn10", "isbn13")
EXTRA = ("editorial", "fecha_publicacion", "idioma", "paginas", "formato", "categoria", "precio", "moneda")


@dataclass(frozen=True)
class Policy:
    """What survives: per field the suffixes in order; ``compat`` keeps every quirk of the batch it replaces."""

    compat: bool = False
    priority: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def order(self, name: str) -> tuple[str, ...]:
        default = ("_gr", "", "_gb") if name in CORE else (("", "_gb", "_gr") if self.compat else ("_gr", "", "_gb"))
        return self.priority.get(name, default)


def coalesced(df: DataFrame, name: str, suffixes: tuple[str, ...] = ("", "_gr", "_gb")) -> Column:
    """The first value that is not null; blanks count as values."""
    there = [F.col(name + s) for s in suffixes if name + s in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def canonicalized(df: DataFrame, suffixes: tuple[str, ...] = ("_gr", "_gb")) -> DataFrame:
    """Suffixed columns fill the nulls of their base column where there is one."""
    out = {}
    for c in df.columns:
        for s in suffixes:
            if c.endswith(s) and c[: -len(s)] in df.columns:
                base = c[: -len(s)]
                out[base] = F.coalesce(out.get(base, F.col(base)), F.col(c))
    return df.withColumns(out) if out else df


def filled(c: Column, kind: str) -> Column:
    """The value, or null if it is blank."""
    return text.nonblank(c) if kind == "string" else c


def survivors(df: DataFrame, fields: tuple[str, ...], policy: Policy) -> DataFrame:
    """``df`` with the surviving value of each field and ``provenance``, a JSON object of their sources."""
    kinds = dict(df.dtypes)
    values, sources = {}, []
    for name in fields:
        options = [(s, filled(F.col(name + s), kinds[name + s])) for s in policy.order(name) if name + s in kinds]
        if not options:
            sources.append(F.lit(None).cast("string").alias(name))
            continue
        values[name] = F.coalesce(*(v for _, v in options))
        source = F.lit(None).cast("string")
        for suffix, value in reversed(options):
            source = F.when(value.isNotNull(), F.lit(_origin(name, suffix, policy))).otherwise(source)
        marks = [F.col(c) for c in ("isbn13_source", "isbn13_source_gr", "isbn13_source_gb") if c in kinds] if name == "isbn13" else []
        sources.append((F.when(values[name].isNotNull(), F.coalesce(*marks, source)) if marks else source).alias(name))
    return df.withColumns(values | {"provenance": F.to_json(F.struct(*sources), {"ignoreNullFields": "false"})})


def _origin(name: str, suffix: str, policy: Policy) -> str:
    if policy.compat and name in EXTRA:
        return "merged" if suffix == "_gr" else RIGHT
    return {"_gr": LEFT, "_gb": RIGHT}.get(suffix, LEFT if name in CORE else "merged")


def semantic(df: DataFrame, compat: bool = False) -> DataFrame:
    """Dates, languages, currencies and prices in canonical form, with flags.

    A value that fails becomes null and stays in ``*_raw``.  The flags of an absent column are false.
    """
    there = set(df.columns)
    none = F.lit(None).cast("string")
    get = lambda c: F.col(c).cast("string") if c in there else none
    date = dates.parse_date(get("fecha_publicacion"), compat)
    lang, money = codes.normalize_language(get("idioma")), codes.normalize_currency(get("moneda"))
    lang_ok = codes.valid_language(lang)
    return df.withColumns({
        "fecha_publicacion_raw": get("fecha_publicacion"),
        "fecha_publicacion": date["iso"],
        "fecha_publicacion_parcial": date["partial"],
        "fecha_publicacion_valida": date["iso"].isNotNull(),
        "idioma_raw": get("idioma"),
        "idioma": F.when(lang_ok, lang),
        "idioma_valido": lang_ok,
        "moneda_raw": get("moneda"),
        "moneda": money,
        "moneda_valida": codes.valid_currency(money),
        "precio_raw": get("precio"),
        "precio": codes.parse_price(get("precio")),
    })
