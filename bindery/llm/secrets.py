"""Secret scan: fixed patterns, and character Markov models that tell random strings from identifiers.

Everything here is DataFrame and SQL functions.  Two first-order models over the characters of tokens are
trained from labelled samples, one on random strings and one on ordinary identifiers; a token of a text that is
likelier under the first by more than a calibrated log-likelihood ratio is a span of kind ``markov``.

Judged are whole runs of 20 or more characters of the alphabet with a digit, and within and beside them the parts
between separators: of 12 or more with letters and digits, or of 20 or more letters with a capital inside.  The
threshold of a part depends on its length.  Not judged are shorter parts, which have too few transitions to tell,
digits alone, which are numbers and dates, and fewer or plain letters, which are words of some language far more
often than keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions.text import let

#: Fixed patterns.  Greedy runs of the last two are maximal, so their least length may stand in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the models judge: long runs of one alphabet with a digit in them.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Parts that the models judge: letters and digits, or many letters of both cases.
PART = r"(?<![A-Za-z0-9])(?:(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{12,}+|(?=[A-Za-z][a-z]*+[A-Z])(?=[A-Z]*+[a-z])[A-Za-z]{20,}+(?![0-9]))"
#: The shortest part, and how many lengths share a threshold, up to ``LAST`` classes.
LEAST, STEP, LAST = 12, 4, 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Fixed words from which the sample of ordinary identifiers is put together.
ORDINARY = """account action address allow amount array author background balance before block board border bucket buffer button
cache calendar category chapter check child client cluster color column command comment commit config connection content
context control count country create current customer data database date default delete description detail device digest
directory disable document domain driver element email enable encoding error event example execute export extension factory
failure feature field file filter first folder format function gateway global group handler header height history host image
import index input instance integer interface internal invoice item journal kernel keyboard language layout level library
license limit line link list loader local location logger manager mapping master matrix memory message method metric model
module monitor name network node notify number object offset option order output package parameter parent parser partition
path pattern payment period pixel platform policy position prefix process product profile project property protocol""".split()
SAMPLES = 4000
_BLOCK = 256


def samples(spark: SparkSession, n: int = SAMPLES, seed: str = "sample") -> DataFrame:
    """(token, random): labelled samples by rule, half random strings and half ordinary identifiers."""
    words = F.array(*map(F.lit, ORDINARY))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(len(ORDINARY))) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    packed = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    size = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(21)).cast("int") + 20
    drawn = F.element_at(F.array(F.substr(packed, F.lit(1), size), F.substr(F.translate(packed, "+/", "-_"), F.lit(1), size), F.substr(digest, F.lit(1), size), F.upper(F.substr(F.regexp_replace(packed, "[+/]", "7"), F.lit(1), size))), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    parts = F.array(*(pick(k) for k in range(4)))
    number = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)).cast("string")
    camel = F.array_join(F.transform(parts, F.initcap), "")
    named = F.element_at(F.array(F.concat(F.array_join(parts, "_"), F.lit("_"), number), F.concat(F.array_join(parts, "-"), F.lit("-"), number), F.concat(camel, number), F.concat(F.array_join(parts, "/"), number), F.concat(F.upper(F.array_join(parts, "_")), number), F.concat(F.lit("2024-01-0"), number, F.lit("/"), F.array_join(parts, "_"))), (F.pmod("id", F.lit(6)) + 1).cast("int"))
    ids = spark.range(n)
    return ids.select(drawn.alias("token"), F.lit(1).alias("random")).unionAll(ids.select(named.alias("token"), F.lit(0).alias("random")))


def part_samples(spark: SparkSession, n: int = SAMPLES, seed: str = "sample") -> DataFrame:
    """(token, random): the same for parts without separators, from ``LEAST`` characters on."""
    words = F.array(*map(F.lit, ORDINARY))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(len(ORDINARY))) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit(f"{seed} part"), F.col("id").cast("string")), 256)
    packed = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")
    size = F.pmod(F.xxhash64("id", F.lit(99), F.lit(seed)), F.lit(25)).cast("int") + LEAST
    drawn = F.substr(F.element_at(F.array(packed, F.lower(packed), F.upper(packed), digest), (F.pmod("id", F.lit(4)) + 1).cast("int")), F.lit(1), size)
    number = F.pmod(F.xxhash64("id", F.lit(7), F.lit(seed)), F.lit(10_000)).cast("string")
    camel = lambda m: F.array_join(F.transform(F.array(*(pick(k) for k in range(m))), F.initcap), "")
    plain = lambda m: F.concat(*(pick(k) for k in range(m)))
    date = F.concat(F.lit("20"), F.lpad(F.pmod("id", F.lit(40)).cast("string"), 2, "0"), F.lpad((F.pmod("id", F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad(number, 8, "0"))
    named = F.element_at(F.array(F.concat(camel(2), number), F.concat(plain(2), number), F.concat(camel(3), number), F.concat(F.upper(plain(2)), number), F.concat(plain(1), number, camel(1)), camel(4), plain(4), date), (F.pmod("id", F.lit(8)) + 1).cast("int"))
    ids = spark.range(n)
    both = ids.select(drawn.alias("token"), F.lit(1).alias("random")).unionAll(ids.select(named.alias("token"), F.lit(0).alias("random")))
    return both.where(F.length("token") >= LEAST)


def _length_class(token: Column) -> Column:
    return F.least(F.floor((F.length(token) - LEAST) / STEP), F.lit(LAST - 1)).cast("int")


def part_thresholds(labelled: DataFrame, table: list[float]) -> list[float]:
    """Per class of lengths, the ratio above which a part counts as random, from labelled (token, random).

    It lies midway between the lowest hundredth of random parts and the highest thousandth of ordinary ones, and not
    below the latter: a wrong span costs more than a missed one.  A class without ordinary parts has the next one's.
    """
    ratio = _ratio(F.col("token"), _literal(table))
    rows = labelled.groupBy(_length_class(F.col("token")).alias("k")).agg(F.percentile(F.when(F.col("random") == 1, ratio), 0.01).alias("low"), F.percentile(F.when(F.col("random") == 0, ratio), 0.999).alias("high")).collect()
    found = {r["k"]: r for r in rows}
    out, last = [], 0.0
    for k in range(LAST):
        r = found.get(k)
        if r and r["high"] is not None:
            last = r["high"] if r["low"] is None else max(r["high"], (r["low"] + r["high"]) / 2)
        out.append(last)
    return out


def _place(char: Column) -> Column:
    return F.instr(F.lit(ALPHABET), char) - 1


def _places(token: Column) -> Column:
    """The place of each character in the alphabet, -1 for others."""
    return F.transform(F.split(token, ""), _place)


def _ratio(token: Column, table: Column) -> Column:
    """The mean log-likelihood ratio of a token's transitions."""
    n = len(ALPHABET)

    def mean(at: Column) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(F.size(at) - 2, F.lit(0)))
        score = lambda i: F.coalesce(F.get(table, F.get(at, i) * n + F.get(at, i + 1)), F.lit(0.0))
        return F.aggregate(steps, F.lit(0.0), lambda total, i: total + score(i)) / F.greatest(F.size(at) - 1, F.lit(1))

    return let(_places(token), mean)


def _literal(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")


def train(labelled: DataFrame, smoothing: float = 0.5) -> tuple[list[float], float]:
    """(log-likelihood ratios by pair of characters, threshold) from (token, random).

    Four fifths of the samples, by hash, train the models; the rest set the threshold midway between the
    lowest thousandth of random strings and the highest thousandth of identifiers.  The counts that reach the
    driver are bounded by the square of the alphabet.
    """
    n = len(ALPHABET)
    fold = F.pmod(F.xxhash64("token"), F.lit(5))
    pairs = let(_places(F.col("token")), lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.get(at, i) * n + F.get(at, i + 1)))
    counted = labelled.where((fold > 0) & (F.length("token") > 1)).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    counts = [[smoothing] * (n * n) for _ in range(2)]
    for row in counted.collect():
        counts[row["random"]][row["pair"]] += row["count"]
    totals = [[sum(c[k * n : (k + 1) * n]) for k in range(n)] for c in counts]
    table = [math.log(counts[1][k] / totals[1][k // n]) - math.log(counts[0][k] / totals[0][k // n]) for k in range(n * n)]
    ratio = _ratio(F.col("token"), _literal(table))
    low, high = labelled.where(fold == 0).agg(F.percentile(F.when(F.col("random") == 1, ratio), 0.001), F.percentile(F.when(F.col("random") == 0, ratio), 0.999)).first()
    return table, ((low or 0.0) + (high or 0.0)) / 2


def prefix_sums(values: Column) -> Column:
    """The running sums of an array, in blocks, so that long arrays take about linear time."""
    extend = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    zero = F.array(F.lit(0))

    def blocked(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(own), F.lit(1)) - 1) / _BLOCK).cast("int"))
        return F.transform(starts, lambda b: F.aggregate(F.slice(own, b * _BLOCK + 1, F.lit(_BLOCK)), zero, extend))

    def joined(blocks: Column) -> Column:
        before = F.aggregate(F.transform(blocks, lambda s: F.element_at(s, -1)), zero, extend)
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda s, b: F.transform(F.slice(s, F.lit(2), F.size(s) - 1), lambda x: x + b)))

    return let(let(values, blocked), joined)


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """(start, kind, end) of the matches, leftmost and non-overlapping, in code points; ``keep`` tests them.

    What a match needs of the whole text is computed once for the text.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def located(m: Column) -> Column:
        lengths = F.flatten(F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["found"])), m["found"], lambda g, x: F.array(F.length(g), F.length(x))))
        return let(prefix_sums(lengths), lambda sums: chosen(m, sums))

    def chosen(m: Column, sums: Column) -> Column:
        good = (lambda i: F.lit(True)) if keep is None else (lambda i: F.get(m["good"], i))
        spans = F.transform(F.sequence(F.lit(0), F.size(m["found"]) - 1), lambda i: F.struct(F.get(sums, 2 * i).alias("start"), F.lit(kind).alias("kind"), F.get(sums, 2 * i + 1).alias("end"), good(i).alias("good")))
        return F.transform(F.filter(spans, lambda s: s["good"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    matches = F.struct(found.alias("found"), gaps.alias("gaps"), (F.lit(None).cast("array<boolean>") if keep is None else keep(found)).alias("good"))
    return F.when(text.rlike(pattern), let(matches, located)).otherwise(empty)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, base, added) of every row of ``docs``: spans as (start, kind, end), kinds by number.

    ``base`` has the matches of the fixed patterns, each kind's leftmost and non-overlapping; ``added`` has the
    tokens and parts of tokens that the models call random and that overlap none of them.  ``labelled`` and ``parts``
    are other labelled samples of whole tokens and of parts than those made by rule.  A null text counts as empty and has no
    spans; repeated rows and null ids keep their rows; other columns are ignored; an empty table gives an empty
    result.  Rows are scanned where they are read, without a shuffle.
    """
    spark = docs.sparkSession
    table, threshold = train(samples(spark) if labelled is None else labelled)
    limits = _literal(part_thresholds(part_samples(spark) if parts is None else parts, table))
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    eight = lambda found: F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 8)
    rows = rows.select("doc_id", "text", _spans(text, ASSIGN, 0, eight).alias("assign"), _spans(text, ACCESS, 1).alias("access"), _spans(text, HEX, 2).alias("hex"))
    judge = lambda found: F.transform(found, lambda t: t.rlike("[0-9]") & (_ratio(t, _literal(table)) > threshold))
    partial = lambda found: F.transform(found, lambda t: _ratio(t, _literal(table)) > F.get(limits, _length_class(t)))
    rows = rows.select("doc_id", "text", "assign", "access", "hex", F.concat("assign", "access", "hex").alias("base"), _spans(text, TOKEN, 3, judge).alias("tokens"), _spans(text, PART, 3, partial).alias("parts"))
    rows = rows.withColumn("tokens", _clear("tokens", "base"))
    rows = rows.withColumn("parts", _clear("parts", "base", "tokens"))
    return rows.select("doc_id", "text", "assign", "access", "hex", "base", F.concat("tokens", "parts").alias("added"))


def _clear(spans: str, *others: str) -> Column:
    """The spans that overlap none of the others."""
    held = F.concat(*others)
    return F.when(F.size(spans) > 0, F.filter(spans, lambda t: ~F.exists(held, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))).otherwise(F.col(spans))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from the spans of ``scan``."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))
