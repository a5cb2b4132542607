"""Quality rules whose thresholds adapt to each language and source through mergeable quantile sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh, prepare, quoted, table

# Fixed values of the base rules.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = b"#*$%&|<>", 8, 20, 30
SPACE = b" \t\n\x0b\x0c\r"
_NOT_IN_WORDS = SPACE + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a code point
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FEATURES = "struct<n_words:long,word_chars:long,n_symbols:long,n_lines:long,n_dup_lines:long,n_repeat_words:long,n_echoes:long>"
_FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echoes")


def repeated_words(one: np.ndarray) -> int:
    """Words that lie in a WINDOW-word window found twice or more in the text; ``one`` has a hash for each word."""
    n = len(one) - WINDOW + 1
    if n < 2:
        return 0
    whole = one[:n].copy()
    for k in range(1, WINDOW):
        whole *= _MULTIPLIER
        whole += one[k : k + n]
    order = np.sort(whole)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, whole), len(twice) - 1)
    starts = np.flatnonzero(twice[at] == whole)
    edges = np.zeros(len(one) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def features(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return len(words), len(text.translate(None, _NOT_IN_WORDS)), symbols, len(lines), len(lines) - len(set(lines)), repeated_words(one), int((one[1:] == one[:-1]).sum())


def _features(texts: pa.Array) -> pa.Array:
    rows = [features(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    columns = zip(*rows, strict=True) if rows else [()] * len(_FEATURES)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], list(_FEATURES))


#: Ratios that are judged: sides (upper, or lower too), and the least distance of a threshold from the median.
#: Distances are counted in FENCE times the spread (third less first quartile, at least SPREAD of the median).
#: The floors only matter where a sketch has (almost) no spread: most documents hold no symbol, repeated line or window.
LIMITS = {"word_length": (True, 1.0), "symbols": (False, 0.1), "dup_lines": (False, 0.4), "repeats": (False, 0.2), "echoes": (False, 0.04)}


def ratios(f: str) -> dict[str, Column]:
    words, lines = F.greatest(F.col(f"{f}.n_words"), F.lit(1)), F.greatest(F.col(f"{f}.n_lines"), F.lit(1))
    return {
        "word_length": F.col(f"{f}.word_chars") / words,
        "symbols": F.col(f"{f}.n_symbols") / words,
        "dup_lines": F.col(f"{f}.n_dup_lines") / lines,
        "repeats": F.col(f"{f}.n_repeat_words") / words,
        "echoes": F.col(f"{f}.n_echoes") / words,
    }


FENCE, SPREAD = 6.0, 0.05
#: Sketch: a value's bucket is the rounded logarithm, so a quantile is right within ACCURACY of its value. Counts of
#: buckets add up, so sketches merge exactly and in any order.
ACCURACY, ZERO_BUCKET = 0.01, -(1 << 20)
_LOG_GAMMA = float(np.log((1 + ACCURACY) / (1 - ACCURACY)))
#: Groups with fewer documents than this use the language's sketch, and below it the table's.
MIN_GROUP = 100
BROADCAST_GROUPS = 20_000


def thresholds(narrow: DataFrame, names: dict[str, tuple[bool, float]]) -> DataFrame:
    """From rows (lang, source, one column for each ratio) to (lang, source, {name}_low, {name}_high).

    Every ratio of every group has a log-bucket sketch: a count for each bucket, summed map-side first, so a hot group
    moves no more rows than its buckets. Sketches of a language and of all are sums of the groups' sketches.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x")
    bucket = F.when(F.col("x.value") > 0, F.round(F.log("x.value") / _LOG_GAMMA).cast("int")).otherwise(ZERO_BUCKET)
    cells = narrow.select("lang", "source", pairs).groupBy("lang", "source", F.col("x.name").alias("name"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    cells = table(cells, "sketch")
    groups = cells.where(F.col("name") == next(iter(names))).groupBy("lang", "source").agg(F.sum("n").alias("docs"))
    quantiles = {}
    for level, keys in (("group", ["lang", "source"]), ("lang", ["lang"]), ("all", [])):
        sums = cells.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
        part = Window.partitionBy(*keys, "name")
        sums = sums.withColumn("upto", F.sum("n").over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(part))
        value = F.when(F.col("bucket") == ZERO_BUCKET, 0.0).otherwise(F.exp(F.col("bucket") * _LOG_GAMMA))
        q = sums.groupBy(*keys, "name").agg(F.max("total").alias("total"), *[F.min(F.when(F.col("upto") >= p * F.col("total"), value)).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)])
        quantiles[level] = q.groupBy(*keys).agg(F.max("total").alias(f"{level}_docs"), F.map_from_entries(F.collect_list(F.struct("name", F.struct("q25", "q50", "q75")))).alias(f"by_{level}"))
    same = lambda a, b, keys: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    df = groups.alias("a").join(quantiles["group"].alias("b"), same("a", "b", ["lang", "source"])).select("a.*", "b.by_group")
    df = df.alias("a").join(quantiles["lang"].alias("b"), same("a", "b", ["lang"])).select("a.*", "b.lang_docs", "b.by_lang")
    df = df.join(F.broadcast(quantiles["all"].select("by_all")))  # one row
    chosen = F.when(F.col("docs") >= MIN_GROUP, F.col("by_group")).when(F.col("lang_docs") >= MIN_GROUP, F.col("by_lang")).otherwise(F.col("by_all"))
    df = df.withColumn("chosen", chosen)
    columns = []
    for name, (both, least) in names.items():
        q = F.col("chosen")[name]
        reach = F.greatest(FENCE * F.greatest(q["q75"] - q["q25"], SPREAD * q["q50"]), F.lit(least))
        columns += [(q["q50"] + reach).alias(f"{name}_high"), (q["q50"] - reach if both else F.lit(None).cast("double")).alias(f"{name}_low")]
    return df.select("lang", "source", *columns)


def _verdicts(docs: DataFrame, text: str, lang: str, source: str, keep: list[str]) -> tuple[DataFrame, str, str, Column]:
    """The columns ``keep`` beside private ones: the names of features and base verdict, and the verdict."""
    prepare(docs.sparkSession)
    own = fresh(keep, "lang", "source", "features", "failed", "t_lang", "t_source", "limits")
    f = own["features"]
    both = docs.select(*quoted(*keep), quoted(lang)[0].alias(own["lang"]), quoted(source)[0].alias(own["source"]), F.arrow_udf(_features, FEATURES)(*quoted(text)).alias(f))
    failed = (F.col(f"{f}.n_words") < MIN_WORDS) | (100 * F.col(f"{f}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{f}.n_words"))
    both = table(both.withColumn(own["failed"], failed), "features")
    names = ratios(f)
    narrow = both.where(~F.col(own["failed"])).select(F.col(own["lang"]).alias("lang"), F.col(own["source"]).alias("source"), *[v.alias(n) for n, v in names.items()])
    limits = table(thresholds(narrow, LIMITS), "thresholds")
    bounds = F.struct(*[f"{n}_{side}" for n in names for side in ("low", "high")]).alias(own["limits"])
    limits = limits.select(F.col("lang").alias(own["t_lang"]), F.col("source").alias(own["t_source"]), bounds)
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    df = both.join(limits, F.col(own["lang"]).eqNullSafe(F.col(own["t_lang"])) & F.col(own["source"]).eqNullSafe(F.col(own["t_source"])), "left")
    inside = F.lit(True)
    for n, v in names.items():
        low, high = (F.col(f"{own['limits']}.{n}_{side}") for side in ("low", "high"))
        inside &= (v <= F.coalesce(high, F.lit(float("inf")))) & (v >= F.coalesce(low, F.lit(float("-inf"))))
    return df, f, own["failed"], ~F.col(own["failed"]) & inside


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, the struct ``features``, ``base_failed`` and ``kept``.

    A document fails the base rules if it has under MIN_WORDS words or over MAX_REPEAT_PERCENT of its words in repeated
    windows. Others are kept unless a ratio lies outside the thresholds of their language and source: the median
    plus or minus FENCE spreads, from sketches of all documents that pass the base rules. Texts are read once: features
    are written beside the columns that are kept, and sketches and verdicts come from there.

    Null and empty texts have no words and fail; null languages and sources are groups of their own; repeated rows
    count each; texts of any length are judged whole; an empty table stays empty; columns named features, base_failed
    or kept are replaced, and other names of columns don't matter.
    """
    keep = [c for c in (keep or docs.columns) if c.lower() not in ("features", "base_failed", "kept")]
    df, f, failed, kept = _verdicts(docs, text, lang, source, keep)
    return df.select(*quoted(*keep), F.col(f).alias("features"), F.col(failed).alias("base_failed"), kept.alias("kept"))


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns, whatever their names."""
    df, _, _, kept = _verdicts(docs, text, lang, source, docs.columns)
    return df.where(kept).select(*quoted(*docs.columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(documents(spark, sf_dir), keep=["doc_id"])
    return df.select("doc_id", *[f"features.{c}" for c in _FEATURES if c not in ("n_lines", "n_echoes")], "base_failed", "kept")


_SQL_RATIOS = {"word_length": "word_chars / greatest(n_words, 1)", "symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "echoes": "n_echoes / greatest(n_words, 1)"}


def _sql() -> str:
    """The same in DuckDB's SQL: windows from LEAD, and the sketches as counts of buckets."""
    spaces, level = r"[\x20\x09-\x0D]", "CASE WHEN x.n >= {0} THEN x.q WHEN y.n >= {0} THEN y.q ELSE z.q END".format(MIN_GROUP)
    window = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, WINDOW)]])
    reach = f"greatest({FENCE}::DOUBLE * greatest(q[3] - q[1], {SPREAD}::DOUBLE * q[2]), CASE name {' '.join(f"WHEN '{n}' THEN {least}::DOUBLE" for n, (_, least) in LIMITS.items())} END)"

    def quantiles(name: str, keys: str) -> str:
        over = f"PARTITION BY {keys}name"
        at = ", ".join(f"min(v) FILTER (upto >= {p}::DOUBLE * n)" for p in (0.25, 0.5, 0.75))
        return f"""{name} AS (SELECT {keys}name, max(n) AS n, [{at}] AS q FROM (
  SELECT {keys}name, CASE WHEN bucket = {ZERO_BUCKET} THEN 0 ELSE exp(bucket * {_LOG_GAMMA!r}::DOUBLE) END AS v, sum(k) OVER ({over} ORDER BY bucket) AS upto, sum(k) OVER ({over}) AS n
  FROM (SELECT {keys}name, bucket, count(*) AS k FROM cells GROUP BY {keys}name, bucket)) GROUP BY {keys}name)"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '{spaces.replace("[", "[^")}+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{spaces.replace("[", "[^")}')) AS lines FROM d),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM s),
x1 AS (SELECT r, i, word = lag(word) OVER o AS echo, md5({window}) AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
x2 AS (SELECT *, whole IS NOT NULL AND count(*) OVER (PARTITION BY r, whole) > 1 AS twice FROM x1),
x3 AS (SELECT r, echo, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS inside FROM x2),
u AS (SELECT r, count(*) FILTER (inside) AS n_repeat_words, count(*) FILTER (echo) AS n_echoes FROM x3 GROUP BY r),
f AS (SELECT r, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{spaces}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[{SYMBOLS.decode()}]', '', 'g')))::BIGINT AS n_symbols,
      len(lines)::BIGINT AS n_lines, (len(lines) - list_unique(lines))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_echoes, 0) AS n_echoes FROM s LEFT JOIN u USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
v AS (SELECT r, lang, source, unnest([{', '.join(f"struct_pack(name := '{n}', value := {e})" for n, e in _SQL_RATIOS.items())}], recursive := true) FROM b WHERE NOT base_failed),
cells AS (SELECT *, CASE WHEN value > 0 THEN round(ln(value) / {_LOG_GAMMA!r}::DOUBLE)::INT ELSE {ZERO_BUCKET} END AS bucket FROM v),
{quantiles("by_group", "lang, source, ")},
{quantiles("by_lang", "lang, ")},
{quantiles("by_all", "")},
m AS (SELECT x.lang, x.source, name, {level} AS q FROM by_group x JOIN by_lang y USING (name) JOIN by_all z USING (name) WHERE x.lang IS NOT DISTINCT FROM y.lang),
h AS (SELECT lang, source, name, q[2] + {reach} AS high, CASE WHEN name IN ({', '.join(f"'{n}'" for n, (both, _) in LIMITS.items() if both)}) THEN q[2] - {reach} ELSE '-inf'::DOUBLE END AS low FROM m),
k AS (SELECT r, bool_and(value <= high AND value >= low) AS fits FROM v JOIN h ON v.name = h.name AND v.lang IS NOT DISTINCT FROM h.lang AND v.source IS NOT DISTINCT FROM h.source GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fits, true) AS kept FROM b LEFT JOIN k USING (r)
"""


OP9_SQL = _sql()
