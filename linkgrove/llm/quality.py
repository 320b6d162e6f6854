"""Quality rules with thresholds that adapt to each language and source.

Each document's metrics are integers. A group's sketch is the count of every metric
value cut to six significant bits: counts add up, so sketches merge in any order and
give one result, with a relative error of 1/32. The thresholds are tail quantiles of
the group's sketch and nothing else: a metric's high fence is its tail quantile plus
REACH times that quantile's distance from the median, the low fence likewise. There is
no floor and no least group size: quantiles shrink towards those of the language, and
these towards those of all documents, with the weight of PRIOR documents, so a group
takes over from its language gradually as it grows. Sketches hold the documents that
pass the base rules, as the others go in any case.

A ratio is judged without its first occurrence (one symbol, one repeated line, one
repeated passage of two windows): a single one is the ratio's smallest step and no
evidence, also where a group has none.

Native: arrays and higher-order functions only; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkgrove.llm.common import LOWER, UPPER, bind, maybe_broadcast, passing, staged, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Metric: (part, whole, occurrences that are no evidence, tail level in per cent, low fence too). Symbols and word
#: length mark garbled texts, of which a group may hold several per cent, so their tail is read at 90; the others lie far
#: out by nature, and the base rules have taken the worst, so theirs is read at 98.
METRICS = {
    "symbols_pm": ("n_symbols", "n_words", 1, 90, False),
    "mean_word": ("word_chars", "n_words", 0, 90, True),
    "upper_pm": ("n_upper", "word_chars", 1, 98, False),
    "marks_pm": ("n_marks", "n_words", 1, 98, False),
    "repeat_pm": ("n_repeat_words", "n_words", 2 * WINDOW, 98, False),
    "dup_lines_pm": ("n_dup_lines", "n_lines", 1, 98, False),
}
REACH = 2
#: Weight, in documents, of the language's quantiles in a group's, and of all documents' in a language's.
PRIOR = 100
#: Quantiles are blended in thousandths of a metric's unit.
UNIT = 1000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(ws: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text."""
    n = F.size(ws)
    hashes = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.element_at(ws, (i + k).cast("int")) for k in range(WINDOW)]),
    )

    def spread(at: Column) -> Column:
        """Words covered by windows at these ascending positions."""
        steps = F.transform(
            at, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, i - 1)))
        )
        return F.aggregate(steps, F.lit(0).cast("int"), lambda a, x: a + x)

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bind(
            pairs,
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]),
                ),
                lambda x: x["i"],
            ),
        )
        return bind(F.sort_array(again), spread)

    repeated = bind(
        hashes,
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)),
    )
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(repeated)


def _count_of(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_marks")


def text_metrics(docs: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id, lang, source and the integer metrics of every whole text (null: none).

    With `rows`, the whole input row comes along as one struct `row`, so its columns
    meet no name of this module.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = [F.struct(*docs.columns).alias("row")] if rows else []
    ws = docs.select("doc_id", "lang", "source", text.alias("text"), *whole).withColumn("ws", words(F.col("text")))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return ws.select(
        "doc_id",
        "lang",
        "source",
        F.size("ws").cast("long").alias("n_words"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bind(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        bind(F.col("ws"), _repeat_words).cast("long").alias("n_repeat_words"),
        _count_of(F.col("text"), UPPER).alias("n_upper"),
        _count_of(F.col("text"), "!?").alias("n_marks"),
        *(["row"] if rows else []),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def metric(name: str, spare: bool = False) -> Column:
    """A metric in thousandths, cut as in the sketches; `spare` leaves out the occurrences that are no evidence."""
    part, whole, free, _, _ = METRICS[name]
    have = f"greatest({part} - {free}L, 0L)" if spare else part
    return cut_bits(F.expr(f"CASE WHEN {whole} > 0 THEN ({have} * 1000L) div {whole} ELSE 0L END"))


def cut_bits(v: Column) -> Column:
    """A count cut to its six leading bits: the sketch's bucket."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group, metric and bucket of (…, metric, v) rows; equal sketches add up."""
    return rows.groupBy(*by, "metric", "v").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """total and the quantiles low, mid, high of each group and metric: least buckets reaching their shares.

    In units of 1/UNIT; mid is the median, high the metric's tail level, low its mirror.
    """
    w = Window.partitionBy(*by, "metric")
    run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    level = F.coalesce(*[F.when(F.col("metric") == m, F.lit(rule[3])) for m, rule in METRICS.items()])
    cum = sketches.withColumn("cum", F.sum("n").over(run)).withColumn("total", F.sum("n").over(w)).withColumn("level", level)

    def at(share: Column) -> Column:
        return F.min(F.when(F.col("cum") * 100 >= F.col("total") * share, F.col("v") * UNIT))

    return cum.groupBy(*by, "metric").agg(
        F.max("total").alias("total"),
        at(100 - F.col("level")).alias("low"),
        at(F.lit(50)).alias("mid"),
        at(F.col("level")).alias("high"),
    )


def _blend(total: str, own: str, other: str) -> Column:
    return F.expr(f"({total} * {own} + {PRIOR}L * {other}) div ({total} + {PRIOR}L)")


def fences(metrics: DataFrame) -> DataFrame:
    """One row per (lang, source): low_<metric> and high_<metric>, in units of 1/UNIT.

    Null languages and sources are groups of their own. A group whose documents all
    fail the base rules has no row.
    """
    long = metrics.where(~base_failed()).select(
        "lang",
        "source",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), metric(m).alias("v")) for m in METRICS])),
    )
    fine = staged(sketch(long.withColumn("n", F.lit(1).cast("long")), ["lang", "source"]), "quality-sketch")
    parts = ("low", "mid", "high")
    every = quantiles(sketch(fine, []), []).select(F.col("metric").alias("am"), *[F.col(c).alias(f"a_{c}") for c in parts])
    lang = quantiles(sketch(fine, ["lang"]), ["lang"]).join(F.broadcast(every), F.col("metric") == F.col("am"))
    lang = lang.select(  # `every` has one row a metric
        F.col("lang").alias("l"), F.col("metric").alias("lm"), *[_blend("total", c, f"a_{c}").alias(f"l_{c}") for c in parts]
    )
    own = quantiles(fine, ["lang", "source"])
    merged = own.join(lang, own["lang"].eqNullSafe(lang["l"]) & (own["metric"] == lang["lm"])).select(
        "lang", "source", "metric", *[_blend("total", c, f"l_{c}").alias(c) for c in parts]
    )
    out = []
    for m, rule in METRICS.items():
        here = F.col("metric") == m
        out.append(F.max(F.when(here, F.col("high") + REACH * (F.col("high") - F.col("mid")))).alias(f"high_{m}"))
        if rule[4]:
            out.append(F.max(F.when(here, F.col("low") - REACH * (F.col("mid") - F.col("low")))).alias(f"low_{m}"))
    return merged.groupBy("lang", "source").agg(*out)


def _judged(docs: DataFrame, rows: bool) -> DataFrame:
    metrics = passing(text_metrics(docs, rows), "quality-metrics")
    limits = staged(fences(metrics), "quality-fences").select(
        F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), F.col("*")
    ).drop("lang", "source")
    joined = metrics.join(
        maybe_broadcast(limits, limits.count()),
        metrics["lang"].eqNullSafe(F.col("f_lang")) & metrics["source"].eqNullSafe(F.col("f_source")),
        "left",
    )
    beyond = F.lit(False)
    for m, rule in METRICS.items():
        beyond = beyond | (metric(m, spare=True) * UNIT > F.col(f"high_{m}"))
        if rule[4]:
            beyond = beyond | (metric(m) * UNIT < F.col(f"low_{m}"))
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base metrics, base_failed, kept: one row per input row.

    Null or empty text: all counts zero and base_failed. Repeated rows are judged
    alike. Null lang or source: a group of its own. Other columns are ignored.
    """
    return _judged(docs, rows=False).select("doc_id", *BASE, "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns, whatever these are called.

    Every row is judged by itself, so rows of one doc_id, or of none, go or stay each on
    its own; repeated rows go or stay together. The texts are never shuffled.
    """
    return _judged(docs, rows=True).where("kept").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
