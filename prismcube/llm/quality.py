"""Operator 5 [native]: quality rules with adaptive thresholds.

Base measures are computed per document inside the scan with array functions.  The thresholds are fences of mergeable
quantile sketches: a sketch is a histogram of an integer measure whose buckets keep its BITS leading bits (an error
below one part in 2**(BITS - 1)), so two sketches are merged by adding counts, in any order, with the same result.
There is one for each language and source; groups of fewer than MIN_GROUP documents use the sketch of their language,
or of everything.  A measure fails above Q3 + SPREAD * max(Q3 - Q1, floor), and word length also below the mirror of
it; the floors keep a group without variation from rejecting everything that differs.  The verdicts are joined back
on (language, source), a join that adaptive execution broadcasts where the table is small and splits where one source
is hot; only measures, never texts, are shuffled.

Words are runs of anything but blank and \\t\\n\\v\\f\\r.  Repeated 5-word windows are found by sorting one long for
each window: its hash, shifted left to hold the window's place in the low bits.

Cases: null and empty texts have no words and fail the base rules; null languages and sources are groups of their
own; null ids pass through; repeated rows count each; other columns are not read; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

BITS = 8
MIN_GROUP = 200
SPREAD = 3
#: (measure, smallest spread, two-sided); measures are in hundredths or thousandths, see `measures`.
RULES = (("word_length", 60, True), ("symbol_share", 30, False), ("dup_line_share", 60, False), ("repeat_share", 40, False))
SPACES = "[ \\t-\\r]+"


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    words = f"filter(split(t, '{SPACES}'), x -> x <> '')"
    d = d.selectExpr(
        "_id", "_lang", "_source",
        f"transform({words}, x -> xxhash64(x)) as w",
        "length(translate(t, ' \\t\\n\\u000b\\u000c\\r', '')) as word_chars",
        "length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols",
        "filter(split(t, '\\n'), x -> translate(x, ' \\t\\u000b\\u000c\\r', '') <> '') as lines",
    )
    # b: bits that hold a place; g: sorted (hash, place) of the 5-word windows.  The hash is cut to what is left, so that
    # twins are confirmed by their words; a stranger of the same cut hash may stand between them.
    d = d.selectExpr("_id", "_lang", "_source", "size(w) as n", "word_chars", "n_symbols", "size(lines) as n_lines", "size(lines) - size(array_distinct(lines)) as n_dup_lines", "length(bin(size(w))) as b", "w")
    grams = "transform(sequence(0, n - 5), i -> shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4)), b) | cast(i as bigint))"
    d = d.selectExpr("*", f"if(n >= 6, sort_array({grams}), cast(array() as array<bigint>)) as g")
    place = "cast({} & (shiftleft(1L, b) - 1) as int)"
    words_of = " and ".join(f"get(w, {place.format('get(g, i + {0})')} + {k}) = get(w, {place.format('x')} + {k})" for k in range(5))
    twin = " or ".join(f"(i + {o} between 0 and size(g) - 1 and shiftrightunsigned(get(g, i + {o}), b) = shiftrightunsigned(x, b) and {words_of.format(o)})" for o in (-1, 1, -2, 2))
    d = d.selectExpr("*", f"sort_array(transform(filter(g, (x, i) -> {twin}), x -> x & (shiftleft(1L, b) - 1))) as p").drop("g", "w")
    covered = "aggregate(transform(p, (x, i) -> if(i = size(p) - 1, 5L, least(5L, get(p, i + 1) - x))), 0L, (a, x) -> a + x)"
    d = d.selectExpr("_id", "_lang", "_source", "cast(n as bigint) as n_words", "cast(word_chars as bigint) as word_chars", "cast(n_symbols as bigint) as n_symbols", "cast(n_dup_lines as bigint) as n_dup_lines", f"{covered} as n_repeat_words", "cast(n_lines as bigint) as n_lines")
    return d.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def rated(measured: DataFrame) -> DataFrame:
    """With the measures that have thresholds, as integers."""
    return measured.selectExpr(
        "*",
        "if(n_words > 0, (100 * word_chars) div n_words, 0L) as word_length",
        "if(word_chars > 0, (1000 * n_symbols) div word_chars, 0L) as symbol_share",
        "if(n_lines > 0, (1000 * n_dup_lines) div n_lines, 0L) as dup_line_share",
        "if(n_words > 0, (1000 * n_repeat_words) div n_words, 0L) as repeat_share",
    )


def bucket(value: str) -> str:
    """SQL for the least value of the bucket that holds a non-negative integer."""
    s = f"greatest(length(bin({value})) - {BITS}, 0)"
    return f"shiftleft(shiftright({value}, {s}), {s})"


def sketches(measures_: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) of the documents that have a word."""
    pairs = ", ".join(f"struct('{name}' as rule, {bucket(name)} as bucket)" for name, _, _ in RULES)
    return measures_.where("n_words > 0").selectExpr("_lang", "_source", f"inline(array({pairs}))").groupBy("_lang", "_source", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles and size of each group of merged sketches: the least bucket by which a quarter, three quarters are reached."""
    merged = sketch.groupBy(*keys, "rule").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("h"))
    # A sketch has a bounded number of buckets, so these arrays don't grow with the input.  Entries of one bucket add up.
    reach = "filter(transform(h, (x, i) -> struct(x.bucket as bucket, aggregate(slice(h, 1, i + 1), 0L, (a, y) -> a + y.n) as upto)), x -> 4 * x.upto >= {} * size)[0].bucket"
    return merged.selectExpr(*keys, "rule", "size", f"{reach.format(1)} as q1", f"{reach.format(3)} as q3")


def thresholds(sketch: DataFrame, *, min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """(lang, source, lo_<rule>, hi_<rule>, ...): one row for each group."""
    by_lang = sketch.groupBy("_lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    own = quantiles(sketch, ["_lang", "_source"])
    lang = quantiles(by_lang, ["_lang"]).selectExpr("_lang as l", "rule as r", "size as lang_size", "q1 as lang_q1", "q3 as lang_q3")
    all_ = quantiles(overall, []).selectExpr("rule as ra", "q1 as all_q1", "q3 as all_q3")
    t = own.join(lang, F.col("_lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("r"))).join(all_, F.col("rule") == F.col("ra"))
    pick = lambda q: f"case when size >= {min_group} then {q} when lang_size >= {min_group} then lang_{q} else all_{q} end as {q}"
    t = t.selectExpr("_lang", "_source", "rule", pick("q1"), pick("q3"))
    out = []
    for name, floor, two in RULES:
        width = f"{spread} * greatest(q3 - q1, {floor})"
        out += [F.max(F.expr(f"if(rule = '{name}', q3 + {width}, null)")).alias(f"hi_{name}")]
        if two:
            out += [F.max(F.expr(f"if(rule = '{name}', q1 - {width}, null)")).alias(f"lo_{name}")]
    return t.groupBy("_lang", "_source").agg(*out)


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """(id, base measures, base_failed, failed_rule, kept); failed_rule: the first that fails."""
    kept = stored(rated(measures(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col)))
    limits = thresholds(sketches(kept), min_group=min_group, spread=spread).withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    both = kept.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    cases = " ".join(f"when {name} > hi_{name}{f' or {name} < lo_{name}' if two else ''} then '{name}'" for name, _, two in RULES)
    both = both.withColumn("failed_rule", F.expr(f"case when base_failed then 'base' {cases} end"))
    return both.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept"))
