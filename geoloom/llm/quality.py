"""Quality rules (operator 3).

A table of thresholds is compiled into one projection of built-in functions;
nothing is shuffled and no user function runs. A document is kept if it passes
the base checks and every threshold that applies to its length.

Defined cases: null and empty texts have no words, counts 0 and fail; repeated
rows are judged alike; a text of any length is read whole, in linear space;
other columns pass through (the added ones carry the prefix _q_, with more
underscores where a column has that).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import WORD, apart, fenced, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Function words of the languages in the corpus; compared as they stand, in lower case.
STOP_WORDS = (
    "the of and to in a is that it for was with be by on are this not "
    "der die und das den mit von zu ist nicht sich des auf dem im "
    "le la les de et un en que qui du pour une dans par au est "
    "el los y las por con una no se del su al para lo como"
).split()


@dataclass(frozen=True)
class Threshold:
    """A measure's allowed range, for texts of at least min_words words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: measure: SQL over the _q_ columns below.
RULES = (
    Threshold("mean_word_length", "try_divide(_q_word_chars, _q_words)", 2.0, 12.0),
    Threshold("symbol_ratio", "try_divide(_q_symbols, _q_words)", None, 0.2),
    Threshold("shout_ratio", "try_divide(_q_shouts, _q_words)", None, 0.5),
    Threshold("stop_word_ratio", "try_divide(_q_stops, _q_words)", 0.03, 0.7, 60),
    Threshold("duplicate_line_ratio", "try_divide(_q_dup_lines, _q_lines)", None, 0.5),
    Threshold("longest_word", "_q_longest", None, 1000),
)


def repeat_words(words: str, n: int = WINDOW) -> str:
    """SQL for the number of words inside n-word windows that occur twice or more.

    Window hashes are compared as a set first; only a text that repeats one is
    sorted by (hash, position). A window is repeated if a neighbour in that order
    has its hash. The covered words are the gaps between the repeated windows'
    starts, each n at most, and n for the last. The lambdas over one-element
    arrays bind an intermediate value, so that it's computed once a row.
    """
    hashes = f"transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64(slice({words}, i, {n})))"
    sort = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"
    again = (
        "sort_array(transform(filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h)"
        " or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i))"
    )
    covered = f"aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> least(b - a, {n})), {n}, (t, x) -> t + x)"
    found = f"transform(array({sort}), s -> transform(array({again}), p -> {covered})[0])[0]"
    return (
        f"if(size({words}) <= {n}, 0, transform(array({hashes}),"
        f" h -> if(size(array_distinct(h)) = size(h), 0, {found}))[0])"
    )


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules use, as _q_ columns."""
    held = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.regexp_extract_all(held, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(held, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = F.filter("_q_list", lambda w: w.isin(*STOP_WORDS))
    out = docs.select("*", words.alias("_q_list"), lines.alias("_q_line_list"), F.length(held).alias("_q_chars"))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_q_list").cast("long").alias("_q_words"),
        F.length(F.array_join("_q_list", "")).cast("long").alias("_q_word_chars"),
        (F.col("_q_chars") - F.length(F.regexp_replace(held, SYMBOLS, ""))).cast("long").alias("_q_symbols"),
        (F.col("_q_chars") - F.length(F.replace(held, F.lit("!"), F.lit("")))).cast("long").alias("_q_shouts"),
        F.size("_q_line_list").cast("long").alias("_q_lines"),
        (F.size("_q_line_list") - F.size(F.array_distinct("_q_line_list"))).cast("long").alias("_q_dup_lines"),
        F.expr(repeat_words("_q_list")).cast("long").alias("_q_repeat_words"),
        F.size(stops).cast("long").alias("_q_stops"),
        F.coalesce(F.array_max(F.transform("_q_list", lambda w: F.length(w))), F.lit(0)).cast("long").alias("_q_longest"),
    )


def base_failed() -> Column:
    return (F.col("_q_words") < MIN_WORDS) | (100 * F.col("_q_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_words"))


def passes(rule: Threshold) -> Column:
    """True inside the range, where the rule doesn't apply, and where the measure is undefined."""
    x = F.expr(rule.measure)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (x >= rule.low)
    if rule.high is not None:
        ok = ok & (x <= rule.high)
    return F.coalesce((F.col("_q_words") < rule.min_words) | ok, F.lit(True))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Threshold, ...] = RULES) -> DataFrame:
    """docs with the _q_ counts, _q_base_failed, _q_failed_rules and _q_kept."""

    def work(own: DataFrame) -> DataFrame:
        out = measures(own, text).withColumn("_q_base_failed", base_failed())
        out = out.withColumn("_q_failed_rules", F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules])))
        return fenced(out.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.size("_q_failed_rules") == 0)), own.columns)

    return apart(docs, "_q_", work)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id",
        F.col("_q_words").alias("n_words"),
        F.col("_q_word_chars").alias("word_chars"),
        F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"),
        F.col("_q_repeat_words").alias("n_repeat_words"),
        F.col("_q_base_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"),
        F.array_join("_q_failed_rules", ",").alias("failed_rules"),
    )


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    row_number() OVER () AS r
  FROM documents
), c AS (
  SELECT r, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(replace(text, '!', '')) AS shouts, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(words, lambda w: w IN ({_STOPS}))) AS stops,
    coalesce(list_max(list_transform(words, lambda w: length(w))), 0) AS longest
  FROM d
), grams AS (
  SELECT r, i, words[i:i + 7] AS g FROM d, unnest(range(1, len(words) - 6)) AS u(i) WHERE len(words) > 8
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT r, CAST(sum(least(coalesce(nxt - i, 8), 8)) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
), b AS (
  SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed
  FROM c LEFT JOIN repeats USING (r)
), f AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN word_chars / n_words < 2 OR word_chars / n_words > 12 THEN 'mean_word_length' END,
    CASE WHEN n_symbols / n_words > 0.2 THEN 'symbol_ratio' END,
    CASE WHEN shouts / n_words > 0.5 THEN 'shout_ratio' END,
    CASE WHEN n_words >= 60 AND (stops / n_words < 0.03 OR stops / n_words > 0.7) THEN 'stop_word_ratio' END,
    CASE WHEN n_dup_lines / n_lines > 0.5 THEN 'duplicate_line_ratio' END,
    CASE WHEN longest > 1000 THEN 'longest_word' END], lambda x: x IS NOT NULL), ',') AS failed_rules
  FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM f
"""
