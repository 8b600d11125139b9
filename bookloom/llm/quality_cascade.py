"""Quality rules as a short-circuit cascade.

Every rule is a boolean expression that is true where a document fails. A random sample
of all documents gives each rule's cost (seconds an evaluation, without what any job
costs) and how often it rejects; rules are tried in descending rejection per cost, each
measured on what the rules before it let through, inside one CASE whose branches stop at
the first failure. The order changes cost only: the verdict is that no rule fails.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.shared import let, read, words_of

SYMBOLS = "#*$%&|<>"
FULL, BULLET, UNFINISHED = r"[^\x20\x09-\x0D]", r"^[\x20\x09]*[-*•]", r"(\.\.\.|…)[\x20\x09-\x0D]*\z"
MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
WINDOW = 3
#: Rows the costs and rejection rates are measured on, about: each row of the table is
#: drawn with the same probability. The sample sets the order only, never a verdict.
SAMPLE_ROWS = 1000
#: Times a rule is evaluated on every row of the sample in a timed job, and such jobs.
REPEATS, TRIALS = 4, 2
SEED = 5
#: Positions take the low bits of a packed long, hashes the rest.
POSITION_BITS = 24


def repeat_words(words: Column) -> Column:
    """Words that lie in WINDOW-word windows found twice or more in the same text.

    Windows are sorted as (hash, position) packed in longs; equal neighbours that are
    the same words are repeats. Where equal hashes hide different words (or a text has
    more words than positions can count) the words themselves are sorted instead, so
    the count is exact.
    """
    mask = (1 << POSITION_BITS) - 1

    def windows(w):
        return F.sequence(F.lit(0), F.size(w) - WINDOW)

    def packed(w):
        return F.sort_array(F.transform(windows(w), lambda i: F.shiftleft(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long"))))

    def same_hash(a, b):
        return F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)

    def same_words(w, a, b):
        i, j = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
        return ((F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1))
                & (F.get(w, i + 2) == F.get(w, j + 2)))

    def covered(starts):
        """Positions in [s, s + WINDOW) of sorted starts s."""
        return F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                           lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n")),
                           lambda acc: acc["n"])

    def by_hash(w):
        def repeated(s):
            pairs = F.filter(F.transform(s, lambda x, i: F.when(
                (i > 0) & same_hash(x, F.get(s, i - 1)), F.struct(F.get(s, i - 1).alias("a"), x.alias("b")))), lambda p: p.isNotNull())
            return let(pairs, lambda p: F.when(
                ~F.exists(p, lambda q: ~same_words(w, q["a"], q["b"])),
                covered(F.array_sort(F.array_distinct(F.flatten(F.transform(
                    p, lambda q: F.array(q["a"].bitwiseAND(mask).cast("int"), q["b"].bitwiseAND(mask).cast("int")))))))))
        return let(packed(w), repeated)

    def by_words(w):
        rows = F.array_sort(F.transform(windows(w), lambda i: F.struct(
            F.get(w, i).alias("x"), F.get(w, i + 1).alias("y"), F.get(w, i + 2).alias("z"), i.alias("i"))))

        def repeated(s):
            def same(a, b):
                return F.coalesce((a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"]), F.lit(False))
            return covered(F.array_sort(F.filter(F.transform(s, lambda r, i: F.when(
                (F.lit(i > 0) & same(F.get(s, i - 1), r)) | same(F.get(s, i + 1), r), r["i"])), lambda r: r.isNotNull())))
        return let(rows, repeated)

    def count(w):
        return F.when(F.size(w) < WINDOW + 1, F.lit(0)).when(
            F.size(w) <= mask, F.coalesce(by_hash(w), by_words(w))).otherwise(by_words(w))

    return count(words)


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_lines, _n_dup_lines and
    _n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(FULL))
    counted = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("kinds")))
    words = docs.withColumn("_words", words_of(F.col(text_col))).withColumn("_lines", counted)
    return words.select(
        *docs.columns,
        F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("_n_symbols"),
        F.col("_lines.n").alias("_n_lines"), (F.col("_lines.n") - F.col("_lines.kinds")).alias("_n_dup_lines"),
        let(F.col("_words"), repeat_words).cast("long").alias("_n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """fails: true where the document is rejected; reads text and the base columns."""

    name: str
    fails: Column


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", F.col("_n_words") < MIN_WORDS),
        Rule("repeated_words", 100 * F.col("_n_repeat_words") > 100 * MAX_REPEAT_SHARE * F.col("_n_words")),
    ]


def more_rules() -> list[Rule]:
    """Limits in hundredths, so that whole numbers decide."""
    n = F.col("_n_words")
    text = F.coalesce(F.col("text"), F.lit(""))
    no_letter = F.regexp_count(text, F.lit(r"(^|[\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+($|(?=[\x20\x09-\x0D]))"))

    def lines(pattern):
        return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern)))

    # most texts have no such sign at all
    bullets = F.when(text.contains("-") | text.contains("*") | text.contains("•"), lines(BULLET)).otherwise(0)
    unfinished = F.when(text.contains("...") | text.contains("…"), lines(UNFINISHED)).otherwise(0)
    return [
        Rule("symbols", 100 * F.col("_n_symbols") > 10 * n),
        Rule("short_words", 100 * F.col("_word_chars") < 300 * n),
        Rule("long_words", 100 * F.col("_word_chars") > 1000 * n),
        Rule("repeated_lines", 100 * F.col("_n_dup_lines") > 40 * F.col("_n_lines")),
        Rule("words_without_letters", 100 * no_letter > 20 * n),
        Rule("bullet_lines", 100 * bullets > 90 * F.col("_n_lines")),
        Rule("unfinished_lines", 100 * unfinished > 30 * F.col("_n_lines")),
    ]


def by_rejection_per_cost(rejected: list[tuple[frozenset, int]], costs: dict[str, float]) -> list[str]:
    """Names of costs (seconds an evaluation), best first; ties by name. rejected: (names
    of the rules that reject, number of rows). A rule counts the rows that no rule before
    it rejects."""
    left, order = list(rejected), []
    while len(order) < len(costs):
        rate = {name: sum(n for names, n in left if name in names) for name in costs if name not in order}
        best = min(rate, key=lambda name: (-rate[name] / max(costs[name], 1e-9), name))
        order.append(best)
        left = [(names, n) for names, n in left if best not in names]
    return order


def measured_costs(sample: DataFrame, rules: list[Rule], clock=time.perf_counter) -> dict[str, float]:
    """Seconds each rule takes on a row of the sample: what a job that evaluates it
    REPEATS times on every row takes beyond one that evaluates none, the least of TRIALS."""
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(fails):
        took = []
        for _ in range(TRIALS):
            began = clock()
            many.agg(F.count_if(fails)).first()
            took.append(clock() - began)
        return min(took)

    n, idle = max(1, sample.count()), seconds(F.col("_again") < 0)
    return {rule.name: max(0.0, seconds(rule.fails) - idle) / (n * REPEATS) for rule in rules}


def measured_order(docs: DataFrame, rules: list[Rule], clock=time.perf_counter) -> list[Rule]:
    """rules by rejection per cost on a random sample of the rows that pass the base rules."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = base_columns(docs.select("text").sample(share, seed=SEED)).where(~(base_rules()[0].fails | base_rules()[1].fails)).cache()
    # at most two to the power of the rules
    flags = sample.groupBy(*[rule.fails.alias(rule.name) for rule in rules]).count().collect()
    costs = measured_costs(sample, rules, clock)
    sample.unpersist()
    named = {rule.name: rule for rule in rules}
    rejected = [(frozenset(name for name in named if row[name]), row["count"]) for row in flags]
    return [named[name] for name in by_rejection_per_cost(rejected, costs)]


def first_failure(rules: list[Rule]) -> Column:
    """Name of the first rule that fails, null if none does; later ones aren't evaluated."""
    chain = None
    for rule in rules:
        chain = F.when(rule.fails, rule.name) if chain is None else chain.when(rule.fails, rule.name)
    return chain if chain is not None else F.lit(None).cast("string")


def judged(docs: DataFrame) -> DataFrame:
    """docs with the base columns, `_base_failed`, `_reason` (name of the failed rule or
    null) and `_kept`.

    Defined cases: null and empty texts have no words and fail the base; all counts are
    over the whole text; repeated rows are judged alike; other columns pass through, but
    none may be called like those that are added (kept() takes any names); an empty table
    gives no rows.
    """
    added = ("_words", "_lines", "_n_lines", "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_reason", "_kept")
    if taken := [c for c in docs.columns if c.lower() in added]:
        raise ValueError(f"columns that judged() adds: {taken}")
    order = measured_order(docs, more_rules())
    base = base_columns(docs)
    failed = base_rules()[0].fails | base_rules()[1].fails
    return (base.withColumn("_base_failed", failed)
            .withColumn("_reason", F.when(F.col("_base_failed"), "base").otherwise(first_failure(order)))
            .withColumn("_kept", F.col("_reason").isNull()))


def kept(docs: DataFrame) -> DataFrame:
    """Rows of docs that no rule rejects, with their columns, whatever their names."""
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return judged(rows).where("_kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_quality_cascade(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select(
        "doc_id", *[F.col("_" + c).alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT k, i, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
seen AS (SELECT k, i, count(*) OVER (PARTITION BY k, x, y, z) AS n FROM grams),
repeats AS (
  SELECT k, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM seen WHERE n > 1) GROUP BY k),
line AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^[\x20\x09]*[-*•]')) AS n_bullets,
         count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*\z')) AS n_unfinished
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_unfinished, 0) AS n_unfinished,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS no_letter
  FROM d LEFT JOIN repeats USING (k) LEFT JOIN lines USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 100 * n_symbols > 10 * n_words
            OR 100 * word_chars < 300 * n_words OR 100 * word_chars > 1000 * n_words
            OR 100 * n_dup_lines > 40 * n_lines OR 100 * no_letter > 20 * n_words
            OR 100 * n_bullets > 90 * n_lines OR 100 * n_unfinished > 30 * n_lines) AS kept
FROM f
"""
