"""Benchmark decontamination by templates.

Words become template tokens: words with a digit and number words are <number>, unit words
behind figures <unit>, capitalised words inside a sentence <name>, all others their
lower-case letters. Runs of WINDOW tokens are hashed and joined with the benchmark's; a
document that has at least MIN_SHARE of an item's windows is a candidate. In the
alignment of item and document with most windows, each of the item's numbers, units and
names must stand for one value of the document's in at least MIN_CONSISTENT of its
places: a re-parameterised question does that, chance does not. Only DataFrame functions
are used.

Placeholders are set in whole texts, by a few passes of string functions, before they are
cut into words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.llm.shared import WHITE_CLASS, let, read, words_of, written

WINDOW = 5
#: Least share of an item's windows, in hundredths.
MIN_SHARE = 80
#: Least share of slots whose value is the one its item value mostly stands for, in hundredths.
MIN_CONSISTENT = 80
#: Least number of words in a window that are not placeholders.
MIN_LITERALS = 2
#: Item windows are broadcast up to this many rows (24 bytes each), else shuffled.
MAX_BROADCAST_WINDOWS = 1_000_000
PUNCTUATION = ".,;:!?\"'()[]{}<>…«»“”‘’„¿¡-–—*_`~/\\"
SENTENCE_ENDS = ".!?…:"
#: Words that count as units behind a number.
UNITS = tuple((
    "km m cm mm nm mile miles yard yards foot feet ft inch inches in kg g mg lb lbs oz ton tons tonnes pound pounds gram grams kilogram kilograms "
    "l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros percent pct degree degrees kmh mph hz khz mhz ghz kb mb gb tb w kw v a j kj cal kcal pa bar").split())
#: Words that count as numbers.
NUMBER_WORDS = tuple((
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split())
#: Placeholders as they stand in texts.
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"

_INSIDE = "[^" + WHITE_CLASS[1:]
_STRIPPED = "[" + re.escape(PUNCTUATION) + "]+"
#: A word with a digit; the sentence end behind it stays. It only starts where a word does.
_FIGURES = rf"(?<!{_INSIDE})[^0-9{WHITE_CLASS[1:]}*+[0-9](?:{_INSIDE}*[^{SENTENCE_ENDS}{WHITE_CLASS[1:]})?"
#: Title case, or one capital letter alone, behind one blank and no sentence end.
_TITLE = rf"\p{{Lu}}(?:(?={_INSIDE}*\p{{Ll}}){_INSIDE}*+|(?!{_INSIDE}))"
_NAMES = rf"(?<=[^{SENTENCE_ENDS}{WHITE_CLASS[1:]}[\x20\x09]){_TITLE}"
_MEASURES = rf"{NUMBER}({WHITE_CLASS}+)(?:{'|'.join(UNITS)})(?!{_INSIDE})"


def core(word: Column) -> Column:
    return F.translate(F.lower(word), PUNCTUATION, "")


def template(text: Column) -> Column:
    """array<string>: the tokens of a text."""
    figures = F.when(text.rlike("[0-9]"), F.regexp_replace(text, _FIGURES, NUMBER)).otherwise(text)
    plain = F.regexp_replace(F.lower(F.regexp_replace(figures, _NAMES, NAME)), _STRIPPED, "")
    # bound, as it stands three times
    measured = let(plain, lambda t: F.when(F.contains(t, F.lit(NUMBER)), F.regexp_replace(t, _MEASURES, f"{NUMBER}$1{UNIT}")).otherwise(t))
    return F.array_remove(F.split(measured, f"{WHITE_CLASS}+"), "")


def hash_of(token: str) -> Column:
    return F.xxhash64(F.lit(token))


def codes_of(tokens: Column) -> Column:
    """array<long>: hashes of tokens, those of number words like those of figures."""
    from_words = F.transform(tokens, lambda t: F.xxhash64(t))
    return F.transform(from_words, lambda h: F.when(h.isin(*[hash_of(w) for w in NUMBER_WORDS]), hash_of(NUMBER)).otherwise(h))


def is_slot(code: Column) -> Column:
    return code.isin(hash_of(NUMBER), hash_of(NAME), hash_of(UNIT))


def values_of(text: Column) -> Column:
    """array<string>: what stands for each token in a text."""
    return F.filter(F.transform(words_of(text), core), lambda c: c != "")


def window_hashes(codes: Column, n: int) -> Column:
    return F.when(F.size(codes) >= n, F.transform(F.sequence(F.lit(0), F.size(codes) - n), lambda i: F.xxhash64(F.slice(codes, i + 1, F.lit(n)))))


def coded(rows: DataFrame, key: str) -> DataFrame:
    """(key, codes) of rows with a key."""
    return rows.where(f"{key} IS NOT NULL").select(key, codes_of(template(F.coalesce("text", F.lit("")))).alias("codes"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, size, at, window, n_windows): windows of each item; an item of fewer
    than WINDOW words is one window of its own size. The first word of an item starts a
    sentence but its copy may not, so where it is capitalised the first window is there
    twice, the second time with a name."""
    own = items.select("item_id", "text", F.coalesce("text", F.lit("")).rlike(rf"^{WHITE_CLASS}*{_TITLE}").alias("titled"))
    found = coded(own, "item_id").withColumn("titled", F.lit(False))
    renamed = coded(own.where("titled"), "item_id").select(
        "item_id", F.concat(F.array(hash_of(NAME)), F.slice("codes", F.lit(2), F.greatest(F.size("codes") - 1, F.lit(0)))).alias("codes"), F.lit(True).alias("titled"))
    found = written(found.unionByName(renamed).withColumn("size", F.least(F.lit(WINDOW), F.size("codes"))).where("size > 0"))
    hashes = F.lit(None)
    for n in range(1, WINDOW + 1):
        hashes = F.when(F.col("size") == n, window_hashes(F.col("codes"), n)).otherwise(hashes)
    rows = found.select("item_id", "size", "codes", "titled", F.posexplode(hashes).alias("at", "window")).where("NOT titled OR at = 0")
    literals = F.size(F.filter(F.slice("codes", F.col("at") + 1, F.col("size")), lambda c: ~is_slot(c)))
    rows = rows.where(literals >= F.least(F.lit(MIN_LITERALS), F.col("size"))).select("item_id", "size", "at", "window").distinct()
    total = rows.groupBy("item_id").agg(F.count_distinct("at").alias("n_windows"))
    return rows.join(total, "item_id")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots): contaminated documents and the
    items they leak.

    Defined cases: null and empty texts and null ids match nothing; rows that share a
    doc_id (or item_id) are taken together; items without two words that are not
    placeholders in any window can't match; of alignments with equally many windows the
    least shift is taken; an empty benchmark gives no rows; other columns are not read,
    whatever their names.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    wanted = written(item_windows(items))
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # at most WINDOW numbers
    bounded = F.broadcast if wanted.count() <= MAX_BROADCAST_WINDOWS else (lambda df: df)
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, n_matched long, n_windows long, n_slots long")
    none = F.array().cast("array<long>")
    hashes = F.array_distinct(F.concat(*[F.coalesce(window_hashes(F.col("codes"), n), none) for n in sizes]))
    # outer: no filter on the arrays is inferred, which would compute the tokens of a text once more
    own_windows = coded(docs, "doc_id").select("doc_id", F.explode_outer(hashes).alias("window"))
    hits = own_windows.join(bounded(wanted.select("item_id", "at", "window", "n_windows").distinct()), "window")
    candidates = written(hits.groupBy("doc_id", "item_id", "n_windows").agg(F.count_distinct("at").alias("n_matched"))
                         .where(F.col("n_matched") * 100 >= F.col("n_windows") * MIN_SHARE))
    # slots of candidates only, in the alignment with most windows; their tokens are written, so that each is made once
    pairs = candidates.select("doc_id", "item_id")
    leaking = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    own = written(leaking.select("doc_id", codes_of(template(F.coalesce("text", F.lit("")))).alias("codes"), values_of(F.col("text")).alias("cores")))
    of_items = written(items.where("item_id IS NOT NULL").select(
        "item_id", codes_of(template(F.coalesce("text", F.lit("")))).alias("codes"), values_of(F.col("text")).alias("cores")))
    placed = None
    for n in sizes:
        one = own.select("doc_id", F.posexplode_outer(window_hashes(F.col("codes"), n)).alias("doc_at", "window")).join(
            bounded(wanted.where(F.col("size") == n).select("item_id", "at", "window", "size")), "window")
        placed = one if placed is None else placed.unionByName(one)
    placed = written(placed.join(pairs, ["doc_id", "item_id"]).withColumn("shift", F.col("doc_at") - F.col("at")))
    best = placed.groupBy("doc_id", "item_id", "shift").agg(F.count_distinct("at").alias("n"))
    order = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n"), "shift")
    best = best.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("doc_id", "item_id", "shift")
    covered = placed.join(best, ["doc_id", "item_id", "shift"]).select(
        "doc_id", "item_id", "shift", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("at")).distinct()

    def slots_of(table, key, at, value):
        rows = table.select(key, "cores", F.posexplode("codes").alias(at, "code")).where(is_slot(F.col("code")))
        return rows.select(key, at, F.get("cores", F.col(at)).alias(value))

    slots = (covered.join(slots_of(of_items, "item_id", "at", "item_value"), ["item_id", "at"]).withColumn("doc_at", F.col("at") + F.col("shift"))
             .join(slots_of(own, "doc_id", "doc_at", "doc_value"), ["doc_id", "doc_at"]))
    same = slots.groupBy("doc_id", "item_id", "item_value", "doc_value").agg(F.count_distinct("at").alias("n"))
    best_of = same.groupBy("doc_id", "item_id", "item_value").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    told = best_of.groupBy("doc_id", "item_id").agg(F.sum("most").alias("n_consistent"), F.sum("n").alias("n_slots"))
    verdict = candidates.join(told, ["doc_id", "item_id"], "left").where(f"n_slots IS NULL OR n_consistent * 100 >= n_slots * {MIN_CONSISTENT}")
    return verdict.select("doc_id", "item_id", "n_matched", "n_windows", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without contaminated documents; rows with a null doc_id stay."""
    found = written(leaks(docs, items).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op1_template_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_PUNCTUATION_SQL = PUNCTUATION.replace("'", "''")
_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)
_NUMBERS_SQL = ", ".join(f"'{u}'" for u in NUMBER_WORDS)
_PARTS = r"'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+'"
#: Words with the white space in front, then tokens.
_CODES_SQL = f"""
SELECT kind, id, i, c, titled, CASE
    WHEN regexp_matches(w, '[0-9]') THEN '<number>'
    WHEN titled AND regexp_matches(space, '^[ \\t]$') AND right(before, 1) NOT IN ('.', '!', '?', '…', ':') THEN '<name>'
    WHEN c IN ({_UNITS_SQL}) AND regexp_matches(kept_before, '[0-9]') THEN '<unit>'
    WHEN c IN ({_NUMBERS_SQL}) THEN '<number>'
    ELSE c END AS t
FROM (SELECT *, lag(w) OVER (PARTITION BY kind, id ORDER BY i) AS kept_before
      FROM (SELECT kind, id, j, row_number() OVER (PARTITION BY kind, id ORDER BY j) AS i, w, space, before, c, titled
            FROM (SELECT *, translate(lower(w), '{_PUNCTUATION_SQL}', '') AS c, lag(w) OVER (PARTITION BY kind, id ORDER BY j) AS before,
                         regexp_matches(w, '^\\p{{Lu}}') AND (length(w) = 1 OR regexp_matches(w, '\\p{{Ll}}')) AS titled
                  FROM (SELECT kind, id, j, regexp_extract(p, '[^\\x20\\x09-\\x0D]+') AS w, regexp_extract(p, '^[\\x20\\x09-\\x0D]*') AS space
                        FROM (SELECT kind, id, unnest(v) AS p, unnest(range(len(v))) AS j
                              FROM (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(text, {_PARTS}) AS v FROM documents
                                    UNION ALL SELECT 'b', item_id, regexp_extract_all(text, {_PARTS}) FROM benchmark))))
            WHERE c <> ''))"""
ORACLE_SQL = f"""
WITH codes AS ({_CODES_SQL}),
five AS (
  SELECT kind, id, i, t, titled, [t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o] AS w
  FROM codes WINDOW o AS (PARTITION BY kind, id ORDER BY i)),
windows AS (SELECT kind, id, i, array_to_string(w, ' ') AS w5 FROM five WHERE w[5] IS NOT NULL),
items AS (
  SELECT DISTINCT id, i, w5 FROM (
    SELECT id, i, w5 FROM windows WHERE kind = 'b'
    UNION ALL SELECT id, i, array_to_string(['<name>', w[2], w[3], w[4], w[5]], ' ') FROM five WHERE kind = 'b' AND i = 1 AND titled AND w[5] IS NOT NULL)
  WHERE len(list_filter(string_split(w5, ' '), lambda x: x NOT IN ('<number>', '<unit>', '<name>'))) >= 2),
totals AS (SELECT id, count(DISTINCT i) AS n_windows FROM items GROUP BY id),
hits AS (SELECT d.id AS doc_id, b.id AS item_id, d.i AS di, b.i AS bi FROM windows d JOIN items b USING (w5) WHERE d.kind = 'd'),
candidates AS (
  SELECT doc_id, item_id, n_windows, count(DISTINCT bi) AS n_matched FROM hits JOIN totals ON item_id = totals.id
  GROUP BY ALL HAVING count(DISTINCT bi) * 100 >= n_windows * {MIN_SHARE}),
shifts AS (
  SELECT doc_id, item_id, di - bi AS shift, count(DISTINCT bi) AS n
  FROM hits SEMI JOIN candidates USING (doc_id, item_id) GROUP BY doc_id, item_id, di - bi),
best AS (
  SELECT doc_id, item_id, shift FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, shift) AS r FROM shifts) WHERE r = 1),
covered AS (
  SELECT DISTINCT doc_id, item_id, shift, unnest(range(bi, bi + 5)) AS pos
  FROM hits JOIN best USING (doc_id, item_id) WHERE di - bi = shift),
same AS (
  SELECT doc_id, item_id, b.c AS v, d.c AS w, count(DISTINCT pos) AS n
  FROM covered JOIN codes b ON b.kind = 'b' AND b.id = item_id AND b.i = pos AND b.t IN ('<number>', '<unit>', '<name>')
  JOIN codes d ON d.kind = 'd' AND d.id = doc_id AND d.i = pos + shift AND d.t IN ('<number>', '<unit>', '<name>')
  GROUP BY ALL),
slots AS (
  SELECT doc_id, item_id, sum(most) AS n_consistent, sum(n) AS n_slots
  FROM (SELECT doc_id, item_id, v, max(n) AS most, sum(n) AS n FROM same GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_matched AS BIGINT) AS n_matched, CAST(n_windows AS BIGINT) AS n_windows, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots
FROM candidates LEFT JOIN slots USING (doc_id, item_id) WHERE n_slots IS NULL OR n_consistent * 100 >= n_slots * {MIN_CONSISTENT}
"""
