"""Chapter numbers that are typed wrong, and numbers that are no chapters'.

One fold over the numbers of a group carries the number that the last chapter should have;
it looks at the next LOOK numbers and decides for a run at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest run that is judged at once; how far off several strays, and a first number, must be; last places that have no follower.
LOOK, FAR, TAIL = 3, 10, 3


def _one_digit_more(value: Column, expected: Column) -> Column:
    """value is expected with a digit put in somewhere."""
    text, want = value.cast("long").cast("string"), expected.cast("long").cast("string")
    without = lambda i: F.concat(F.left(text, i - 1), F.substr(text, i + 1, F.length(text))) == want
    return (F.length(text) == F.length(want) + 1) & F.exists(F.sequence(F.lit(1), F.length(text)), without)


def number_anomalies(numbers: DataFrame, group: list[str]) -> DataFrame:
    """(group, idx, number, kind, guess): typo with the number that belongs there, or stray.

    A run of up to three numbers that count on but don't follow the chapter before, where the
    number behind the run shows what they should be, is a typo each; numbers far off between
    two that follow each other are strays, as is a first number far over the two behind it;
    among the last three a digit too many is a typo. numbers (group, idx, number); null
    numbers are left out, rows of one idx stand by number."""
    rows = numbers.where("number IS NOT NULL").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("idx", "number"))).alias("_n"))
    n = F.size("_n")
    value = lambda i: F.get(F.col("_n.number"), i)
    first_stray = F.coalesce((n >= 3) & (value(F.lit(1)) + 1 == value(F.lit(2))) & (value(F.lit(0)) > value(F.lit(1)) + FAR), F.lit(False))
    rows = rows.withColumn("_first", first_stray)

    def run_is_typo(i, prev, size):
        own = [value(i + k) for k in range(size)]
        counts = F.lit(True)
        for a, b in zip(own, own[1:], strict=False):
            counts = counts & (b == a + 1)
        return F.coalesce(counts & (own[0] != prev) & (own[0] != prev + 1) & (value(i + size) == prev + size + 1), F.lit(False))

    def run_is_stray(i, prev, size):
        far = F.lit(True)
        for k in range(size):
            far = far & (F.abs(value(i + k) - prev) > (1 if size == 1 else FAR))
        return F.coalesce(far & (value(i + size) == prev + 1), F.lit(False))

    def size_of(test, i, prev):
        out = F.lit(0)
        for size in range(LOOK, 0, -1):
            out = F.when(test(i, prev, size), size).otherwise(out)
        return out

    none = F.lit(None).cast("double")

    def state(prev, eff, left, kind, out):
        return F.struct(prev.cast("double").alias("prev"), eff.cast("double").alias("eff"), left.cast("int").alias("left"), kind.alias("kind"), out.alias("out"))

    def let(x, body):
        return F.element_at(F.transform(F.array(x), body), 1)

    def step(acc, i):
        current = value(i).cast("double")
        typo, stray = size_of(run_is_typo, i, acc["prev"]), size_of(run_is_stray, i, acc["prev"])
        middle = (i >= 1) & (i < n - 1)
        # a first number that is a stray leaves the second as it is
        skip = F.col("_first") & (i <= 1)
        fresh = F.when(skip | ~middle, F.struct(F.lit(0).alias("size"), F.lit("").alias("kind"))).when(typo > 0, F.struct(typo.alias("size"), F.lit("typo").alias("kind"))).when(
            stray > 0, F.struct(stray.alias("size"), F.lit("stray").alias("kind"))).otherwise(F.struct(F.lit(0).alias("size"), F.lit("").alias("kind")))
        now = F.when(acc["left"] > 0, F.struct(acc["left"].alias("size"), acc["kind"].alias("kind"))).otherwise(fresh)

        def decided(x):
            first = F.col("_first") & (i == 0)
            tail = (x["size"] == 0) & ~first & (i >= F.greatest(F.lit(1), n - TAIL)) & acc["eff"].isNotNull() & (current != acc["eff"] + 1) & _one_digit_more(current, acc["eff"] + 1)
            kind = F.when(first, "stray").when(x["size"] > 0, x["kind"]).when(F.coalesce(tail, F.lit(False)), "typo").otherwise("")
            guess = F.when(x["size"] > 0, F.when(x["kind"] == "typo", acc["prev"] + 1)).when(kind == "typo", acc["eff"] + 1)
            prev = F.when(first, value(F.lit(1))).when(x["size"] > 0, F.when(x["kind"] == "typo", acc["prev"] + 1).otherwise(acc["prev"])).otherwise(current)
            eff = F.when(kind == "stray", acc["eff"]).otherwise(F.coalesce(guess, current))
            entry = F.struct(i.alias("i"), kind.alias("kind"), guess.cast("long").alias("guess"))
            return state(prev, eff, F.greatest(x["size"] - 1, F.lit(0)), x["kind"], F.when(kind != "", F.array_append(acc["out"], entry)).otherwise(acc["out"]))

        return let(now, decided)

    empty = F.expr("cast(array() as array<struct<i: int, kind: string, guess: bigint>>)")
    found = F.aggregate(F.sequence(F.lit(0), n - 1), state(none, none, F.lit(0), F.lit(""), empty), step)["out"]
    out = rows.withColumn("_x", F.explode(found))
    return out.select(*group, F.get(F.col("_n.idx"), F.col("_x.i")).alias("idx"), F.get(F.col("_n.number"), F.col("_x.i")).alias("number"), F.col("_x.kind").alias("kind"), F.col("_x.guess").alias("guess"))
