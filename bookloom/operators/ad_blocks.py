"""Adverts in wholes: blocks between separators around a candidate, and fragments of a
site's name and address that stand in many lines of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import BLANK_CHARS
from bookloom.functions.forms import S, one_of
from bookloom.operators.adverts import features
from bookloom.operators.boilerplate import is_separator
from bookloom.operators.review import injected

# Fixed values of the text format -------------------------------------
REACH, MOST_INSIDE, MOST_FOLLOWING = 10, 12, 3
AD_TYPES = ("url", "publish", "group", "chat", "source")
LEAST_LINES, LEAST_REST, BEFORE, SURE_LINES = 3, 20, 12, 5
BOUNDARIES, DECORATIONS, FRAMES = "。！？!?，,；;：:”」』）)…—", "★☆】]〗」』）) 　・·の", "☆★【[〖「『（("
# ---------------------------------------------------------------------------------------
URL = (r"(?i)(?:https?://)?(?:www\.|wap\.|m\.)?[a-z0-9\-]{2,}(?:\.[a-z0-9\-]{2,})*\.(?:com|net|org|cc|info|cn|me|la|tw|xyz|top|vip|io)(?![a-z0-9])"
       r"(?:/[\w\-./?=&%#]*)?")


def _marked(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """lines with running numbers of what a block is judged by: rows with text that are no
    separators, and those of them without words of adverts; and the separators and titles
    nearest on both sides."""
    text = F.coalesce("text", F.lit(""))
    is_title = titles.select("doc_id", "row").distinct().withColumn("_title", F.lit(True))
    rows = lines.select("doc_id", "row", text.alias("text")).join(is_title, ["doc_id", "row"], "left")
    worded = F.lit(False)
    for found in features(F.col("text")).values():
        worded = worded | found
    rows = rows.withColumn("_sep", is_separator(F.col("text")) & F.col("_title").isNull())
    full = (F.translate("text", BLANK_CHARS, "") != "") & ~F.col("_sep")
    order = Window.partitionBy("doc_id").orderBy("row")
    rows = rows.withColumns({"_full": F.when(full, 1).otherwise(0), "_plain": F.when(full & ~worded, 1).otherwise(0)})
    # separators are counted too when one looks how far away something is
    rows = rows.withColumns({"_nf": F.sum("_full").over(order), "_np": F.sum("_plain").over(order)})
    at = F.struct("row", "_nf", "_np")
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    sep, title = F.when(F.col("_sep"), at), F.when(F.col("_title"), F.col("row"))
    return rows.withColumns({"_up": F.last(sep, ignorenulls=True).over(upto), "_up_title": F.last(title, ignorenulls=True).over(upto),
                             "_down": F.first(sep, ignorenulls=True).over(after), "_down_title": F.first(title, ignorenulls=True).over(after), "_own": at})


def between_separators(lines: DataFrame, candidates: DataFrame, titles: DataFrame) -> DataFrame:
    """candidates (doc_id, start, end, types) grown to the separators around them, and over
    short blocks of advert words right behind: separators within REACH lines of text on both
    sides with no title between, at most MOST_INSIDE lines inside, all that are added with
    words of adverts. Candidates that cannot grow, or are no adverts, stay as they are."""
    rows = _marked(lines, titles)
    slim = rows.select("doc_id", "row", "_sep", "_full", "_plain", "_nf", "_np", "_own", "_up", "_up_title", "_down", "_down_title")
    # a separator may lead on to the next: one to three lines between, all with words of adverts
    order = Window.partitionBy("doc_id").orderBy("row")
    seps = slim.where("_sep")
    near = F.col("_down").isNotNull() & (F.col("_down_title").isNull() | (F.col("_down_title") > F.col("_down.row")))
    n = F.col("_down._nf") - F.col("_nf")
    leads = near & n.between(1, MOST_FOLLOWING) & (F.col("_down._np") == F.col("_np"))
    stop = F.first(F.when(~F.coalesce(leads, F.lit(False)), F.col("_own")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    chain = seps.withColumn("_stop", stop).select("doc_id", F.col("row").alias("_bottom"), "_stop")
    first = slim.select("doc_id", F.col("row").alias("start"), F.when(F.col("_sep"), F.col("_own")).when(
        (F.col("_up_title").isNull() | (F.col("_up_title") < F.col("_up.row"))) & (F.col("_nf") - F.col("_full") - F.col("_up._nf") < REACH), F.col("_up")).alias("_top"),
        (F.col("_np") - F.col("_plain")).alias("_np_before"))
    last = slim.select("doc_id", F.col("row").alias("end"), F.when(F.col("_sep"), F.col("_own")).when(
        (F.col("_down_title").isNull() | (F.col("_down_title") > F.col("_down.row"))) & (F.col("_down._nf") - F.col("_nf") < REACH), F.col("_down")).alias("_low"), F.col("_np").alias("_np_end"))
    adverts = F.arrays_overlap(F.col("types"), F.array(*[F.lit(t) for t in AD_TYPES]))
    joined = candidates.join(first, ["doc_id", "start"], "left").join(last, ["doc_id", "end"], "left")
    inside = F.col("_low._nf") - F.col("_top._nf")
    added = (F.col("_low._np") - F.col("_top._np")) - (F.col("_np_end") - F.col("_np_before"))
    grows = F.coalesce(adverts & F.col("_top").isNotNull() & F.col("_low").isNotNull() & (inside <= MOST_INSIDE) & (added == 0), F.lit(False))
    joined = joined.withColumn("_grows", grows).withColumn("_bottom", F.when(F.col("_grows"), F.col("_low.row")))
    out = joined.join(chain, ["doc_id", "_bottom"], "left")
    return out.select("doc_id", F.when(F.col("_grows"), F.least("start", F.col("_top.row"))).otherwise(F.col("start")).alias("start"),
                      F.when(F.col("_grows"), F.greatest("end", F.col("_stop.row"))).otherwise(F.col("end")).alias("end"), *[c for c in candidates.columns if c not in ("doc_id", "start", "end")])


def _shared(low: Column, high: Column) -> Column:
    """What two texts begin with alike. Of the least and the greatest of many texts that is
    what they all begin with."""
    n = F.aggregate(F.sequence(F.lit(1), F.lit(BEFORE * 4)), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= F.length(low)) & (F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1))), i).otherwise(acc))
    return F.left(low, n)


def occurrences(lines: DataFrame) -> DataFrame:
    """(doc_id, row, text, url, at, upto, before, behind) of addresses in lines that say at
    least LEAST_REST characters besides, not grown onto a Latin letter."""
    found = lines.where(F.col("text").contains(".")).select("doc_id", "row", "text", F.regexp_extract_all("text", F.lit(URL), 0).alias("_u")).where(F.size("_u") > 0)
    found = found.withColumn("_p", F.split("text", URL, -1)).where(F.size("_p") == F.size("_u") + 1)
    start = lambda k: F.length(F.array_join(F.slice("_p", 1, k), "")) + F.length(F.array_join(F.slice("_u", 1, k - 1), ""))
    each = F.transform(F.sequence(F.lit(1), F.size("_u")), lambda k: F.struct(F.element_at("_u", k).alias("url"), start(k).alias("at")))
    rows = found.select("doc_id", "row", "text", F.explode(each).alias("x")).select("doc_id", "row", "text", "x.*").withColumn("upto", F.col("at") + F.length("url"))
    rows = rows.withColumns({"before": F.right(F.left("text", F.col("at")), F.lit(BEFORE)), "behind": F.substr("text", F.col("upto") + 1)})
    rest = F.length(F.regexp_replace(F.concat(F.left("text", F.col("at")), F.col("behind")), f"^[{S}]+|[{S}]+$", ""))
    return rows.where((rest >= LEAST_REST) & ~F.right("before", F.lit(1)).rlike("[A-Za-z]"))


def inline_fragments(lines: DataFrame) -> DataFrame:
    """(doc_id, row, fix, confidence) of lines of a book with an address that LEAST_LINES
    lines of it have: without the address and what stands around it in all of them alike.
    high from SURE_LINES lines on, where it mostly ends the line or is framed."""
    rows = occurrences(lines.where("text IS NOT NULL"))
    url = F.lower("url")
    ends = F.regexp_replace("behind", f"[{S}]+", "") == ""
    framed = F.right("before", F.lit(1)).rlike(one_of(FRAMES + "の")) | F.left("behind", F.lit(1)).rlike(one_of(DECORATIONS.replace(" ", "").replace("　", "")))
    after = F.left(F.concat("behind", F.lit(" ")), F.lit(BEFORE * 4))
    back = F.reverse(F.col("before"))
    sites = rows.groupBy("doc_id", url.alias("site")).agg(
        F.count_distinct("row").alias("n_lines"), F.count(F.lit(1)).alias("n"), F.min(back).alias("b1"), F.max(back).alias("b2"), F.min(after).alias("a1"), F.max(after).alias("a2"),
        F.bool_or(injected(F.col("url"))).alias("injected"), F.count_if(ends).alias("n_ends"), F.count_if(framed).alias("n_framed")).where(F.col("n_lines") >= LEAST_LINES)
    alike = F.reverse(_shared(F.col("b1"), F.col("b2")))
    alike = F.regexp_replace(alike, rf"^.*{one_of(BOUNDARIES)}", "")
    alike = F.when(alike.rlike(one_of(FRAMES)), F.regexp_replace(alike, rf"^.*(?={one_of(FRAMES)})", "")).otherwise(alike)
    behind = F.regexp_extract(_shared(F.col("a1"), F.col("a2")), f"^{one_of(DECORATIONS)}*", 0)
    sites = sites.select("doc_id", "site", "n_lines", "n", "injected", "n_ends", "n_framed", alike.alias("_left"), behind.alias("_right"))
    sites = sites.where((F.col("_left") != "") | (F.trim(F.translate("_right", "　", " ")) != "") | F.col("injected") | (F.col("n_ends") * 2 > F.col("n")))
    sure = (F.col("n_ends") * 2 > F.col("n")) | (F.col("n_framed") * 2 > F.col("n"))
    sites = sites.withColumn("n_lines", F.when(sure, F.col("n_lines")).otherwise(F.least("n_lines", F.lit(SURE_LINES - 1))))
    spans = rows.withColumn("site", url).join(sites, ["doc_id", "site"]).withColumns({"_from": F.col("at") - F.length("_left"), "_to": F.col("upto") + F.length("_right")})
    per = spans.groupBy("doc_id", "row").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_s"), F.max("n_lines").alias("n_lines"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    kept = F.aggregate("_s", start, lambda acc, s: F.struct(F.greatest(acc["at"], s["_to"]).alias("at"), F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.greatest(s["_from"] - acc["at"], F.lit(0)))).alias("out")))
    fix = F.regexp_replace(F.concat(kept["out"], F.substr("text", kept["at"] + 1)), f"[{S}]+$", "")
    out = per.select("doc_id", "row", "text", fix.alias("fix"), F.when(F.col("n_lines") >= SURE_LINES, "high").otherwise("medium").alias("confidence"))
    return out.where((F.regexp_replace("fix", f"[{S}]+", "") != "") & (F.col("fix") != F.col("text"))).select("doc_id", "row", "fix", "confidence")
