"""Small operators over lines, titles and candidates: words to look at, lost characters,
front matter, split parts, section parents, match keys, long paragraphs, files in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import BLANK_CHARS, HAN, clean, half_width_digits
from bookloom.functions.markup import bind
from bookloom.functions.numerals import number
from bookloom.functions.titles import S, chapter, is_noise, strip_body
from bookloom.runtime import dealt

#: Cyrillic and Greek letters and the Latin ones they look like. Fixed values.
LOOK_ALIKE_FROM, LOOK_ALIKE_TO = "АВЕКМНОРСТХасеорхуіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaceopxyijABEZHIKMNOPTYXo"
_MIXED_WORD = r"([A-Za-z][\x{0370}-\x{03FF}\x{0400}-\x{04FF}]|[\x{0370}-\x{03FF}\x{0400}-\x{04FF}][A-Za-z])"
#: Words of a note at the end of a title. Fixed values.
NOTE_WORDS = ("求", "票", "訂閱", "订阅", "收藏", "推薦", "推荐", "打賞", "打赏", "加更", "更", "補", "补")
SECTION_UNITS = ("節", "节")
#: Numerals in file names.
_NUMERALS = "零〇一二兩两三四五六七八九十百千萬万"
MIN_PIECE, PIECE, LONG, SURELY_LONG = 80, 300, 300, 500


def suspicious(text: Column) -> Column:
    """array<string> of masked (asterisks beside a Han character), homoglyph (Latin mixed
    with letters that look like it) and noise_dot (a dot between Han characters)."""
    kinds = {"masked": rf"{HAN}\*+|\*+{HAN}", "homoglyph": _MIXED_WORD, "noise_dot": rf"{HAN}[.．·]{HAN}"}
    return F.filter(F.array(*[F.when(text.rlike(p), k) for k, p in kinds.items()]), lambda k: k.isNotNull())


def latin(text: Column) -> Column:
    """Look-alikes as the Latin letters they stand for, in texts that mix both."""
    return F.when(text.rlike(_MIXED_WORD), F.translate(text, LOOK_ALIKE_FROM, LOOK_ALIKE_TO)).otherwise(text)


def work_name(text: Column) -> Column:
    """May be a work's name: at most 30 characters, no sentence signs, no noise word."""
    return (text != "") & (F.length(text) <= 30) & ~text.rlike("[，,。！？!?；;：:”“「」]") & ~is_noise(text)


def injected(url: Column) -> Column:
    """Looks put in by a site: begins with www, wap or http, or has a capital behind a small letter."""
    return F.lower(url).rlike("^(www[.]|http|wap[.])") | F.regexp_replace(url, r"[^\p{L}]", "").rlike(r"\p{Ll}\p{Lu}")


def without_note(title: Column) -> Column:
    """A title without a note in brackets at its end that asks for votes and the like."""
    note = F.regexp_extract(title, r"[ 　]*([（(【\[][^（()）【】\[\]]{1,30}[）)】\]])[ 　]*$", 1)
    asks = F.lit(False)
    for word in NOTE_WORDS:
        asks = asks | note.contains(word)
    base = F.regexp_replace(title, r"[ 　]*[（(【\[][^（()）【】\[\]]{1,30}[）)】\]][ 　]*$", "")
    return F.when((note != "") & asks & (base != ""), base).otherwise(title)


def lost_characters(lines: DataFrame) -> DataFrame:
    """(doc_id, row, fix, confidence): lines that begin with ? where a character was lost,
    before one that isn't ASCII or the end of the line. A lone ? may be meant: medium."""
    pattern = r"^([ \t\x{3000}]*)(\?+)([^\x{0000}-\x{007F}].*|[ \t\x{3000}]*)$"
    rest = F.regexp_extract("text", pattern, 3)
    blank = F.translate(rest, BLANK_CHARS, "") == ""
    fix = F.when(blank, "").otherwise(F.concat(F.regexp_extract("text", pattern, 1), rest))
    confidence = F.when(blank & (F.length(F.regexp_extract("text", pattern, 2)) == 1), "medium").otherwise("high")
    return lines.where(F.col("text").rlike(pattern)).select("doc_id", "row", fix.alias("fix"), confidence.alias("confidence"))


def without_front_matter(candidates: DataFrame, titles: DataFrame, types=("work_info", "note")) -> DataFrame:
    """candidates (doc_id, start, end, types) but those wholly before the first title that
    only inform."""
    first = titles.groupBy("doc_id").agg(F.min("row").alias("_first"))
    informs = F.size(F.array_except("types", F.array(*[F.lit(t) for t in types]))) == 0
    return candidates.join(first, "doc_id", "left").where(~(informs & F.coalesce(F.col("end") < F.col("_first"), F.lit(False)))).drop("_first")


def edge_blanks(lines: DataFrame) -> DataFrame:
    """(doc_id, n_first, n_last): blank lines at the edges of a document."""
    full = F.when(F.translate("text", BLANK_CHARS, "") != "", F.col("row"))
    return lines.groupBy("doc_id").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.min(full).alias("first"), F.max(full).alias("last")).select(
        "doc_id", F.coalesce(F.col("first") - F.col("lo"), F.col("hi") - F.col("lo") + 1).alias("n_first"), F.coalesce(F.col("hi") - F.col("last"), F.lit(0)).alias("n_last"))


def split_parts(titles: DataFrame, group: list[str]) -> DataFrame:
    """(group): titles of one number that are parts of it and no duplicates: all but one at
    most have a part mark at the end, （上） or (2), and no mark comes twice."""
    mark = F.regexp_extract("name", r"[（(]第?([上中下]|[一二三四五六七八九十]+|[0-9]+)(部分)?[)）]$", 1)
    rows = titles.withColumn("_mark", F.when(mark != "", mark)).groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.count("_mark").alias("_marked"), F.count_distinct("_mark").alias("_kinds"))
    return rows.where("_n > 1 AND _marked >= _n - 1 AND _marked > 0 AND _kinds = _marked").select(*group)


def section_parents(records: DataFrame) -> DataFrame:
    """(doc_id, parent_row) under which 節 are parts of chapters: five of each at least,
    and the numbers of 節 start anew twice at least."""
    order = Window.partitionBy("doc_id", "parent_row").orderBy("row")
    is_section = F.col("unit").isin(*SECTION_UNITS)
    sections = records.where(is_section).withColumn("_again", (F.lag("number").over(order) >= F.col("number")).cast("int"))
    counted = sections.groupBy("doc_id", "parent_row").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("_again", F.lit(0))).alias("_restarts")).where("_n >= 5 AND _restarts >= 2")
    others = records.where(~is_section & (F.col("unit") != "")).groupBy("doc_id", "parent_row").agg(F.count(F.lit(1)).alias("_others")).where("_others >= 5")
    same = (counted.doc_id == others.doc_id) & counted.parent_row.eqNullSafe(others.parent_row)
    return counted.join(others, same, "left_semi").select("doc_id", "parent_row")


def match_keys(titles: DataFrame) -> DataFrame:
    """titles with the keys by which versions of a book are aligned: `key` (kind, unit, work,
    number and folded name) and `loose_key` (without the name)."""
    number = F.when(F.col("number") == F.floor("number"), F.col("number").cast("long").cast("string")).otherwise(F.col("number").cast("string"))
    loose = F.concat_ws("|", "kind", "unit", "work", number)
    folded = F.lower(F.regexp_replace("name", rf"[{S}\p{{P}}]+", ""))
    return titles.withColumn("loose_key", loose).withColumn("key", F.concat_ws("|", loose, folded))


def paragraphs(text: Column) -> Column:
    """array<string>: a long line cut behind sentences into pieces of about PIECE characters
    and at least MIN_PIECE, where no quote or bracket is open; shorter ones whole."""
    sentences = F.regexp_extract_all(text, F.lit(r"([^。！？!?…]+[。！？!?…]*[”’」』）)\"]*[ ]*|[。！？!?…]+)"), 1)
    count = lambda t, c: F.length(F.regexp_replace(t, f"[^{c}]+", ""))

    # what a sentence adds to its piece; the fold carries sums and where pieces end, no text
    def adds(x):
        return F.struct(F.length(x).alias("n"), (count(x, "「『“（(") - count(x, "」』”）)")).alias("open"), count(x, '"').alias("quotes"))

    def step(acc, x):
        n, open_, quotes = (acc[c] + x[c] for c in ("n", "open", "quotes"))
        full = (n >= PIECE) & (open_ == 0) & (quotes % 2 == 0)
        sums = [F.when(full, 0).otherwise(v).alias(c) for c, v in (("n", n), ("open", open_), ("quotes", quotes))]
        return F.struct((acc["at"] + 1).alias("at"), *sums, F.when(full, F.concat(acc["ends"], F.array(acc["at"] + 1))).otherwise(acc["ends"]).alias("ends"))

    def pieces(own, ends):
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        done = F.transform(ends, lambda e, i: F.array_join(F.slice(own, start(i) + 1, e - start(i)), ""))
        rest = F.array_join(F.slice(own, start(F.size(ends)) + 1, F.size(own)), "")
        return bind(done, lambda d: bind(rest, lambda r: finish(d, r)))

    def finish(done, rest):
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), rest)))
        return F.when(rest == "", done).when((F.length(rest) < MIN_PIECE) & (F.size(done) > 0), joined).otherwise(F.concat(done, F.array(rest)))

    zero = F.struct(*[F.lit(0).alias(c) for c in ("at", "n", "open", "quotes")], F.array().cast("array<int>").alias("ends"))
    cut = bind(sentences, lambda own: bind(F.aggregate(F.transform(own, adds), zero, step, lambda acc: acc["ends"]), lambda ends: pieces(own, ends)))
    return F.when(F.length(text) >= LONG, cut).otherwise(F.array(text))


def long_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, row, confidence, pieces) of lines that would be cut; SURELY_LONG: high."""
    rows = lines.where(F.length("text") >= LONG).withColumn("pieces", paragraphs(F.col("text"))).where(F.size("pieces") > 1)
    return rows.select("doc_id", "row", F.when(F.length("text") >= SURELY_LONG, "high").otherwise("medium").alias("confidence"), "pieces")


def cut_paragraphs(lines: DataFrame, level: str = "high") -> DataFrame:
    """lines renumbered, with src_row, long ones cut; level: high, or medium for all."""
    long = F.length("text") >= (SURELY_LONG if level == "high" else LONG)
    # dealt, as few bytes take long; outer: no filter on the pieces is inferred, which would cut the lines a second time
    cut = F.posexplode_outer(F.when(long, paragraphs(F.col("text"))).otherwise(F.array("text"))).alias("piece", "text")
    pieces = dealt(lines.select("doc_id", "row", "text"), "doc_id", "row").select("doc_id", F.col("row").alias("src_row"), cut).where("piece IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("src_row", "piece")
    return pieces.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("row"), "src_row", "text")


def name_key(name: Column) -> Column:
    """Sorts file names by the value of their numbers, in figures of either width or Chinese
    numerals: 第9章, 第十章, 第11章. Folders, the extension and the case of letters don't count."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\\\]", ""), r"(?<=.)\.[^.]*$", "")
    parts = F.regexp_extract_all(half_width_digits(stem), F.lit(f"([0-9]+|[{_NUMERALS}]+|[^0-9{_NUMERALS}]+)"), 1)
    padded = lambda digits: F.lpad(F.regexp_replace(digits, "^0+", ""), 20, "0")
    sorts = lambda p: F.when(p.rlike("^[0-9]"), padded(p)).when(p.rlike(f"^[{_NUMERALS}]"), padded(number(p).cast("long").cast("string"))).otherwise(F.lower(p))
    return F.array_join(F.transform(parts, sorts), "\x01")


def merged_files(files: DataFrame, title_from_name: bool = False) -> DataFrame:
    """(book, text) of files (book, name, text) in the order of name_key, a blank line
    between; null texts are left out. title_from_name: the name as a heading where none of
    the first five lines with text is one."""
    rows = files.where("text IS NOT NULL")
    if title_from_name:
        first = F.slice(F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, BLANK_CHARS, "") != ""), F.lit(1), F.lit(5))
        titled = F.exists(first, lambda x: chapter(clean(x)).isNotNull())
        rows = rows.withColumn("text", F.when(titled, F.col("text")).otherwise(F.concat(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", ""), F.lit("\n"), F.col("text"))))
    ordered = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct(name_key(F.col("name")).alias("k"), "name", "text"))).alias("parts"))
    return ordered.select("book", F.array_join(F.transform("parts", lambda p: F.rtrim(p["text"])), "\n\n").alias("text"))


#: Paths of a title and author that meet those of another in one row.
SAME_PIECE = 1024


def _pieces(files: DataFrame, path: str, author: str) -> DataFrame:
    """(_t, author, path): the paths of a title and author in arrays of about SAME_PIECE, as they
    are dealt by hash; null titles, which equal none, and null paths are left out."""
    rows = files.where(F.col("_t").isNotNull() & F.col(path).isNotNull())
    n_pieces = F.ceil(F.count(F.lit(1)) / SAME_PIECE)
    sizes = rows.groupBy("_t", author).agg(n_pieces.alias("_of")).where("_of > 1")
    dealt = rows.join(sizes, ["_t", author], "left").withColumn("_piece", F.pmod(F.xxhash64(path), F.coalesce("_of", F.lit(1))))
    return dealt.groupBy("_t", author, "_piece").agg(F.collect_list(path).alias(path)).drop("_piece")


def same_book(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, wanted_path, same_author) of files (path, title, author) whose title is that of
    a wanted one, blanks and case aside; authors must not differ where both are known.

    N files of a title give up to N ** 2 rows. Pieces of the titles' paths meet, are dealt
    anew and made rows, so no task has all of a title and only pairs of the result are made."""
    fold = lambda c: F.lower(F.regexp_replace(c, rf"[{S}]+", ""))
    known = lambda c: F.coalesce(fold(c), F.lit(""))
    left = _pieces(files.select("path", fold("title").alias("_t"), known("author").alias("_a")), "path", "_a")
    right = _pieces(wanted.select(F.col("path").alias("wanted_path"), fold("title").alias("_t"), known("author").alias("_b")), "wanted_path", "_b")
    same = left.where("_a <> ''").join(right.withColumnRenamed("_b", "_a"), ["_t", "_a"]).select("path", "wanted_path", F.lit(True).alias("same_author"))
    unknown = left.join(right, "_t").where("_a = '' OR _b = ''").select("path", "wanted_path", F.lit(False).alias("same_author"))
    met = same.union(unknown).repartition(files.sparkSession.sparkContext.defaultParallelism * 8)
    one = met.select("same_author", "wanted_path", F.explode("path").alias("path"))
    return one.select("path", F.explode("wanted_path").alias("wanted_path"), "same_author").where("path <> wanted_path")


def with_levels(titles: DataFrame, forced: DataFrame) -> DataFrame:
    """titles (doc_id, row, kind, ...) with the kind that forced (doc_id, row, level) sets:
    1 volume, 2 chapter, 0 excluded."""
    joined = titles.join(forced, ["doc_id", "row"], "left").where("level IS NULL OR level > 0")
    return joined.withColumn("kind", F.when(F.col("level") == 1, "volume").when(F.col("level") == 2, "chapter").otherwise(F.col("kind"))).drop("level")


def three_levels(titles: DataFrame) -> DataFrame:
    """titles with part_row and volume_row: the last 部 and the last other volume before each."""
    upto = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    part = (F.col("kind") == "volume") & (F.col("unit") == "部")
    part_row = F.last(F.when(part, F.col("row")), ignorenulls=True).over(upto)
    volume_row = F.last(F.when((F.col("kind") == "volume") & ~part, F.col("row")), ignorenulls=True).over(upto)
    return titles.withColumns({"part_row": F.when(~part, part_row), "volume_row": F.when((F.col("kind") != "volume") & (volume_row > F.coalesce(part_row, F.lit(-1))), volume_row)})


def chosen(candidates: DataFrame, level: str = "high") -> DataFrame:
    """candidates with `selected`: those of at least the level's confidence."""
    rank = lambda c: F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
    return candidates.withColumn("selected", rank(F.col("confidence")) >= rank(F.lit(level)))


def rule_coverage(matches: DataFrame, titles: DataFrame) -> DataFrame:
    """(rule, n_collected, n_missing): matches (doc_id, row, rule) that titles have or lack."""
    known = titles.select("doc_id", "row", F.lit(1).alias("_in")).distinct()
    return matches.join(known, ["doc_id", "row"], "left").groupBy("rule").agg(F.count("_in").alias("n_collected"), F.count_if(F.col("_in").isNull()).alias("n_missing"))


def named_chapters(titles: DataFrame) -> DataFrame:
    """titles whose name is left when notes and signs are taken off it."""
    return titles.withColumn("name", strip_body(without_note(F.col("name")))).where("name <> ''")
