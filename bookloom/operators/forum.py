"""What a forum leaves in a book that was copied from it: headers of posts, notes right behind
them, and blocks of profiles and buttons.

Headers are few, so the rows around them meet by joins on (doc_id, row), which spread a long
book; profile blocks need running counts along a book, of rows without their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import clean
from bookloom.functions.forms import B, S, maybe, one_of, spaced, words
from bookloom.operators.adverts import n_note_words

# Fixed values of the text format -------------------------------------
HEADER_WORDS = ("举报", "舉報", "阅读数", "閱讀數", "阅读", "閱讀", "回复", "回覆", "楼主", "樓主", "只看该作者", "只看該作者", "发表于", "發表於", "点击", "點擊")
LABELS = ("帖子", "精华", "精華", "积分", "積分", "金币", "金幣", "原创", "原創", "威望", "支持", "感谢", "感謝", "贡献", "貢獻", "赞助", "贊助", "推广", "推廣",
          "阅读权限", "閱讀權限", "注册时间", "註冊時間", "在线时间", "在線時間", "最后登录", "最後登錄", "主题", "主題", "好友", "听众", "聽眾",
          "用户组", "用戶組", "经验", "經驗", "等级", "等級", "UID", "性别", "性別", "来自", "來自")
BUTTONS = ("个人空间", "個人空間", "发短消息", "發短消息", "加为好友", "加為好友", "当前离线", "當前離線", "当前在线", "當前在線", "查看宝箱", "查看寶箱",
           "使用道具", "放入宝箱", "放入寶箱", "只看该作者", "只看該作者", "楼大中小", "樓大中小", "本贴共获得感谢", "本帖共獲得感謝", "点此感谢", "點此感謝",
           "本帖最后由", "本帖最後由", "评分记录", "評分記錄", "作者的其他主题", "作者的其他主題")
RATED = ("金币", "金幣", "贡献", "貢獻", "威望", "积分", "積分")
RANKS = ("Super Moderator", "Moderator", "Administrator", "版主")
UNITS = ("枚", "贴", "帖", "點", "点", "度", "值", "次", "人", "个", "個", "分", "篇", "小时", "小時")
MEDALS = ("勋章", "勳章")
SENTENCE_TAILS, SPEECH = "。！？!?…」』”", "“「『\"‘"
HEADER_LENGTH, LONG_LINE, LABEL_LINE, TITLE_LINE, NAMED_LINE, NOTE_LINE, BETWEEN_LINE = 80, 1000, 80, 40, 60, 80, 16
MEMBERS, STRONG, BETWEEN, FOLLOWING, NOTE_REACH = 6, 2, 3, 2, 3
# ---------------------------------------------------------------------------------------
_CLOCK = r"\d{1,2}:\d{2}" + maybe(r":\d{2}")
#: A day of this or the last century with the time behind it.
MOMENT = spaced(r"(?:19|20)\d{2}", "[-/.年]", r"\d{1,2}", "[-/.月]", r"\d{1,2}日?") + f"[{S}]+{_CLOCK}"
NUMBERED = "[0-9０-９]|[一二三四五六七八九十百千]{1,6}[章回節节卷集]"
_WIDE = rf"({words(*MEDALS)})(.*({words(*MEDALS)})){{2}}|【[^】]{{1,30}}】.{{0,40}}作者[:：].*作者[:：]"
_SHOWN = rf"(?i)^LEVEL{B}\d+$|^Rank:{B}\d+|{words(*BUTTONS)}|({words(*RATED)}){B}[+＋-]{B}\d+|^({words(*RANKS)})$"
_VALUE = r"^(\d+" + maybe(r"\.\d+") + B + maybe(*UNITS) + r"|\d{4}-\d{1,2}-\d{1,2}" + maybe(f"[{S}]+{_CLOCK}") + ")$"


def is_header(text: Column) -> Column:
    """A day with its time and a word of a forum, in a line that is not long; null: false."""
    t = clean(text)
    return F.coalesce((F.length(t) <= HEADER_LENGTH) & t.rlike(MOMENT) & t.rlike(words(*HEADER_WORDS)), F.lit(False))


def strength(text: Column) -> Column:
    """2: words of a forum's pages; 1: a value such as a number or a day; 0: neither, or null."""
    t = clean(F.coalesce(text, F.lit("")))
    wide = t.rlike(_WIDE)
    return F.when(F.length(t) > LABEL_LINE, F.when((F.length(t) <= LONG_LINE) & wide, 2).otherwise(0)).when(
        t.isin(*LABELS) | t.rlike(_SHOWN) | wide, 2).when(t.rlike(_VALUE), 1).otherwise(0)


def _around(places: DataFrame, lines: DataFrame, titles: DataFrame, first: int, last: int) -> DataFrame:
    """places (doc_id, row, ...) with _near, a map from -1, 1, 2 ... to (text, title) of the rows
    so far away that exist."""
    heads = titles.select("doc_id", "row").distinct().withColumn("_title", F.lit(True))
    wanted = places.select("doc_id", F.col("row").alias("_at"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_off")).distinct().withColumn("row", F.col("_at") + F.col("_off"))
    texts = lines.select("doc_id", "row", clean(F.coalesce("text", F.lit(""))).alias("text"))
    met = wanted.join(texts, ["doc_id", "row"]).join(heads, ["doc_id", "row"], "left")
    entry = F.struct("_off", F.struct("text", F.coalesce("_title", F.lit(False)).alias("title")))
    near = met.groupBy("doc_id", F.col("_at").alias("row")).agg(F.map_from_entries(F.collect_list(entry)).alias("_near"))
    return places.join(near, ["doc_id", "row"], "left")


def _at(offset: int) -> Column:
    return F.try_element_at("_near", F.lit(offset))


def header_blocks(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, row, start, end) of headers: with the line above where it is a short one without
    a number and without the end of a sentence, and with the two rows below as far as they
    name the same writer, greet, or are lost characters. Rows of titles (doc_id, row) are in
    no block, but as headers themselves."""
    heads = lines.where(is_header(F.col("text"))).select("doc_id", "row", clean(F.element_at(F.split("text", MOMENT, 2), 1)).alias("_name"))
    rows = _around(heads, lines, titles, -1, FOLLOWING)
    above = _at(-1)
    taken = (above["text"] != "") & (F.length(above["text"]) <= TITLE_LINE) & ~above["text"].rlike(one_of(SENTENCE_TAILS) + "$") & ~above["title"] & ~above["text"].rlike(NUMBERED)
    end, going = F.col("row"), F.lit(True)
    for k in range(1, FOLLOWING + 1):
        text = _at(k)["text"]
        named = ((F.col("_name") != "") & F.contains(text, F.col("_name"))) | text.startswith("大家好")
        fits = (text != "") & ~_at(k)["title"] & ((named & (F.length(text) <= NAMED_LINE)) | text.rlike("^[?？]+$"))
        fits = F.coalesce(going & fits, F.lit(False))
        end = F.when(fits, F.col("row") + k).otherwise(end)
        going = going & F.coalesce((text == "") | fits, F.lit(False))
    return rows.select("doc_id", "row", F.when(F.coalesce(taken, F.lit(False)), F.col("row") - 1).otherwise(F.col("row")).alias("start"), end.alias("end"))


def post_notes(lines: DataFrame, blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, row, confidence) of writers' notes in the first line of text behind a block of
    header_blocks. Where the line behind that begins with lost characters, the text begins
    there: high with a note word, else medium; otherwise two note words make it medium."""
    rows = _around(blocks.select("doc_id", F.col("end").alias("row")).distinct(), lines, titles, 1, 2 * NOTE_REACH)
    note = F.coalesce(*[F.when(_at(k)["text"] != "", k) for k in range(1, NOTE_REACH + 1)])
    rows = rows.withColumn("_note", note).where("_note IS NOT NULL").withColumn("_line", F.try_element_at("_near", F.col("_note")))
    behind = F.coalesce(*[F.when((F.col("_note") < k) & (F.col("_note") + NOTE_REACH >= k) & (_at(k)["text"] != ""), _at(k)["text"]) for k in range(2, 2 * NOTE_REACH + 1)])
    text = F.col("_line.text")
    rows = rows.where(~F.col("_line.title") & (F.length(text) <= NOTE_LINE) & ~text.rlike("^" + one_of(SPEECH + "?")))
    rows = rows.withColumns({"_marked": F.coalesce(behind.startswith("?"), F.lit(False)), "_words": n_note_words(text)})
    confidence = F.when(F.col("_marked"), F.when(F.col("_words") > 0, "high").otherwise("medium")).when(F.col("_words") >= 2, "medium")
    return rows.select("doc_id", (F.col("row") + F.col("_note")).alias("row"), confidence.alias("confidence")).where("confidence IS NOT NULL").distinct()


def profile_blocks(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, start, end, n, n_strong) of runs of at least MEMBERS lines of a forum's pages,
    STRONG of them more than values. Blank rows do not count; up to BETWEEN short lines that
    are no titles may stand between two such lines. A title is a member only as a value that is
    not marked as a title by hand ([::])."""
    heads = titles.select("doc_id", "row").distinct().withColumn("_title", F.lit(True))
    t = clean(F.coalesce("text", F.lit("")))
    slim = lines.select("doc_id", "row", strength(F.col("text")).alias("_s"), (F.length(t) > BETWEEN_LINE).alias("_long"), t.endswith("[::]").alias("_by_hand"), (t != "").alias("_full")).where("_full")
    rows = slim.join(heads, ["doc_id", "row"], "left")
    rows = rows.withColumn("_s", F.when(F.col("_title") & ((F.col("_s") == 2) | F.col("_by_hand")), 0).otherwise(F.col("_s")))
    order = Window.partitionBy("doc_id").orderBy("row")
    stops = F.when((F.col("_s") == 0) & (F.col("_long") | F.col("_title").isNotNull()), 1).otherwise(0)
    counted = rows.withColumns({"_nth": F.row_number().over(order), "_stops": F.sum(stops).over(order)}).where("_s > 0")
    joins = (F.col("_stops") == F.lag("_stops").over(order)) & (F.col("_nth") - F.lag("_nth").over(order) <= BETWEEN + 1)
    runs = counted.withColumn("_run", F.sum(F.when(joins, 0).otherwise(1)).over(order))
    found = runs.groupBy("doc_id", "_run").agg(F.min("row").alias("start"), F.max("row").alias("end"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_s") == 2).alias("n_strong"))
    return found.where((F.col("n") >= MEMBERS) & (F.col("n_strong") >= STRONG)).drop("_run")
