"""Adverts, work information and author notes: features of a line, spans with a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import clean, compact, without_blanks
from bookloom.functions.formats import hosts
from bookloom.functions.forms import B, S, one_of, spaced, words
from bookloom.functions.markup import bind

# Fixed values of the text format -------------------------
PUBLISH = ("發布頁", "发布页", "發佈頁", "下載頁", "下载页", "下載地址", "下载地址", "最新地址", "最新網址", "最新网址", "备用网址", "備用網址", "访问地址", "訪問地址",
           "手機閱讀", "手机阅读", "請記住", "请记住", "防失聯", "防失联", "網址", "网址", "網站", "网站")
GROUP = ("qq群", "q群", "群號", "群号", "加群", "扣扣群", "内群", "內群", "交流群", "进群", "進群", "粉丝群", "粉絲群", "qq")
CHAT = ("微信群", "微信號", "微信号", "微信", "公眾號", "公众号", "威信群")
DISCLAIMERS = ("仅供个人学习", "僅供個人學習", "仅供学习交流", "僅供學習交流", "24小时内删除", "24小時內刪除", "版权归原作者", "版權歸原作者", "非法及商业用途", "非法及商業用途",
               "与制作者无关", "與製作者無關", "视改动者为制作人", "視改動者為製作人", "支持订阅正版", "支持訂閱正版", "请支持正版", "請支持正版")
SOURCE = ("本書來自", "本书来自", "本文來自", "本文来自", "本文件來自", "本文件来自", "小說下載", "小说下载", "電子書下載", "电子书下载", "由本站整理", "本站發布", "本站发布",
          "更多精彩", "求收藏", "求推薦", "求推荐", "资源共享", "資源共享", "免费找书", "免費找書", "全网小说", "全網小說", *DISCLAIMERS)
CIRCLED = "⓪①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳❶❷❸❹❺❻❼❽❾➀➁➂➃➄➅➆➇➈㊀㊁㊂㊃㊄㊅㊆㊇㊈㊉⑴⑵⑶⑷⑸⑹⑺⑻⑼⒈⒉⒊⒋⒌⒍⒎⒏⒐"
WRITTEN = "〇零一二三四五六七八九"
ACCOUNT_DIGITS, MIXED_DIGITS, MIXED_LINE = 4, 7, 30
PLATFORMS = ("发表于", "發表於", "发表於", "首发", "首發", "发布于", "發佈於", "發布於", "转载自", "轉載自", "原发", "原發")
INFO_LINE, REPEATED, SENTENCE_TAILS = 40, 10, "。！？!?…」』”》)）"
NOTE_HEADS = ("作者有话说", "作者有話說", "作者的话", "作者的話", "作者感言", "作者按", "上架感言", "完本感言", "完结感言", "完結感言", "单章感言", "單章感言",
              "新书感言", "新書感言", "感言:", "写在后面", "写在最后", "寫在後面", "寫在最後", "题外话", "題外話", "推一本", "推荐一本", "推薦一本", "推书:", "推書:",
              "今晚无更", "今晚無更", "今天无更", "今天無更")
NOTE_SIGNS, CUTS, PAREN_NOTE = "-—–_~=*※☆★◆◇●○", ("分割线", "分割線", "分隔线", "分隔線", "分界线", "分界線"), 200
NOTE_WORDS = (
    "作者", "读者", "讀者", "书友", "書友", "感谢", "感謝", "谢谢", "謝謝", "订阅", "訂閱", "首订", "首訂", "月票", "推荐票", "推薦票", "打赏", "打賞", "收藏", "投票",
    "加更", "更新", "停更", "断更", "斷更", "请假", "請假", "上架", "新书", "新書", "本书", "本書", "这章", "這章", "本章", "下一章", "码字", "碼字", "卡文", "灵感", "靈感",
    "抱歉", "见谅", "見諒", "评论", "評論", "点赞", "點贊", "企鹅", "企鵝", "qq", "vip", "主页", "主頁", "私信", "私聊", "简介", "簡介", "后续", "後續", "约稿", "約稿",
    "金主", "购文", "購文", "包书", "包書", "读者群", "讀者群", "订阅群", "訂閱群", "or2", "orz", "大佬", "票", "求票", "推荐", "推薦", "无更", "無更", "补上", "補上",
    "补更", "補更", "休息一天", "恢复更新", "恢復更新", "总结", "總結", "推一本", "推书", "推書")
# ---------------------------------------------------------------------------------------
_DAY = spaced(r"[0-9]{4}", "[-/年.]", "[0-9]{1,2}", "[-/月.]", "[0-9]{1,2}", "日?")
EDGE_ROWS = 200
SPAN_ROWS = 5


def _narrow(text: Column) -> Column:
    """Figures, Latin letters and signs of one width."""
    narrow = [chr(c) for c in range(0x21, 0x7F)]
    return F.translate(text, "".join(chr(ord(c) + 0xFEE0) for c in narrow), "".join(narrow))


def mixed_number(text: Column) -> Column:
    """A number in a short line that mixes figures, circled and written ones, one of them
    circled or 〇."""
    t = clean(text)
    counts = [F.regexp_count(t, F.lit(c)) for c in ("[0-9０-９]", one_of(CIRCLED), one_of(WRITTEN))]
    kinds = sum((F.when(n > 0, 1).otherwise(0) for n in counts), F.lit(0))
    return (F.length(t) <= MIXED_LINE) & t.rlike(one_of(CIRCLED + "〇")) & (counts[0] + counts[1] + counts[2] >= MIXED_DIGITS) & (kinds >= 2)


def features(text: Column) -> dict[str, Column]:
    """Kinds of advert in a line."""
    form = compact(_narrow(text))
    account = form.rlike(words(*GROUP)) & (F.regexp_count(form, F.lit("[0-9]")) >= ACCOUNT_DIGITS)
    return {"publish": form.rlike(words(*PUBLISH)), "source": form.rlike(words(*SOURCE)), "chat": form.rlike(words(*CHAT)),
            "group": account | mixed_number(text), "url": F.size(hosts(text)) > 0}


def work_info(text: Column) -> Column:
    """high, medium or null: author, word count or platform; a date or a line of one
    character; nothing in long lines and, but for the latter, in sentences."""
    t = _narrow(clean(text))
    one = (F.length(without_blanks(t)) >= REPEATED) & (F.replace(without_blanks(t), F.left(t, F.lit(1)), F.lit("")) == "")
    told = words(*PLATFORMS)
    platform = t.rlike(f"^({told})") | (t.rlike(f"^{_DAY}") & t.rlike(told))
    return F.when((F.length(t) > INFO_LINE) | (t == ""), F.lit(None)).when(one, "medium").when(t.rlike(one_of(SENTENCE_TAILS) + "$"), F.lit(None)).when(
        t.rlike(f"^{spaced('作', '者', '[:：]')}{B}[^{S}].{{0,20}}$") | t.rlike(f"^{spaced('字', '[数數]', '[:：]?', '[0-9]{2,9}', '字?')}$") | platform, "high").when(
        t.rlike(told), F.lit(None)).when(t.rlike(f"^{_DAY}$"), "medium")


def _note_form(text: Column) -> Column:
    return compact(without_blanks(_narrow(text)))


def note_trigger(text: Column) -> Column:
    """How an author note starts: header (its words, or two note words behind signs), ps,
    separator, paren or null."""
    t = _note_form(text)
    sign = one_of(NOTE_SIGNS)
    behind = F.regexp_replace(t, f"^{sign}+", "")
    led = t.rlike(f"^{sign}{{2,}}[^{sign[1:-1]}]")
    return F.when(t.rlike(f"^({words(*NOTE_HEADS)}|[一二三四五六七八九十]{{1,2}}月(总结|總結))"), "header").when(t.rlike(r"^p\.?s\.?[:：.,，、]"), "ps").when(
        led & (n_note_words(behind) >= 2), "header").when(t.rlike(f"^{sign}{{2,}}({words(*CUTS)})?{sign}*$"), "separator").when(
        t.rlike(r"^[(（【\[].*[)）】\]][。．.！!]?$") & (F.length(t) <= PAREN_NOTE), "paren")


def n_note_words(text: Column) -> Column:
    """Different note words of a line; one that lies inside a longer one found doesn't count."""
    def counted(t):
        found = F.filter(F.array(*[F.lit(w) for w in NOTE_WORDS]), lambda w: F.contains(t, w))
        return bind(found, lambda some: F.size(F.filter(some, lambda w: ~F.exists(some, lambda v: (v != w) & F.contains(v, w)))))

    return bind(_note_form(text), counted).cast("long")


def narrative(text: Column) -> Column:
    """Forty characters or more that are indented or speak."""
    return (F.length(text) >= 40) & text.rlike("^(　　|[ 　]*[「“『])")


def candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, start, end, types, score, confidence): runs of lines with features, at
    most one line without between. Score: two for each type, one at either end of the
    text, two for source words; narrative caps it at two; 5 is high, 3 medium."""
    kinds = features(F.col("text"))
    rows = lines.withColumns({
        "_types": F.array_compact(F.array(*[F.when(c, n) for n, c in kinds.items()], F.when(work_info(F.col("text")).isNotNull(), "work_info"))),
        "_story": narrative(F.col("text")), "_rows": F.max("row").over(Window.partitionBy("doc_id"))})
    hit = rows.where(F.size("_types") > 0)
    order = Window.partitionBy("doc_id").orderBy("row")
    runs = hit.withColumn("_new", F.when(F.col("row") - F.lag("row").over(order) <= 2, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    spans = runs.groupBy("doc_id", "_run").agg(
        F.min("row").alias("start"), F.max("row").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_types")))).alias("types"),
        F.bool_or("_story").alias("_story"), F.max("_rows").alias("_rows"))
    edge = (F.col("start") < EDGE_ROWS) | (F.col("end") > F.col("_rows") - EDGE_ROWS)
    raw = 2 * F.size("types") + F.when(edge, 1).otherwise(0) + F.when(F.array_contains("types", "source"), 2).otherwise(0)
    score = F.when(F.col("_story"), F.least(raw, F.lit(2))).otherwise(raw)
    return spans.select("doc_id", "start", "end", "types", score.cast("long").alias("score"),
                        F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low").alias("confidence"))


def note_blocks(lines: DataFrame, titles: DataFrame, most_rows: int = 60) -> DataFrame:
    """(doc_id, start, end, trigger): from a note's start to the row before the next
    title, where that is at most most_rows away (or the end of the text)."""
    by_row = Window.partitionBy("doc_id").orderBy("row")
    marked = lines.join(titles.select("doc_id", "row", F.col("row").alias("_title")), ["doc_id", "row"], "left")
    ahead = by_row.rowsBetween(1, most_rows)
    rows = marked.withColumns({"trigger": note_trigger(F.col("text")), "_next": F.first("_title", ignorenulls=True).over(ahead), "_last": F.max("row").over(Window.partitionBy("doc_id")),
                               "_section": F.count("_title").over(by_row)})
    stop = F.coalesce(F.col("_next") - 1, F.when(F.col("_last") - F.col("row") <= most_rows, F.col("_last")))
    first = Window.partitionBy("doc_id", "_section").orderBy("row")
    found = rows.where("trigger IN ('header', 'ps', 'paren') AND _title IS NULL").withColumn("end", stop).where("end IS NOT NULL")
    return found.withColumn("_i", F.row_number().over(first)).where("_i = 1").select("doc_id", F.col("row").alias("start"), "end", "trigger")
