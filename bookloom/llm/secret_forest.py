"""Secret scanning with a random forest against false positives.

Candidates are words that could be credentials: long enough, with letters and digits, or
of any kind and length where they are assigned to a telling name, in one word or over
several. Each gets features of its length, its character transitions,
how much of it the corpus's own frequent words cover, where it was found (the path, here
the document's source) and the words before it. A random forest, trained on labelled
findings, keeps the true ones. Labels come from the caller, or from examples that Spark
makes: secrets of issued and free forms, and what scanners mistake for them, each in a
setting that doesn't give its label away. Everything runs as DataFrame functions and
Spark's DataFrame machine-learning library.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.shared import read, words_of, written

MIN_LENGTH = 8
#: Labelled findings the forest is trained on, at most (in order of their hash).
MAX_TRAINING = 20_000
#: Examples that are made where no labels are given.
EXAMPLES = 4000
#: A dictionary word makes up at least 1/DICTIONARY_PART of the words, so there are at
#: most DICTIONARY_PART of them: a broadcast with a proven bound.
DICTIONARY_PART = 50_000
THRESHOLD = 0.5
TREES, DEPTH, SEED = 20, 6, 7

#: Names that secrets are assigned to.
TELLING = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|auth|credential|bearer|private_?key|client_?secret)"
#: A name that something is assigned to.
NAME = "[A-Za-z_.-]{2,200}"
#: Words that tell an example from the real thing.
HARMLESS = r"(?i)(example|sample|dummy|test|placeholder|changeme|your|xxxx|redacted|fake|foo)"
#: Formats of issued credentials.
KNOWN = {
    "cloud_key_id": r"^(AKIA|ASIA)[A-Z0-9]{16}$", "repository_token": r"^gh[pousr]_[A-Za-z0-9]{36,}$", "chat_token": r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "payment_key": r"^(sk|rk)_(live|test)_[A-Za-z0-9]{16,}$", "web_token": r"^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*$", "model_key": r"^sk-[A-Za-z0-9_-]{20,}$",
}
#: Characters that transitions are counted between; digits are one, all others another.
LETTERS = "abcdefghijklmnopqrstuvwxyz0."
FEATURES = ("f_length", "f_transitions", "f_bigrams", "f_digits", "f_upper", "f_hex", "f_dictionary", "f_assigned", "f_known", "f_harmless",
            "f_address", "f_path_harmless", "f_neighbour_telling", "f_neighbour_harmless", "f_distinct")


def assigned_before(before: Column) -> Column:
    """The words in front, nearest first, end in an assignment and have a telling name."""
    nearest = F.coalesce(F.get(before, F.lit(0)), F.lit(""))
    return nearest.rlike(r"(^|[^=:])(:=|=>|=|:)$") & F.coalesce(F.array_join(before, " "), F.lit("")).rlike(TELLING)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, path, name, core, before): words that may be secrets. core: the
    word up to its closing quote, or without closing punctuation, and without the name it is assigned to;
    before: up to three words in front."""
    path = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    likely = docs.where("doc_id IS NOT NULL").where(F.col("text").rlike("[0-9]") | F.col("text").rlike(TELLING))
    words = likely.select("doc_id", path.alias("path"), words_of(F.col("text")).alias("words"))
    front = lambda i: F.filter(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.get("words", i - k)), lambda w: w.isNotNull())
    # behind an assignment (a word that ends in one) or with one inside, any length
    picked = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
                      lambda x: ((F.length(x["w"]) >= MIN_LENGTH) & x["w"].rlike("[0-9]")) | x["w"].rlike("[=:].") |
                      F.coalesce(F.get("words", x["i"] - 1), F.lit("")).rlike("[=:>]$"))
    found = words.select("doc_id", "path", "words", F.explode(picked).alias("x"))
    name = F.regexp_extract("x.w", rf"^[\"']?({NAME})[\"']?[=:]+(?=.)", 1)
    lead = rf"^(?:[\"']?{NAME}[\"']?[=:]+)?"
    core = F.regexp_extract("x.w", lead + r"[\"'(\[{<]*(.*?)[\"')\]}>.,;:!?]*$", 1)
    # what is quoted ends where the quote does, whatever follows
    for quote in "\"'":
        quoted = F.regexp_extract("x.w", lead + rf"[(\[{{<]*{quote}([^{quote}]+){quote}", 1)
        core = F.when(quoted != "", quoted).otherwise(core)
    rows = found.select("doc_id", "path", F.col("x.i").alias("word_no"), name.alias("name"), core.alias("core"), front(F.col("x.i")).alias("before"))
    mixed = (F.length("core") >= MIN_LENGTH) & F.col("core").rlike("[0-9]") & F.col("core").rlike(r"\p{L}")
    told = F.col("name").rlike(TELLING) | assigned_before(F.col("before"))
    return rows.where(mixed | told & F.col("core").rlike(r"[\p{L}\p{Nd}]"))


def dictionary(docs: DataFrame) -> DataFrame:
    """(run): the corpus's frequent lower-case words of a-z with at least four letters,
    counted over all documents."""
    words = docs.select(F.explode(words_of(F.col("text"))).alias("run")).where(F.col("run").rlike("^[a-z]{4,}$"))
    counts = written(words.groupBy("run").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") * DICTIONARY_PART >= F.lit(total)).select("run")


def share(pattern: str, core: Column) -> Column:
    return F.regexp_count(core, F.lit(pattern)) / F.length(core)


def transitions(core: Column) -> Column:
    """Share of neighbouring characters of different kinds: a letter case, digit, other."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, r"\p{Ll}", "a"), r"\p{Lu}", "A"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    return (runs - 1) / F.greatest(F.length(core) - 1, F.lit(1))


def transition_bits(known_words: DataFrame) -> list[float]:
    """Bits of each letter behind each other one, by the dictionary's words; a table of the
    size of LETTERS squared, whatever the corpus."""
    pairs = known_words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring("run", i, F.lit(2)))).alias("pair"))
    counts = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    behind = {a: sum(n for p, n in counts.items() if p[0] == a) for a in LETTERS}
    return [-math.log2((counts.get(a + b, 0) + 1) / (behind[a] + len(LETTERS))) for a in LETTERS for b in LETTERS]


def bigram_bits(core: Column, bits: list[float]) -> Column:
    """Mean bits of the transitions between neighbouring characters."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(core), "[0-9]", "0"), "[^a-z0]", ".")
    at = lambda i: F.instr(F.lit(LETTERS), F.substring(folded, i, F.lit(1))) - 1
    table = F.array(*[F.lit(b) for b in bits])
    steps = F.when(F.length(core) > 1, F.sequence(F.lit(1), F.length(core) - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(table, at(i) * len(LETTERS) + at(i + 1)), F.lit(0.0)))
    return total / F.greatest(F.length(core) - 1, F.lit(1))


def featured(found: DataFrame, known_words: DataFrame) -> DataFrame:
    """found with `kind` and the FEATURES."""
    bits = transition_bits(known_words)
    runs = found.select("doc_id", "word_no", "core", F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("core"), F.lit("([a-z]{4,})"), 1))).alias("run"))
    hit = F.broadcast(known_words.withColumn("hit", F.lit(True)))
    covered = runs.join(hit, "run", "left").groupBy("doc_id", "word_no", "core").agg(F.sum(F.when(F.col("hit"), F.length("run")).otherwise(0)).alias("_covered"))
    rows = found.join(covered, ["doc_id", "word_no", "core"])
    core, near = F.col("core"), F.array_join("before", " ")
    kind = F.lit(None).cast("string")
    for name, pattern in KNOWN.items():
        kind = F.coalesce(F.when(core.rlike(pattern), name), kind)
    assigned = F.col("name").rlike(TELLING) | assigned_before(F.col("before"))
    address = core.rlike(r"@|^(https?|ftp)://|^www\.|^\d+(\.\d+){3}$|\.(com|org|net|edu|gov|io)\b")
    flags = {
        "f_length": F.least(F.length(core), F.lit(200)), "f_transitions": transitions(core), "f_bigrams": bigram_bits(core, bits), "f_digits": share("[0-9]", core), "f_upper": share(r"\p{Lu}", core),
        "f_hex": core.rlike("^([0-9a-f]{8,}|[0-9A-F]{8,})$"), "f_dictionary": F.col("_covered") / F.length(core), "f_assigned": assigned, "f_known": kind.isNotNull(),
        "f_harmless": core.rlike(HARMLESS), "f_address": address, "f_path_harmless": F.coalesce(F.col("path").rlike(HARMLESS), F.lit(False)),
        "f_neighbour_telling": near.rlike(TELLING), "f_neighbour_harmless": near.rlike(HARMLESS),
        "f_distinct": F.size(F.array_distinct(F.split(core, ""))) / F.length(core)}
    return rows.withColumn("kind", F.coalesce(kind, F.when(assigned, "assigned"), F.lit("generic"))).select(
        "*", *[F.col(c).cast("double").alias(c) if isinstance(c, str) and c in rows.columns else flags[c].cast("double").alias(c) for c in FEATURES]).drop("_covered")


def examples(spark, known_words: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """(doc_id, text, source, label) of n made examples, half of them secrets. A secret's form
    and setting are drawn apart from each other, and so are those of a mistake: both come
    assigned and unassigned, quoted and bare, in source code, notes and tests."""
    words = [r.run for r in known_words.orderBy("run").limit(200).collect()] or ["some", "plain", "words", "here"]
    rows = spark.range(n).withColumn("label", (F.col("id") % 2).cast("double"))
    draw = lambda name, k: F.pmod(F.xxhash64("id", F.lit(name), F.lit(SEED)), F.lit(k)).cast("int")
    pick = lambda name, some: F.get(F.array(*[F.lit(x) for x in some]), draw(name, len(some)))
    word = lambda name: pick(name, words)
    hexes = F.sha2(F.concat(F.col("id").cast("string"), F.lit("s")), 256)
    letters = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit("b")), 512))), "[^A-Za-z0-9]", "")
    upper = F.upper(F.translate(letters, "0189", "ABCD"))
    secret = F.get(F.array(
        F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), F.substring(letters, 1, 24), F.substring(letters, 1, 40), F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.concat(F.lit("ghp_"), F.substring(letters, 1, 36)),
        F.concat(F.lit("sk_live_"), F.substring(letters, 1, 24)), F.concat(word("p1"), F.substring(letters, 1, 2), draw("p2", 1000).cast("string")), F.concat(word("p3"), word("p4")), F.substring(letters, 1, 10)), draw("form", 10))
    mistake = F.get(F.array(
        F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), F.concat(F.lit("v"), draw("a", 9).cast("string"), F.lit("."), draw("b", 99).cast("string"), F.lit("."), draw("c", 999).cast("string")),
        F.concat(word("f1"), F.lit("_"), draw("d", 999).cast("string"), F.lit(".py")), F.concat(word("m1"), F.lit("."), word("m2"), draw("e", 99).cast("string"), F.lit("@mail.example.com")), F.concat(F.lit("https://www."), word("u1"), F.lit(".org/"), draw("g", 9999).cast("string")),
        F.concat(F.lit("your_"), word("y1"), F.lit("_1234")), F.concat(word("w1"), draw("h", 99).cast("string"), word("w2")), F.concat(F.lit("20"), F.lpad(draw("i", 99).cast("string"), 2, "0"), F.lit("-01-12T10:11:"), draw("j", 60).cast("string"), F.lit("Z")),
        F.concat(word("x1"), F.lit("-"), word("x2"), F.lit("-"), draw("k", 9999).cast("string")), F.concat(F.lit("xxxxxxxx"), draw("l", 9999).cast("string")), F.concat(F.lit("10."), draw("m", 255).cast("string"), F.lit("."), draw("n", 255).cast("string"), F.lit(".7"))), draw("form", 11))
    told = pick("t", ["token", "password", "api_key", "secret", "access_key"])
    untold = pick("u", ["commit", "file", "version", "id", "note", "see", "build"])
    # issued forms stand anywhere, others behind a telling name; mistakes behind any name
    free = (F.col("label") == 1) & ~draw("form", 10).isin(4, 5, 6)
    name = F.when(free | (draw("n?", 3) == 0), told).otherwise(untold)
    sign = F.when(free, pick("s", [" = ", ": ", "="])).otherwise(pick("s", [" = ", ": ", "=", " "]))
    quote = pick("q", ["", '"', "'"])
    value = F.when(F.col("label") == 1, secret).otherwise(mistake)
    text = F.concat_ws(" ", word("l1"), word("l2"), F.concat(name, sign, quote, value, quote), word("r1"), word("r2"))
    return rows.select(F.col("id").alias("doc_id"), text.alias("text"), pick("src", ["app", "docs", "web"]).alias("source"), "label")


def made_labels(spark, known_words: DataFrame) -> DataFrame:
    """Featured candidates of the examples with their labels."""
    made = examples(spark, known_words)
    found = written(featured(candidates(made).dropDuplicates(["doc_id", "word_no", "core"]), known_words))
    return found.join(made.select("doc_id", "label"), "doc_id")


def trained(labelled: DataFrame):
    """Forest fitted on at most MAX_TRAINING labelled rows (FEATURES, label); None if
    they don't have both labels."""
    few = written(labelled.select(*FEATURES, "label", F.xxhash64("doc_id", "word_no", "core").alias("_order")).orderBy("_order", *FEATURES).limit(MAX_TRAINING))
    if few.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(few.drop("_order"))


def secrets(docs: DataFrame, labelled=None) -> DataFrame:
    """(doc_id, word_no, kind, length, sha256, score, is_secret) of every candidate; the
    secret itself is not repeated, only its digest.

    labelled: function from featured candidates to those with a 0/1 `label`; default: the
    labels of made examples, see made_labels. Defined cases: null texts and ids have no candidates; rows that share
    a doc_id give a candidate each, equal ones once; a missing source is an empty path;
    where the caller's labels are all alike or missing, issued formats and what is assigned
    to a telling name count as secrets; other columns are not read, whatever their names; an
    empty table gives no rows.
    """
    columns = ["doc_id", "text", *(["source"] if "source" in docs.columns else [])]
    docs = docs.select(*columns)
    found = written(candidates(docs).dropDuplicates(["doc_id", "word_no", "core"]))
    known_words = written(dictionary(docs))
    rows = written(featured(found, known_words))
    model = trained(labelled(rows) if labelled else made_labels(docs.sparkSession, known_words))
    if model is None:
        scored = rows.withColumn("score", ((F.col("f_known") == 1) | ((F.col("f_assigned") == 1) & (F.col("f_harmless") == 0))).cast("double"))
    else:
        scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "word_no", "kind", F.length("core").alias("length"), F.sha2("core", 256).alias("sha256"), F.round("score", 6).alias("score"),
                         (F.col("score") >= THRESHOLD).alias("is_secret"))


def op9_secret_forest(spark, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))
