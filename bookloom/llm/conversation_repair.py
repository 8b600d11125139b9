"""Repair of conversation structure: the cheapest edits that leave `(s?(ua)+)?`.

An edit path is one integer. Its high digits are the cost, its low digits the letters of
the audit, octal, first letter highest, padded with zeros at the end to a fixed width. The
smaller integer is the cheaper path and, of equally cheap ones, the one whose audit is
least by ASCII, so the minimum over the edges of an acyclic graph (rows times four states
of the grammar) decides everything. The minimum runs from the end, where a letter goes in
front and equal-width digits stay comparable.

A conversation may hold any part of all rows. Rows are range-partitioned by conversation
and order, so a long conversation lies in several tasks, and a task reads its rows as a
stream: a conversation that begins and ends inside it is repaired at once, any other is
cut into pieces of at most PIECE_ROWS rows. Of a piece only the cheapest path from each
state to each state counts (audits of a piece never begin one another, for all end in a
row's letter, so what follows cannot change which is less). Costs and ranks of those 16
paths are chained per conversation, then every piece carries out its own path.

Defined results: rows are ordered by turn (nulls first), role, text. Null roles and texts
are one space; a null conv_id is a conversation of its own. Rows that are dropped still
name their conversation; an empty table gives no rows. Texts are read whole. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.shared import WHITE, read, written
from bookloom.runtime import ship

#: Rows, and characters, after which a piece ends.
PIECE_ROWS, PIECE_CHARS = 1024, 4 << 20
#: Conversations and characters in an Arrow batch that a task gives out.
BATCH_ROWS, BATCH_CHARS = 2000, 4 << 20
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
#: Letters as octal digits in ASCII order; 0 is the padding.
LETTERS = "\0DIKR"
D, I, K, R = (LETTERS.index(x) for x in "DIKR")
STATES = range(4)
#: States: nothing yet, behind s, behind u, behind a. The role that may come next, and the
#: state behind it.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Letters that end a conversation in each state.
CLOSING = ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}


# ------------------------------------------------------------------ one piece

def weight(cost: int, audit: str, width: int) -> int:
    number = 0
    for letter in audit:
        number = number << 3 | LETTERS.index(letter)
    return cost << 3 * width | number << 3 * (width - len(audit))


def unpacked(value: int, width: int) -> tuple[int, str]:
    digits = oct(value & (1 << 3 * width) - 1)[2:].zfill(width)
    return value >> 3 * width, digits.rstrip("0").translate({ord(str(i)): x for i, x in enumerate(LETTERS)})


def cheapest(items: list, ends: list, width: int) -> list:
    """Weight of the cheapest path from each state to the end. items: (initial, whether it
    must go, whether it is truncated) of each row; ends: weights behind the last row, None
    where a path may not end."""
    low = 3 * width
    mask = (1 << low) - 1

    def before(cost: int, letter: int, rest: int | None):
        if rest is None:
            return None
        return ((rest >> low) + cost << low) | letter << low - 3 | (rest & mask) >> 3

    def least(*found):
        return min((x for x in found if x is not None), default=None)

    now = ends
    for initial, goes, truncated in reversed(items):
        row = [before(COST["D"], D, now[q]) for q in STATES]
        if not goes:
            more = TRUNCATED_COST if truncated else 0
            keep = KEEP.get(initial)
            row = [least(row[q], before(COST["R"] + more, R, now[NEXT[q]]),
                         before(COST["K"] + more, K, now[keep[q]]) if keep and keep[q] is not None else None) for q in STATES]
        one = [least(row[q], before(COST["I"], I, row[NEXT[q]])) for q in STATES]
        now = [least(row[q], before(COST["I"], I, one[NEXT[q]])) for q in STATES]
    return now


def whole_path(items: list) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    width = 3 * len(items) + 2
    ends = [weight(COST["I"] * len(x), x, width) for x in CLOSING]
    return unpacked(cheapest(items, ends, width)[0], width)


def piece_paths(items: list) -> list:
    """[(cost, audit) or None] of the 16 cheapest paths from state to state, by 4*from+to."""
    width = 3 * len(items) + 1
    by_end = [cheapest(items, [0 if q == end else None for q in STATES], width) for end in STATES]
    return [None if by_end[end][q] is None else unpacked(by_end[end][q], width) for q in STATES for end in STATES]


def key_of(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def judged(rows: list, late=frozenset()) -> tuple[list, dict]:
    """Items for the paths and counts of a piece. rows: (turn, role, text) in order; late:
    keys of rows seen in an earlier piece."""
    seen, items, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    turns, previous = [], None
    for turn, role, text in rows:
        body = text.rstrip(WHITE)
        again = (role, text) in seen or (bool(late) and key_of(role, text) in late)
        seen.add((role, text))
        fault = "blank" if not body else "duplicate" if again else "truncated" if body[-1] not in ".!?" else None
        if fault:
            counts[fault] += 1
        items.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        if previous is not None and previous + role[:1] not in LEGAL:
            counts["illegal"] += 1
        previous = role[:1]
        if turn is not None and (not turns or turns[-1] != turn):
            turns.append(turn)
    counts |= {"first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "n_turns": len(turns),
               "first_initial": rows[0][1][:1] if rows else None, "last_initial": previous}
    return items, counts


def carried_out(rows: list, audit: str, state: int) -> list:
    """(role, text) of a piece after the edits of its audit, entered in a state."""
    out, at = [], iter(rows)
    for letter in audit:
        if letter == "I":
            out.append((NEXT_ROLE[state], ""))
            state = NEXT[state]
            continue
        _, role, text = next(at)
        if letter == "K":
            out.append((role, text))
            state = KEEP[role[:1]][state]
        elif letter == "R":
            out.append((NEXT_ROLE[state], text))
            state = NEXT[state]
    return out


def chain(pieces: list) -> tuple[int, list, str]:
    """(cost, [(from, to)] of each piece, closing letters) for the pieces of one
    conversation in order: lists of 16 (cost, rank) or None, the rank being that of the
    path's audit among those from the same state."""
    after = [(COST["I"] * len(x), None) for x in CLOSING]
    choices = []
    for paths in reversed(pieces):
        now = []
        for q in STATES:
            found = [(paths[4 * q + r][0] + after[r][0], paths[4 * q + r][1], r) for r in STATES if paths[4 * q + r] is not None and after[r] is not None]
            now.append((min(found)[0], min(found)[2]) if found else None)
        choices.append(now)
        after = now
    total, state, ways = after[0][0], 0, []
    for now in reversed(choices):
        ways.append((state, now[state][1]))
        state = now[state][1]
    return total, ways, CLOSING[state]


# ------------------------------------------------------------------ the cluster's part

_PAIR = pa.struct([("role", pa.string()), ("text", pa.string())])
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_CUT = {"conv_id": pa.int64(), "part": pa.int32(), "seq": pa.int64(), "whole": pa.bool_(), **dict.fromkeys(COUNTS, pa.int64()),
        "audit": pa.string(), "turns": pa.list_(_PAIR), "rows": pa.list_(_ROW)}
_CUT_DDL = ("conv_id long, part int, seq long, whole boolean, " + ", ".join(f"{c} long" for c in COUNTS)
            + ", audit string, turns array<struct<role: string, text: string>>, rows array<struct<turn: long, role: string, text: string>>")


def batches_of(found, kinds: dict):
    """Arrow batches of bounded size from (characters, row) pairs."""
    rows, size = [], 0
    schema = pa.schema(list(kinds.items()))
    for chars, row in found:
        rows.append(row)
        size += chars
        if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _listed(batch):
    """Rows of a batch as dicts, a bounded number at a time."""
    for i in range(0, batch.num_rows, 256):
        yield from batch.slice(i, 256).to_pylist()


def gaps_of(first, last, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def repaired_whole(rows: list) -> dict:
    items, counts = judged(rows)
    cost, audit = whole_path(items)
    turns = carried_out(rows, audit, 0)
    return {"gaps": gaps_of(counts["first_turn"], counts["last_turn"], counts["n_turns"]), **{c: counts[c] for c in COUNTS[1:5]}, "cost": cost, "audit": audit,
            "turns": [{"role": r, "text": t} for r, t in turns]}


def cutter(piece_rows: int, piece_chars: int):
    """A function over the sorted rows of a task: conversations that lie inside the task
    whole, repaired; pieces of all others."""
    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def pieces():
            seq, conv, rows, chars = 0, None, [], 0
            begun, open_ = False, True  # a task's first conversation may have begun before it

            def flushed():
                nonlocal seq, rows, chars
                if open_:
                    out = {"whole": False, "rows": [{"turn": t, "role": r, "text": x} for t, r, x in rows]}
                else:
                    out = {"whole": True, **repaired_whole(rows)}
                found = chars + 1, {"conv_id": conv, "part": part, "seq": seq, **out}
                seq, rows, chars = seq + 1, [], 0
                return found

            for batch in batches:
                for r in _listed(batch):
                    if begun and r["conv_id"] != conv:
                        yield flushed()
                        open_ = False
                    begun, conv = True, r["conv_id"]
                    if len(rows) >= piece_rows or chars >= piece_chars:
                        open_ = True
                        yield flushed()
                    if not r["gone"]:
                        rows.append((r["turn"], r["role"], r["text"]))
                        chars += len(r["role"]) + len(r["text"])
            if begun:
                open_ = True  # it may go on in the next task
                yield flushed()

        yield from batches_of(pieces(), _CUT)

    return cut


_SUMMARY = {"conv_id": pa.int64(), "part": pa.int32(), "seq": pa.int64(), **dict.fromkeys(COUNTS[1:5], pa.int64()), "first_turn": pa.int64(), "last_turn": pa.int64(),
            "n_turns": pa.int64(), "first_initial": pa.string(), "last_initial": pa.string(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32()), "audits": pa.list_(pa.string())}
_SUMMARY_DDL = ("conv_id long, part int, seq long, " + ", ".join(f"{c} long" for c in COUNTS[1:5])
                + ", first_turn long, last_turn long, n_turns long, first_initial string, last_initial string, costs array<long>, ranks array<int>, audits array<string>")


def summed(batches):
    """Counts and the 16 paths of each piece."""
    def found():
        for batch in batches:
            for r in _listed(batch):
                items, counts = judged([(x["turn"], x["role"], x["text"]) for x in r["rows"]], frozenset(r["late"] or ()))
                paths = piece_paths(items)
                ranks = [None] * 16
                for q in STATES:
                    for rank, i in enumerate(sorted((i for i in range(4 * q, 4 * q + 4) if paths[i]), key=lambda i: paths[i][1])):
                        ranks[i] = rank
                yield 16 * len(items), {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], **counts, "costs": [p and p[0] for p in paths], "ranks": ranks,
                                        "audits": [p and p[1] for p in paths]}

    yield from batches_of(found(), _SUMMARY)


_WAY_DDL = "conv_id long, part int, seq long, " + ", ".join(f"{c} long" for c in COUNTS) + ", enters int, leaves int, closing string"


def ways(table: pa.Table) -> pa.Table:
    """The path of each piece and the counts of the whole for one conversation, whose rows
    hold 32 numbers for every PIECE_ROWS of the conversation's."""
    pieces = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    total, chosen, closing = chain([[None if c is None else (c, k) for c, k in zip(p["costs"], p["ranks"], strict=True)] for p in pieces])
    counts = {c: sum(p[c] for p in pieces) for c in COUNTS[1:5]}
    distinct, first, last, initial = 0, None, None, None
    for p in pieces:
        if initial is not None and p["first_initial"] is not None and initial + p["first_initial"] not in LEGAL:
            counts["illegal"] += 1
        initial = initial if p["last_initial"] is None else p["last_initial"]
        if p["first_turn"] is not None:
            distinct += p["n_turns"] - (last == p["first_turn"])
            first, last = p["first_turn"] if first is None else first, p["last_turn"]
    names = ["conv_id", "part", "seq", *COUNTS, "enters", "leaves", "closing"]
    out = [{"conv_id": p["conv_id"], "part": p["part"], "seq": p["seq"], **counts, "gaps": gaps_of(first, last, distinct), "cost": total, "enters": a, "leaves": b,
            "closing": closing if i + 1 == len(pieces) else ""} for i, (p, (a, b)) in enumerate(zip(pieces, chosen, strict=True))]
    kinds = {"conv_id": pa.int64(), "part": pa.int32(), "enters": pa.int32(), "leaves": pa.int32(), "closing": pa.string()}
    return pa.Table.from_pylist(out, pa.schema([(n, kinds.get(n, pa.int64())) for n in names]))


_DONE = {k: v for k, v in _CUT.items() if k != "rows"}
_DONE_DDL = _CUT_DDL.split(", rows array")[0]


def carried(batches):
    def found():
        for batch in batches:
            for r in _listed(batch):
                rows, audit = [(x["turn"], x["role"], x["text"]) for x in r["rows"]], r["path"] + r["closing"]
                turns = [{"role": a, "text": b} for a, b in carried_out(rows, audit, r["enters"])]
                yield sum(len(x["text"]) for x in turns) + 1, {k: r[k] for k in ("conv_id", "part", "seq", *COUNTS)} | {"whole": False, "audit": audit, "turns": turns}

    yield from batches_of(found(), _DONE)


def repaired(turns: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The repaired conversations, in pieces: conv_id, part and seq (their order), whole
    (the conversation is this one piece), gaps, blank, duplicate, truncated, illegal, cost
    (of the conversation), audit and turns (role, text) of the piece.

    turns: conv_id, turn, role, text and, where rows may be only named, gone."""
    ship(turns.sparkSession)
    gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), gone.alias("gone"))
    # the last two keys only deal out rows that agree in the others; sorting ignores them
    rows = rows.withColumns({"_begin": F.substring("text", 1, 64), "_at": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "_begin", "_at").drop("_begin", "_at").sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = written(ordered.mapInArrow(cutter(piece_rows, piece_chars), _CUT_DDL))
    whole, pieces = parts.where("whole").drop("rows"), parts.where("NOT whole").select("conv_id", "part", "seq", "rows")

    at = F.struct("part", "seq")
    keys = pieces.select("conv_id", "part", "seq", F.explode(F.array_distinct(F.transform(
        "rows", lambda r: F.sha2(F.concat(F.length(r.role).cast("string"), F.lit(":"), r.role, r.text), 256)))).alias("key"))
    first = keys.groupBy("conv_id", "key").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "first")
    late = keys.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key"))).where(at > F.col("first"))
    late = late.groupBy(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("seq").alias("_seq")).agg(F.collect_set("key").alias("late"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))
    sums = written(pieces.join(late, same, "left").select("conv_id", "part", "seq", "rows", "late").mapInArrow(summed, _SUMMARY_DDL))
    chosen = sums.drop("audits").groupBy("conv_id").applyInArrow(ways, _WAY_DDL)

    paths = sums.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("seq").alias("_seq"), "audits")
    told = chosen.join(paths, same).withColumn("path", F.expr("element_at(audits, 4 * enters + leaves + 1)")).drop("audits", "_conv", "_part", "_seq")
    named = told.withColumnsRenamed({"conv_id": "_conv", "part": "_part", "seq": "_seq"})
    done = pieces.join(named, same).drop("_conv", "_part", "_seq").mapInArrow(carried, _DONE_DDL)
    return whole.unionByName(done)


RESULT = ("conv_id", *COUNTS, "audit", "repaired_sha256")


def digested(batches):
    """One row a conversation from its pieces in order, hashed as they come."""
    kinds = {"conv_id": pa.int64(), **dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}

    def found():
        now, audit, digest, begun = None, [], None, False

        def over():
            return len("".join(audit)), {k: now[k] for k in ("conv_id", *COUNTS)} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            for r in _listed(batch):
                if now is None or r["conv_id"] != now["conv_id"]:
                    if now is not None:
                        yield over()
                    now, audit, digest, begun = r, [], hashlib.sha256(), False
                audit.append(r["audit"])
                if r["n"]:
                    digest.update(("\n" * begun + r["said"]).encode())
                    begun = True
        if now is not None:
            yield over()

    yield from batches_of(found(), kinds)


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation: counts, cost, audit and the hash of its `role:text` lines."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n").alias("said")
    rows = pieces.select("conv_id", "part", "seq", "whole", *COUNTS, "audit", F.size("turns").alias("n"), said)
    whole = rows.where("whole").withColumn("repaired_sha256", F.sha2("said", 256)).select(*RESULT)
    # a hash is one chain over its text, so the pieces of a conversation meet in order in one task, as a stream
    ordered = rows.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    ddl = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return whole.unionByName(ordered.mapInArrow(digested, ddl))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of turns damaged by crc32(conv_id:turn) % 20; rows that are dropped are only
    named, with gone set."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                        (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("h"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       (F.col("h") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op13_conversation_repair(spark, sf_dir) -> DataFrame:
    return digests(repaired(damaged(read(spark, sf_dir, "conversations"))))
