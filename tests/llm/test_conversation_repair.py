from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from bookloom.llm import conversation_repair as c

SCHEMA = "conv_id long, turn long, role string, text string, part string, seq string, cost string"


@pytest.fixture(autouse=True)
def dealt(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_path(items):
    """Cheapest (cost, audit) by search over all edit strings, cheapest first."""
    heap = [(0, "", 0, "")]  # cost, audit, rows used, roles so far
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(items) and (roles == "" or roles.lstrip("s").replace("ua", "") == "" and roles.count("s") <= 1 and roles.find("s") <= 0 and roles != "s"):
            return cost, audit
        fits = lambda r: (roles == "" and r in "su") or (roles[-1:] == "s" and r == "u") or (roles[-1:] == "u" and r == "a") or (roles[-1:] == "a" and r == "u")
        if len(audit) < 2 * len(items) + 3:
            for r in "ua":
                if fits(r):
                    heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r))
        if i < len(items):
            initial, goes, truncated = items[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if not goes:
                more = 3 * truncated
                if initial and initial in "sua" and fits(initial):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + initial))
                for r in "ua":
                    if fits(r):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + r))


def test_paths_of_all_short_conversations():
    kinds = [(r, g, t) for r in ("s", "u", "a", "t") for g, t in ((False, False), (False, True))] + [("u", True, False), ("", False, False)]
    for n in range(4):
        for items in itertools.product(kinds, repeat=n):
            assert c.whole_path(list(items)) == brute_path(items), items


def test_paths_of_longer_conversations():
    r = random.Random(1)
    for _ in range(60):
        items = [(r.choice("suuaaat"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(4, 9))]
        assert c.whole_path(items) == brute_path(items)


def test_pieces_chain_to_the_whole():
    r = random.Random(2)
    for _ in range(300):
        items = [(r.choice("suuaat"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(0, 30))]
        pieces, i = [], 0
        while i < len(items) or not pieces:
            n = r.randrange(0, 7)
            pieces.append(items[i:i + n])
            i += n
        paths = [c.piece_paths(p) for p in pieces]
        ranked = [[p and (p[0], sorted(x[1] for x in of[4 * (i // 4):4 * (i // 4) + 4] if x).index(p[1])) for i, p in enumerate(of)] for of in paths]
        cost, ways, closing = c.chain(ranked)
        audit = "".join(of[4 * a + b][1] for of, (a, b) in zip(paths, ways, strict=True)) + closing
        assert (cost, audit) == c.whole_path(items)


def brute(rows):
    by, order = {}, lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = by.setdefault(conv, [])
        text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    out = {}
    for conv, mine in by.items():
        mine.sort(key=order)
        seen, items, faults = set(), [], []
        for _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            items.append((role[:1], faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        cost, audit = brute_path(items) if len(items) < 9 else c.whole_path(items)
        turns = [t for t, _, _ in mine if t is not None]
        said, roles, at = [], "", iter(mine)
        for letter in audit:
            nxt = "assistant" if roles[-1:] == "u" else "user"
            if letter == "I":
                said.append(f"{nxt}:")
                roles += nxt[0]
                continue
            _, role, text = next(at)
            if letter != "D":
                role = role if letter == "K" else nxt
                said.append(f"{role}:{text}")
                roles += role[0]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def turns():
    r = random.Random(7)
    texts = ["Yes.", "No", "  ", "", None, "Why?", "Well!\n", "é — ok.", "a" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", ""]
    rows = []
    for conv in [*range(60), None]:
        rows += [(conv, t, r.choice(roles[:5]) if r.random() < 0.9 else r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"text {conv} {t}.") for t in range(r.randrange(1, 9))]
    rows += [(70, None, "user", "x."), (70, None, "user", "x."), (70, 3, None, None), (70, 3, "assistant", "b."), (70, 3, "assistant", "a."), (70, 90, "user", "Yes.")]
    # a conversation with a third of all rows, with rows of one turn, of none and seen long before
    rows += [(80, t // 2 if t > 20 else None if t > 9 else 5, r.choice(roles), r.choice(texts) if t % 3 else f"w {t}.") for t in range(170)]
    rows += rows[:9]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece_rows", [1024, 7])
def test_against_brute_force(spark, turns, piece_rows):
    df = spark.createDataFrame([(*x, "p", "s", "c") for x in turns], SCHEMA).repartition(3)
    got = {x.conv_id: tuple(x)[1:] for x in c.digests(c.repaired(c.damaged(df), piece_rows)).collect()}
    assert got == brute(turns)


def test_one_row_repeated(spark):
    """All rows alike: no order, no key tells them apart, and still no task gets all."""
    df = spark.createDataFrame([(1, 1, "user", "a.", "p", "s", "c")] * 40, SCHEMA).repartition(4)
    got = c.digests(c.repaired(df, 5)).collect()
    assert len(got) == 1 and got[0].cost == 39 * 4 + 3 and got[0].duplicate == 39 and got[0].audit == "K" + "D" * 39 + "I"


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert c.digests(c.repaired(c.damaged(df))).count() == 0
    # a conversation whose rows are all dropped still comes back
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = c.digests(c.repaired(c.damaged(spark.createDataFrame([(gone, 0, "user", "a.", "p", "s", "c")], SCHEMA)))).collect()
    assert [tuple(x) for x in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
