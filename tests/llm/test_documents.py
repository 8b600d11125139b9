"""SimHash groups, repeated passages, quality rules and scores against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from bookloom.llm import context_tree, quality_cascade, simhash_documents, sparse_suffix
from bookloom.llm.shared import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    w = WORD.findall((text or "").lower())
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(9)] + [(20, 21), (21, 20), (30, 30), (41, 40), (42, 40)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = roots({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n != 30}


def test_simhash_groups(docs, rows, no_docs):
    prints = [(i, brute_fingerprint(t)) for i, t in rows if i is not None]
    edges = [(a, b) for a, x in prints for b, y in prints if (x ^ y).bit_count() <= 3]
    want = roots({i for i, _ in prints}, edges)
    got = simhash_documents.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component) for r in got if r.doc_id is not None) == Counter((i, f, want[i]) for i, f in prints)
    assert [r.component for r in got if r.doc_id is None] == [None]
    kept = simhash_documents.kept(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}
    assert simhash_documents.near_duplicates(no_docs).count() == 0


def test_repeated_passages(docs, rows, no_docs):
    texts = defaultdict(list)
    for i, t in rows:
        if i is not None and t:
            texts[i].append(WORD.findall(t))
    seen = defaultdict(set)
    for i, many in texts.items():
        for w in many:
            for k in range(len(w) - 49):
                seen[tuple(w[k:k + 50])].add(i)
    want = set()
    for i, many in texts.items():
        starts = sorted({k for w in many for k in range(len(w) - 49) if len(seen[tuple(w[k:k + 50])]) > 1})
        span = None
        for k in starts:
            if span and k <= span[1] + 50:
                span[1] = k
            else:
                span and want.add((i, span[0], span[1] + 50 - span[0]))
                span = [k, k]
        span and want.add((i, span[0], span[1] + 50 - span[0]))
    got = sparse_suffix.repeated_passages(docs).collect()
    assert {(r.doc_id, r.start_word, r.n_words) for r in got} == want and len(got) == len(want)
    assert all(r.other_doc_id != r.doc_id and r.first_doc_id <= r.doc_id for r in got)
    assert sparse_suffix.repeated_passages(no_docs).count() == 0


def brute_quality(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, rows, no_docs):
    extra = [(900, "a b c " * 40), (901, "x\nx\n\n \nx y z"), (902, "a a a a a a"), (903, "p q r s p q r t q r s"), (904, "&&& word\t|\n" * 60), (905, "日本 語 " * 3),
             (906, "\n".join(f"- point number{i} of many words{i}" for i in range(20))), (907, "\n".join(f"so it{i} went on and{i} on ..." for i in range(20)))]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = Counter((r.doc_id, r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words, r._base_failed) for r in quality_cascade.judged(more).collect())
    want = Counter()
    for i, t in [*rows, *extra]:
        n, c, s, d, p = brute_quality(t)
        want[i, n, c, s, d, p, n < 50 or 100 * p > 50 * n] += 1
    assert got == want
    reasons = {r.doc_id: r._reason for r in quality_cascade.judged(more).collect()}
    assert reasons[906] == "bullet_lines" and reasons[907] == "unfinished_lines" and reasons[305] is None and reasons[301] == "base"
    assert quality_cascade.kept(docs).columns == docs.columns
    assert quality_cascade.judged(no_docs).count() == 0


def test_rule_order(docs):
    """Rejection per cost, each rule on what those before it let through."""
    of = lambda *names: frozenset(names)
    rejected = [(of("a", "b"), 50), (of("b"), 10), (of("c"), 20), (of("d"), 20), (of(), 100)]
    assert quality_cascade.by_rejection_per_cost(rejected, {"a": 1.0, "b": 4.0, "c": 1.0, "d": 1.0, "e": 0.1}) == ["a", "c", "d", "b", "e"]
    rules = quality_cascade.more_rules()
    assert {r.name for r in quality_cascade.measured_order(docs, rules)} == {r.name for r in rules}


def test_rule_costs(spark):
    """A rule that works on the text costs more than one that compares numbers."""
    sample = quality_cascade.base_columns(spark.createDataFrame([("some words - here " * 2000,)] * 40, "text string")).cache()
    rules = [r for r in quality_cascade.more_rules() if r.name in ("long_words", "words_without_letters")]
    costs = quality_cascade.measured_costs(sample, rules)
    assert costs["words_without_letters"] > 5 * costs["long_words"] >= 0


def test_quality_takes_any_names(spark):
    rows = spark.createDataFrame([(1, "word " * 3, 5, True, "r"), (2, " ".join(f"w{i}rd" for i in range(80)), 6, False, "s")], "doc_id long, text string, _n_words long, _kept boolean, row string")
    kept = quality_cascade.kept(rows)
    assert kept.columns == rows.columns and [tuple(r)[2:] for r in kept.collect()] == [(6, False, "s")]
    with pytest.raises(ValueError, match="_n_words"):
        quality_cascade.judged(rows)


def brute_scores(rows, depth):
    train = [(i, t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    node = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def symbols(t):
        b = b"\0" * depth + (t or "").encode().lower() + b"\0"
        return [(b[i - depth:i], b[i]) for i in range(depth, len(b))]

    def places(x):
        return [((1 << i) | (x >> (8 - i)), x >> (7 - i) & 1) for i in range(8)]

    for _, t in train:
        for c, x in symbols(t):
            for j, bit in places(x):
                for k in range(depth + 1):
                    node[c[depth - k:], j][bit] += 1
    for _, t in rows:
        for c, x in symbols(t):
            for j, _ in places(x):
                for k in range(depth):
                    children[c[depth - k:], j].add((c[depth - k - 1:], j))

    def own(n):
        a, b = node[n]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}

    def log_w(n):
        if n not in weighted:
            o = own(n)
            if len(n[0]) == depth:
                weighted[n] = o
            else:
                c = sum(map(log_w, children[n]))
                weighted[n] = max(o, c) + math.log1p(math.exp(-abs(o - c))) - math.log(2)
        return weighted[n]

    def predict(c, j, k=0):
        n = (c[depth - k:], j)
        a, b = node[n]
        p = (b + .5) / (a + b + 1)
        if k == depth:
            return p
        share = 1 / (1 + math.exp(min(700, sum(map(log_w, children[n])) - own(n))))
        return share * p + (1 - share) * predict(c, j, k + 1)

    words = Counter(w for _, t in train for w in WORD.findall((t or "").lower()))
    words[None] = len(train)
    total = sum(words.values()) + len(words) + 1
    out = []
    for i, t in rows:
        tokens = [*WORD.findall((t or "").lower()), None]
        score = 0.0
        for c, x in symbols(t):
            for j, bit in places(x):
                p = predict(c, j)
                score += math.log10(p if bit else 1 - p)
        out.append((i, len(tokens), sum(words[w] > 0 for w in tokens), sum(math.log10((words[w] + 1) / total) for w in tokens), score))
    return out, sum(words.values())


@pytest.mark.parametrize("depth", [context_tree.DEPTH, 2])
def test_scores(spark, no_docs, depth):
    """Chunks of a few texts, three buckets, a long text that is a chunk of its own, clashing columns."""
    rows = [(1, "abab abab Ab"), (2, "ba ab"), (3, ""), (4, None), (5, "xy ab"), (9, "zz\ttop é"), (9, "zz\ttop é"), (None, "ab"), (10, "ab xy zz " * 12)]
    want, tokens = brute_scores(rows, depth)
    frame = spark.createDataFrame([(*r, "c", "p") for r in rows], "doc_id long, text string, chunk string, payload string")
    got = context_tree.scored(frame, depth=depth, chunk_bytes=20, bucket_bytes=60).collect()
    by_id = lambda r: (str(r[0]), r[1], r[4])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=by_id)
    for a, b in zip(got, sorted(want, key=by_id), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 and abs(a[4] - b[4]) < 1e-6
    assert tokens == context_tree.scored(frame).first().train_tokens
    assert context_tree.scored(no_docs).count() == 0


def test_trees_in_parts(monkeypatch):
    """Trees weighted a few keys at a time are those weighted at once."""
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 48, 4000) & 0x0303030303FF)
    counts = r.integers(0, 5, len(keys))

    def tops():
        found = [tree.top for _, tree in context_tree.subtrees(keys, counts, 5)]
        return len(found), sorted(zip(*(np.concatenate(x).tolist() for x in zip(*found))))

    one, whole = tops()
    monkeypatch.setattr(context_tree, "TREE_KEYS", 100)
    many, parts = tops()
    assert one == 1 and many > 5 and whole == parts


def test_secrets_end_at_their_closing_quote(spark):
    from bookloom.llm import secret_forest

    texts = ['token = "24be64aa91ff0c3d5e7b"### next', "key='a1b2c3d4e5f6a7b8c9'; x", 'password: "q9w8e7r6t5y4u3"', "x" * 60 + '_api_key="9f8e7d6c5b4a39281706"']
    df = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {(x.doc_id, x.core) for x in secret_forest.candidates(df).collect()}
    assert {(0, "24be64aa91ff0c3d5e7b"), (1, "a1b2c3d4e5f6a7b8c9"), (2, "q9w8e7r6t5y4u3"), (3, "9f8e7d6c5b4a39281706")} <= got
    assert not [c for _, c in got if "#" in c or '"' in c]


def test_nothing_is_broadcast_by_estimate(spark, monkeypatch):
    """Only what a hint names is broadcast: files of 10 MB hold far more rows, and an explode makes more of them."""
    from bookloom.llm import shared

    plans, write = [], shared.written

    def told(df):
        run = df._jdf.queryExecution()
        plans.append((run.sparkPlan().toString().count("BroadcastHashJoin"), run.optimizedPlan().toString().count("strategy=broadcast")))
        return write(df)

    for module in (shared, simhash_documents):
        monkeypatch.setattr(module, "written", told)
    docs = spark.createDataFrame([(i, f"one two three {i % 7}") for i in range(30)], "doc_id long, text string")
    write(told(simhash_documents.kept(docs)))
    told(simhash_documents.links(write(spark.createDataFrame([(0, 1), (1, 2), (14, 3)], "fp long, rep long"))))
    assert all(made == named for made, named in plans) and any(named for _, named in plans)
    edges = write(spark.createDataFrame([(a, a + 1) for a in range(9)], "a long, b long"))
    plans.clear()
    assert {tuple(x) for x in shared.components(edges).collect()} == {(a, 0) for a in range(10)}
    assert len(plans) > 1 and not sum(made for made, _ in plans)
