"""The pipeline end to end, each stage against the operator's own rule."""

from __future__ import annotations

import corpus_pipeline
from bookloom.llm.shared import written


def test_stages(spark, tmp_path, words, rows):
    import random

    r = random.Random(9)
    clean = [(1000 + i, " ".join(r.choice(words) for _ in range(80)), "en", "s", 0) for i in range(12)]
    item = " ".join(r.choice(words) for _ in range(30))
    leaked = [(2000, clean[0][1] + "\n" + item, "en", "s", 0)]
    junk = [(3000, "### *** " * 60, "en", "s", 0), (3001, "short", "en", "s", 0), (3002, None, "en", "s", 0)]
    copies = [(4000 + i, clean[5][1], "en", "s", 0) for i in range(4)]
    frame = spark.createDataFrame(clean + leaked + junk + copies, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = frame, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, str(tmp_path)))
        left[name] = {x.doc_id for x in docs.select("doc_id").collect()}
        if i < 4:
            assert docs.columns == frame.columns
    assert left["quality_rules"] == {*(d[0] for d in clean), 2000, *(d[0] for d in copies)}
    assert left["line_dedup"] == left["quality_rules"]
    # copies lose their only line and become one group of empty texts
    assert left["near_duplicates"] == {*(d[0] for d in clean), 2000, 4000}
    assert left["decontamination"] == left["near_duplicates"] - {2000}
    assert left["packing"] == left["decontamination"]
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left["packing"]


def test_run_against_brute_force(spark, tmp_path, words):
    """Every stage anew in plain Python, on texts with copies, shared lines, junk and a leak."""
    import random
    import zlib
    from collections import defaultdict

    import numpy as np
    from tokenizers import Tokenizer

    from bookloom.llm import best_fit_packing
    from tests.llm.test_documents import brute_fingerprint, brute_quality, roots
    from tests.llm.test_lines_and_leaks import brute_lines

    r = random.Random(4)
    many = [a + b for a in words for b in words[:20]]
    line = lambda n: " ".join(r.choice(many) for _ in range(n))
    shared, item = line(30), line(25)
    rows = [(i, "\n".join(line(40) for _ in range(3))) for i in range(14)]
    rows += [(20 + i, rows[0][1]) for i in range(5)] + [(30 + i, line(60) + "\n" + shared) for i in range(4)]
    rows += [(40, rows[1][1].replace(rows[1][1].split()[7], "changed", 1)), (41, line(70) + "\n" + item), (42, "### " * 90), (43, None), (44, "few words"), (45, line(5000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def good(t):
        n, chars, symbols, _, repeats = brute_quality(t)
        return n >= 50 and 100 * repeats <= 50 * n and 100 * symbols <= 10 * n and 300 * n <= 100 * chars <= 1000 * n

    left = {i: t for i, t in rows if good(t)}
    gone = defaultdict(set)
    for i, k, *_, kept in brute_lines(list(left.items())):
        if not kept:
            gone[i].add(k)
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in left.items()}
    prints = {i: brute_fingerprint(t) for i, t in left.items()}
    first = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    left = {i: t for i, t in left.items() if first[i] == i and item not in t}
    tokenizer = Tokenizer.from_file(best_fit_packing.default_tokenizer())
    want = set()
    for i, t in left.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, p, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got} == want and len(got) == len(want)


def test_stages_take_any_rows(spark, tmp_path, words):
    """Nulls, repeated ids, a long text, columns named like those used inside; an empty table."""
    text = " ".join(f"{w}{i % 7}" for i, w in enumerate(words * 3))
    schema = "doc_id long, text string, row string, gone int, `left` int, _kept int, fp string, window string, chunk int, n int, component string, n_chars int"
    rest = ("r", 1, 2, 3, "f", "w", 4, 5, "c", 6)
    rows = [(1, text, *rest), (1, text, *rest), (None, text, *rest), (2, None, *rest), (None, None, *rest), (3, "", *rest), (4, text + "\n" + " ".join(f"{w}{i}" for i in range(9000) for w in ("a", "b")), *rest), (5, text, *rest)]
    spark.createDataFrame([(1, "What is the capital of the far country?"), (None, text), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = written(stage(spark, docs, str(tmp_path)))
            assert docs.columns == [c.strip().split()[0].strip("`") for c in schema.split(",")], name
        left = [(x.doc_id, x.row, x.n) for x in docs.collect()]
        assert sorted(left, key=str) == sorted(([(1, "r", 5)] * 2 + [(4, "r", 5), (5, "r", 5), (None, "r", 5)]) if some else [], key=str)
        assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == (4 if some else 0)
