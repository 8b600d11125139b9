"""Extraction, archives and packing."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from bookloom.llm import best_fit_packing, tag_path_ratios, warc_salvage

ARTICLE = "Words of the first part, which go on for a while. More of them here, truly."


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), (" \n ", ""), ("<p>", ""), ("a &lt; b &amp; c", "a < b & c"), ("x < y", "x < y"), ("<!-- no end", ""), ("<p>x<script>var a", "x"),
    (f"<nav>Menu</nav><article><h1>Title</h1><p>{ARTICLE}<p>Two\n  words&nbsp;&eacute;<ul><li>item</ul></article><footer>&copy; me</footer>", f"Title\n{ARTICLE}\nTwo words é\nitem"),
    (f"<body><div class='ad'>Buy, buy. Now!</div><main><p>{ARTICLE}</p><form><p>Your name, please.</p></form><div class=comments><p>Nice, really.</p></div></main>", ARTICLE),
    (f"<div class=menu><a href=1>One</a><a href=2>Two</a></div><div id=c><p>{ARTICLE}</p><p>{ARTICLE}</p></div><aside>Not this.</aside>", f"{ARTICLE}\n{ARTICLE}"),
    ("<article><p>a<b>b</b>c<br>d<style>p{}</style></article>", "abc\nd"),
])
def test_main_text(html, want):
    assert tag_path_ratios.main_text(html) == want


LONG = f"{ARTICLE} And then, as it goes, some more of it; much more. {ARTICLE}"


@pytest.mark.parametrize(("html", "lost", "left_out"), [
    # the only articles are teasers
    (f"<div id=a><p>{LONG}</p><p>{LONG}</p></div><div class=cards><article><a>Next one</a></article><article><a>Another</a></article></div>", [LONG], []),
    # furniture words in a wrapper's name
    (f"<div class='layout has-sidebar'><div class=sidebar><a>One</a><a>Two</a></div><div><p>{LONG}</p><p>{LONG}</p></div></div>", [LONG], ["One"]),
    (f"<article><div class='article-header'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></article><div class=ad>Buy</div>", [LONG], ["Buy"]),
    # text inside an article is judged too
    (f"<article><p>{LONG}</p><p>{LONG}</p><div class=share><a>Tweet</a></div></article>", [LONG], ["Tweet"]),
    # no article
    (f"<div class=menu><a>One</a><a>Two</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div class=copyright>Mine</div>", [LONG], ["One", "Mine"]),
])
def test_main_text_by_ratios(html, lost, left_out):
    lines = tag_path_ratios.main_text(html).split("\n")
    assert all(x in lines for x in lost) and not any(x in lines for x in left_out)


def test_extracted(spark):
    rows = [(1, "u", f"<article><p>{ARTICLE}</article>", "t"), (2, None, None, "t"), (2, None, None, "t"), (3, "v", "<div>" * 3000 + "deep", "t")]
    got = tag_path_ratios.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, ARTICLE, len(ARTICLE)), (2, "", 0), (2, "", 0), (3, "deep", 4)]


def test_archives_round_trip(spark):
    big, small = "x" * 1500, "y" * 10
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, small), (4, "http://d", small), (5, "e", None), (6, "f", ""), (7, "g\r\nh", big + "é"), (None, "n", big), (2, "again", big)]
    rows += [(100 + i, "copy", "<p>" + "z" * 2000) for i in range(12)]
    pages = spark.createDataFrame([(*r, "payload") for r in rows], "page_id long, url string, html string, record_type string")
    for compress in (True, False):
        path = warc_salvage.scratch_dir(spark) + f"/archives-{compress}-{random.random()}"
        warc_salvage.write_archives(pages, path, compress)
        got = warc_salvage.read_archives(spark, path).collect()
        assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
        newest = defaultdict(lambda: -1)
        for i, _, h in rows:
            newest[h or ""] = max(newest[h or ""], -1 if i is None else i)
        for r in got:
            assert r.record_type == ("response" if r.refers_to is None else "revisit")
        by_id = {r.page_id: r for r in got}
        for i, url, h in rows:
            data = (h or "").encode()
            again = len(data) >= 1000 and i != newest[h or ""]
            r = by_id[i]
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            assert r.refers_to == (newest[h] if again else None)
            assert r.payload == (b"" if again else data)
    empty = warc_salvage.scratch_dir(spark) + f"/none-{random.random()}"
    warc_salvage.write_archives(pages.limit(0), empty)
    assert warc_salvage.read_archives(spark, empty).count() == 0


def records(n, compress):
    out = []
    for i in range(n):
        payload = f"<p>page {i}</p>".encode() * 50
        one = warc_salvage.record_bytes(i, f"http://{i}", payload, hashlib.sha1(payload).hexdigest(), "response", None)
        out.append(warc_salvage.member(one) if compress else one)
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = records(6, compress)
    damaged = bytearray(parts[2])
    damaged[len(damaged) // 2] ^= 0xFF
    data = b"junk" + parts[0] + parts[1][:40] + bytes(damaged) + b"\x1f\x8b\x08more" + parts[3] + parts[4] + parts[5][:-9]
    found = list(warc_salvage.salvage(data))
    assert [f[3]["warc-target-uri"] for f in found if f[0] == "record"] == ["http://0", "http://3", "http://4"]
    at = 0
    for kind, offset, length, *_ in found:
        assert offset == at and length > 0
        at += length
    assert at == len(data) and [f[0] for f in found] == ["gap", "record", "gap", "record", "record", "gap"]
    assert list(warc_salvage.salvage(b"")) == []
    assert [f[0] for f in warc_salvage.salvage(b"nothing here")] == ["gap"]


def test_other_archives():
    """Records of all types, without digests or with other ones, in plain and compressed files."""
    import base64
    import gzip

    def record(kind, block, *more, version="1.1"):
        head = "\r\n".join([f"WARC/{version}", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *more, f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    sha256 = hashlib.sha256(b"body").hexdigest()
    good = [record("warcinfo", b"software: x\r\n"), record("response", http, "Content-Type: application/http;msgtype=response"), record("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http"),
            record("response", http, f"WARC-Payload-Digest: sha256:{sha256}", version="1.0"), record("resource", b"data", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"data").digest()).decode()),
            record("metadata", b"", "Folded: a", " b"), record("conversion", b"text", "WARC-Payload-Digest: blake9:abc"), record("continuation", b"rest", "WARC-Segment-Number: 2")]
    bad = [record("response", http, "WARC-Payload-Digest: sha256:" + "0" * 64), record("resource", b"data", "WARC-Block-Digest: md5:" + "0" * 32)]
    payloads = [b"software: x\r\n", b"body", b"", b"body", b"data", b"", b"text", b"rest"]
    for pack in (lambda x: x, gzip.compress):
        found = list(warc_salvage.salvage(b"".join(map(pack, good))))
        assert [f[0] for f in found] == ["record"] * len(good) and [f[4] for f in found] == payloads
        mixed = list(warc_salvage.salvage(pack(good[0]) + pack(bad[0]) + pack(good[1]) + pack(bad[1])))
        assert [f[0] for f in mixed] == ["record", "gap", "record", "gap"] and "payload digest" in mixed[1][3] and "block digest" in mixed[3][3]
    assert warc_salvage.digest_of("sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ") == ("sha1", hashlib.sha1(b"").hexdigest())


def test_large_member_ends_with_zero(monkeypatch):
    import gzip

    real = gzip.compress
    monkeypatch.setattr(warc_salvage.gzip, "compress", lambda data, *a, **k: real(data, *a, **k)[:-1] + b"\x01" if data else real(data, *a, **k))
    assert warc_salvage.member(b"abc")[-1] == 0


def brute_best_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= s
        else:
            free.append(capacity - s)
    return len(free), sorted(free)


def test_best_fit_decreasing():
    r = random.Random(1)
    for capacity, n in ((10, 50), (64, 300), (4096, 500), (1, 5)):
        sizes = [r.randrange(1, capacity + 1) for _ in range(n)]
        bins, offsets = best_fit_packing.best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, sizes)
        assert (len(used), sorted(capacity - used)) == brute_best_fit(sizes, capacity)
        for b in set(bins.tolist()):
            own = sorted((offsets[i], sizes[i]) for i in range(n) if bins[i] == b)
            assert [o for o, _ in own] == [sum(s for _, s in own[:k]) for k in range(len(own))]
    assert len(best_fit_packing.best_fit_decreasing([], 10)[0]) == 0


def test_packed(docs, rows, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(best_fit_packing.default_tokenizer())
    want = []
    for i, t in [*rows]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), 512)):
            want.append((i, p, s, len(ids[s:s + 512]), zlib.crc32(ids[s:s + 512].tobytes())))
    got = best_fit_packing.packed(docs, length=512).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= sum(w[3] for w in want) / 512 * 1.1 + 1
    assert best_fit_packing.packed(no_docs).count() == 0


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(best_fit_packing.default_tokenizer())
    texts = ["a\x1cb c\x85d", "don't <|endoftext|> x<|startoftext|>y", "é́ Σας ΣΑΣ", "１２ 日本語。　x", "a b c", "\x0b\x0c"]
    words = best_fit_packing.WordIds(best_fit_packing.default_tokenizer())
    ids, ends = words.tokens([t.encode() for t in texts])
    at = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[at:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        at = end
    assert at == len(ids)


def test_other_tokenizers_are_refused(tmp_path):
    """One that keeps white space gives a text other ids than its words."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    tokenizer = Tokenizer(models.BPE(vocab=letters, merges=[]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="not those of its words"):
        best_fit_packing.WordIds(str(tmp_path / "t.json"))


def test_nested_markup_is_read_in_linear_time():
    import time

    from bookloom.llm.tag_path_ratios import main_text

    for page in ("<div>a" * 20_000, "<p><b>x" * 10_000, "<div>a</x>" * 20_000 + "</p>" * 1000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 5


def test_headers_and_forms_of_main_text():
    from bookloom.llm.tag_path_ratios import main_text

    body = "<p>" + "This is a long sentence, with marks in it. " * 12 + "</p>"
    found = main_text(f"<body><article><div class='article-header'><h1>A heading, of its own.</h1></div>{body}{body}</article><div class='header'>Site, menu.</div></body>")
    assert found.startswith("A heading, of its own.\n") and "menu" not in found
    assert main_text(f"<body><form><nav>Menu</nav>{body}</form></body>").startswith("This is a long")
    assert "Search" not in main_text(f"<body>{body}<form>Search, here.</form></body>")
