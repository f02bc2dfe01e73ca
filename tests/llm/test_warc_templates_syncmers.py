"""Archives, page extraction and fingerprints against plain statements of their rules."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import syncmers, templates, warc
from lexigrain.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_chunked_framing_round_trip():
    for size in (0, 1, 7, 8, 9, 100):
        payload = bytes(range(256))[:size] + b"\r\n0\r\n\r\n"
        assert warc.dechunked(warc.chunked(payload, 8)) == payload
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archives_keep_every_row(spark):
    long = "WARC/1.1\r\n\r\nWARC-Type: response\r\n" * 40 + "é" * 500
    rows = [(3, "u3", "x"), (1, "u1", "x"), (2, None, None), (5, "u5", ""), (4, "u\r\n4", long), (6, "u6", long), (None, "n", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    got = {r.key: r for r in warc.archive_round_trip(pages, segment_bytes=100, records_per_file=2).collect()}
    assert len(got) == len(rows) and all(r.error is None for r in got.values())
    by_key = {k: (h or "").encode() for k, _, h in rows}
    for key, payload in by_key.items():
        row = got[key]
        assert row.payload_bytes == len(payload)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = min((k for k, p in by_key.items() if p == payload and k is not None), default=None)
        assert (row.record_type, row.refers_to) == (("response", None) if key == first or key is None else ("revisit", first))
        assert row.payload == (bytearray(payload) if row.record_type == "response" else None)
    empty = warc.archive_round_trip(pages.limit(0))
    assert empty.count() == 0


def test_payloads_are_shuffled_by_digest_only_beyond_the_broadcast(spark, monkeypatch, tmp_path):
    pages = spark.createDataFrame([(1, "u1", "x"), (2, "u2", "x"), (3, "u3", "y")], "page_id long, url string, html string")
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(warc.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    for bound, name in ((10, "sent"), (0, "shuffled")):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)
        warc.write_archives(pages, f"{tmp_path}/{name}", F.col("page_id"), F.col("url"), F.col("html"))
        got = warc.read_archives(spark, f"{tmp_path}/{name}").orderBy("key").collect()
        assert [(r.key, r.record_type, r.refers_to) for r in got] == [(1, "response", None), (2, "revisit", 1), (3, "response", None)]
        assert sent == [1]


def test_repeated_rows_keep_their_segments(spark):
    long = "payload " * 60
    rows = [(1, "u", long)] * 3 + [(None, "n", long + "x")] * 2 + [(2, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_round_trip(pages, segment_bytes=100, records_per_file=2).collect()
    assert sorted((r.key or 0, r.record_type, r.payload_bytes, r.error) for r in got) == (
        [(0, "response", 481, None)] * 2 + [(1, "response", 480, None)] * 3 + [(2, "revisit", 480, None)]
    )


def test_pages_become_their_article(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>Menu</a></nav>"
        "<div class='site-ad big'>Buy</div><article><h1>Big &amp; small</h1><p><b>Bo</b>ld  text<br>next<p>two&nbsp;three"
        "<div class='has-sidebar'>in</div><aside>side</aside><section class=comments><p>me too</p></section></article>"
        "<footer>&copy;</footer>"
    )
    assert " ".join(t for _, t, framed, inside in templates.page_blocks(page)[0] if inside and not framed) == (
        "Big & small Bold text next two three in"
    )
    # Without a marked article the template is what the pages of a host share.
    rows = [(i, f"http://h.org/{i}", f"<div><p>All news here</p><p>story {i}</p><p>Call us</p></div>") for i in range(5)]
    rows += [(10, "http://h.org/9", rows[0][2]), (11, None, None), (12, "http://one.org/a", "<p>alone</p>"), (13, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.key: r.text for r in templates.extract_main_text(pages).collect()}
    assert got == {**{i: f"story {i}" for i in range(5)}, 10: "story 0", 11: "", 12: "alone", 13: ""}
    assert templates.extract_main_text(pages.limit(0)).count() == 0


def test_template_is_cut_from_marked_articles(spark):
    def page(story, notice="<div><p>Join our list</p></div>"):
        return f"<main><h1>Daily</h1><article><p>{story}</p>{notice}</article></main>"

    rows = [(i, f"http://h.org/{i}", page(f"story {i}")) for i in range(6)]
    # Copies of one article are one page and stay; so does an article that is template as a whole.
    rows += [(10 + i, f"http://c.org/{i}", page("shared", f"<aside>{i}</aside>")) for i in range(5)]
    rows += [(20 + i, f"http://c.org/o{i}", page(f"other {i}", "")) for i in range(2)]
    rows += [(30, "http://h.org/bare", page("", "<div><p>Join our list</p></div>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.key: r.text for r in templates.extract_main_text(pages).collect()}
    assert got == {
        **{i: f"story {i}" for i in range(6)},
        **{10 + i: "shared" for i in range(5)},
        **{20 + i: f"other {i}" for i in range(2)},
        30: "Daily Join our list",
    }


def article_text(page):
    return " ".join(t for _, t, framed, inside in templates.page_blocks(page)[0] if inside and not framed)


def test_only_whole_attributes_frame():
    kept = (
        'style="overflow:hidden"', 'title="The hidden valley"', 'data-id="menu-7"', "data-class=menu data-hidden", "href=/v?id=menu",
        'title=\'class="menu"\'', 'class="content-with-sidebar"', "class=article-header", 'class="page-no-ads"', 'aria-hidden="false"',
    )
    for attributes in kept:
        assert article_text(f"<article><div {attributes}>in</div> text</article>") == "in text", attributes
    assert article_text('<article><a href="/view?id=menu">in</a> text</article>') == "in text"
    for attributes in ("hidden", "HIDDEN=''", 'a="x"hidden', "class = 'big menu'", "ID=menu-7", "role=search", "aria-hidden=true", "class=article-sidebar"):
        assert article_text(f"<article><div {attributes}>in</div> text</article>") == "text", attributes


def test_closed_syncmers_are_context_free():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 103, 400).astype(np.uint32)
    places, hashes = syncmers.syncmers(text)
    inner = syncmers._smer_hashes(text, syncmers.S)
    width = syncmers.K - syncmers.S + 1
    expected = [i for i in range(len(text) - syncmers.K + 1) if inner[i : i + width].min() in (inner[i], inner[i + width - 1])]
    assert places.tolist() == expected
    moved = np.concatenate([rng.integers(97, 103, 33).astype(np.uint32), text])
    places2, hashes2 = syncmers.syncmers(moved)
    assert dict(zip((places + 33).tolist(), hashes)).items() <= dict(zip(places2.tolist(), hashes2)).items()
    piece, syncmers.PIECE = syncmers.PIECE, 50
    try:
        again = syncmers.syncmers(text)
    finally:
        syncmers.PIECE = piece
    assert again[0].tolist() == places.tolist() and again[1].tolist() == hashes.tolist()


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1] or ""]))
    out = {}
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows", [[], [(7, "alone é")], [(1, "abcdef"), (5, None), (9, "😀uvwxyz"), (3, ""), (None, "last"), (4, "q" * 90)]])
def test_edits_follow_descending_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash"))
    got = syncmers.fingerprint_edits(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute_edits(rows) and len(got) == len(rows)


def test_edits_of_the_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES["op4_syncmer_fingerprints"](spark, FOLDER).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute_edits(rows)
    texts = dict(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95
