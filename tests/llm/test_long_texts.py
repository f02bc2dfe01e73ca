"""Very long texts, repeated rows and scale faults that once cost time or memory."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import decontaminate, langid, linededup, minhash, sitequality, syncmers, templates, warc


def prose(seed, n):
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(4_000)]
    return [draw.choice(pool) for _ in range(n)]


LONG = " ".join(prose(1, 300_000))  # about 2 MB
SHORT = " ".join(prose(2, 60))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).repartition(2)


def test_near_copies_of_very_long_texts(spark):
    words = LONG.split()
    changed = " ".join(w if i % 97 else f"x{w}" for i, w in enumerate(words))
    rows = [(5, LONG), (2, changed), (9, LONG), (9, LONG), (7, SHORT), (None, LONG), (8, None)]
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    component = {r.id: r.component_id for r in got}
    assert component[5] == component[2] == component[9] == 2 and component[7] == 7 and component[8] == 8
    assert {r.n_shingles for r in got if r.id == 5} == {len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})}


def test_long_payload_makes_the_round_trip_in_many_segments(spark):
    rows = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://a/3", SHORT * 20), (3, "http://a/3", SHORT * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    started = time.perf_counter()
    got = warc.archive_round_trip(pages).collect()
    assert time.perf_counter() - started < 60
    assert sorted((r.key, r.record_type, r.payload_bytes, r.refers_to, r.error) for r in got) == sorted(
        [(1, "response", len(LONG), None, None), (2, "revisit", len(LONG), 1, None)]
        + [(3, "response", len(SHORT) * 20, None, None)] * 2,
        key=lambda r: r[:3],
    )


def test_most_pages_are_cut_into_segments(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, F.col("page_id"), F.col("url"), F.col("html"))
    segments = warc.read_segments(spark, path)
    cut = segments.where("segment = 1").count()
    assert cut > 0.5 * pages.count() and segments.where("segment > 1").count() >= cut
    assert warc.read_archives(spark, path).where("error is not null").count() == 0


def test_very_long_page(spark):
    page = "<nav>menu</nav><article>" + "".join(f"<p>{w} {w}&amp;</p>\n" for w in LONG.split()[:60_000]) + "</article><footer>f</footer>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", "<article><p>short</p></article>")] * 2
    got = templates.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    expected = " ".join(f"{w} {w}&" for w in LONG.split()[:60_000])
    assert sorted((r.key, r.text) for r in got) == [(1, expected)] * 2 + [(2, "short")] * 2


def test_templates_too_large_to_send_give_the_same_texts(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    rows = [(1_000 + i, "http://hot.org/", f"<div><p>All news here</p><p>story {i}</p><p>Call us</p></div>") for i in range(90)]
    rows += [(None, None, None), (5_000, "x", "<p>alone</p>")] * 2
    pages = pages.unionByName(spark.createDataFrame(rows, pages.schema))
    as_rows = lambda df: sorted((r.key or -1, r.url or "", r.text) for r in df.collect())
    sent = as_rows(templates.extract_main_text(pages))
    monkeypatch.setattr(templates, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(templates, "PAGES_PER_GROUP", 20)
    assert as_rows(templates.extract_main_text(pages)) == sent
    assert (1_003, "http://hot.org/", "story 3") in sent


def test_item_inside_a_very_long_text(spark):
    words = LONG.split()
    item = prose(3, 40)
    planted = words[:150_000] + item[:20] + ["other"] + item[21:] + words[150_000:]
    docs = table(spark, [(1, " ".join(planted)), (2, LONG), (2, LONG), (3, None), (4, "")])
    items = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    got = decontaminate.find_items(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.distance, r.end_word) for r in got] == [(1, 7, 1, 150_040)]


def test_one_long_item_among_many_short_ones_takes_little_memory(spark):
    texts = [" ".join(prose(k, 12)) for k in range(2_000)] + [" ".join(prose(99_999, 20_000))]
    index = decontaminate.ItemIndex(list(range(len(texts))), texts)
    held = sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray)) + sum(w.nbytes for w in index.words)
    assert held < 10_000_000
    texts[-1] = " ".join(texts[-1].split()[:400])
    doc = spark.createDataFrame([(1, "lead " + texts[-1] + " tail"), (2, "lead " + texts[5])], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_items(doc, items).collect()}
    assert got == {(1, 2_000, 0), (2, 5, 0)}


def test_language_of_a_very_long_text(spark):
    rows = [(1, "the cat and the dog sat on the mat", "en"), (2, "le chat et la vache sont dans le pré", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn_prototypes(docs, F.col("text"), F.col("lang"))
    more = spark.createDataFrame([(1, rows[0][1] * 30_000), (2, rows[1][1] * 30_000), (2, rows[1][1] * 30_000)], "doc_id long, text string")
    got = langid.predict_languages(more, F.col("text"), {"id": F.col("doc_id")}, model).collect()
    assert sorted((r.id, r.lang_pred) for r in got) == [(1, "en"), (2, "fr"), (2, "fr")]


def test_texts_of_many_lines_take_time_in_proportion(spark):
    lines = [f"line {i} has a few words of its own" for i in range(40_000)]
    text = "\n".join(lines)
    rows = [(1, text), (2, text), (2, text), (3, "\n".join(["new first line"] + lines)), (4, "short")]
    started = time.perf_counter()
    got = linededup.dedup_lines(table(spark, rows), keep_emptied=True)
    left = sorted((r.doc_id, r.text) for r in got.collect())
    assert time.perf_counter() - started < 60
    assert left == [(1, text), (2, ""), (2, ""), (3, "new first line"), (4, "short")]


def test_site_quality_of_very_long_texts(spark):
    rows = [(i, " ".join(prose(i, 50)) + (" bad words" if i % 2 else ""), "s", "en") for i in range(60)]
    rows += [(100, LONG, "s", "en"), (100, LONG, "s", "en"), (101, LONG + " bad words" * 100_000, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = sitequality.SiteQuality(docs, labels).judge(docs, keep_only=False).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.low_quality <= 1 and 0 <= r.toxic <= 1 for r in got)
    assert len({(r.low_quality, r.toxic) for r in got if r.doc_id == 100}) == 1


def test_fingerprints_of_very_long_texts(spark):
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(table(spark, [(1, LONG), (2, LONG), (3, SHORT), (3, SHORT)])).collect()}
    assert got[1].n_chars == len(LONG) and got[1].fingerprint == got[2].fingerprint != got[3].fingerprint


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_rows_without_an_id_are_spread(spark, share):
    rows = [(None if i < 1_000 * share else i, f"text number {i}") for i in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = syncmers.in_ranges(docs, "doc_id", "text").where("ahead = 0").groupBy("range").count().collect()
    assert max(r["count"] for r in dealt) < 250
    assert syncmers.fingerprint_edits(docs).count() == 1_000
