"""Packing, licenses, language, quality, decontamination and the pipeline."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, difference
from lexigrain.llm import decontaminate, langid, licenses, packing, sitequality
from lexigrain.llm.queries import QUERIES, table, tokenizer_definition
from lexigrain.storage import store

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return table(spark, FOLDER, "documents")


# --- packing ------------------------------------------------------------------------------------


def check_packing(rows, expected, capacity):
    """Every token once, in gapless sequences; returns their number."""
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert pieces.keys() == expected.keys()
    for doc, ids in expected.items():
        bounds = packing.piece_bounds(len(ids), capacity)
        wanted = [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(bounds)]
        assert sorted(pieces[doc]) == wanted
    return len(bins)


@pytest.mark.parametrize("items_per_task", [200_000, 40])
def test_documents_are_packed_whole_and_tightly(spark, items_per_task):
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    tokenizer = Tokenizer.from_str(tokenizer_definition())
    expected = {
        r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()
    }
    rows = packing.pack_documents(docs, tokenizer_definition(), capacity=512, items_per_task=items_per_task).collect()
    used = check_packing(rows, expected, 512)
    assert used <= sum(map(len, expected.values())) / 512 * 1.02 + 2


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "x"), (1, "x")], "doc_id long, text string").withColumn("fill", F.lit(0))
    rows = packing.pack_documents(docs, tokenizer_definition()).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 3), (1, 2), (1, 2)]
    assert packing.pack_documents(docs.limit(0), tokenizer_definition()).count() == 0


def library_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def piece_rows(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.token_pieces(docs, tokenizer_definition(), capacity=1 << 30)
    return {r.doc_id: (r.length, r.ids_crc32) for r in pieces.collect()}


def expected_rows(texts):
    tokenizer = Tokenizer.from_str(tokenizer_definition())
    ids = [np.array(library_ids(tokenizer, t), "<u4") for t in texts]
    return {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}


def test_texts_encode_as_the_library_does(spark, monkeypatch):
    parts = list("ab z .,'!-\n\t\r19éßç中😀٠_  　 \x85\x1cª\u0378") + ["'ll", "'s", " the", "  ", "<|endoftext|>"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|>", None, ""]
    expected = expected_rows(texts)
    assert piece_rows(spark, texts) == expected
    # The way of very long texts, a few characters at a time.
    encoder = packing.WordEncoder(tokenizer_definition())
    monkeypatch.setattr(packing, "STRETCH", 3)
    for i, text in enumerate(texts):
        ids = np.frombuffer(encoder.encode(text or "") + np.array([0], "<u4").tobytes(), "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) == expected[i]


def test_a_forgetting_encoder_and_a_very_long_text_give_the_same_ids(spark, monkeypatch):
    long_text = " ".join(f"word{i} of {i * 7}" for i in range(120_000))
    assert len(long_text) > packing.SPLIT_BYTES
    texts = [long_text, "word1 of 7", "b " * 1000, long_text]
    assert piece_rows(spark, texts) == expected_rows(texts)
    monkeypatch.setattr(packing, "MEMO_WORDS", 2)
    encoder = packing.WordEncoder(tokenizer_definition())
    for text in ("one two three", "three four one"):
        words = pa.array([[w if i == 0 else f" {w}" for i, w in enumerate(text.split())]])
        ids, bounds = encoder.encode_lists(words)
        assert ids.tolist() == library_ids(encoder.tokenizer, text)[:-1] and bounds.tolist() == [0, len(ids)]


def test_a_full_memo_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 20)
    encoder = packing.WordEncoder(tokenizer_definition())
    for k in range(30):
        words = [" the", " of", *(f" rare{k}x{i}" for i in range(10)), "<|endoftext|>"]
        ids, bounds = encoder.encode_lists(pa.array([words, None, words[:2]]))
        expected = [library_ids(encoder.tokenizer, "".join(w))[:-1] for w in (words, words[:2])]
        assert ids.tolist() == expected[0] + expected[1]
        assert bounds.tolist() == [0, len(expected[0]), len(expected[0]), len(ids)]
        assert len(encoder.memo) <= 20 + 13 and len(encoder.memo) == len(encoder.sizes) == len(encoder.again)
        assert k < 3 or encoder.memo[" the"] < 13 and encoder.memo[" of"] < 13
    monkeypatch.setattr(packing, "MEMO_WORDS", 2)  # too small for what is met again
    encoder.encode_lists(pa.array([[" a", " b"], [" a", " b"]]))
    assert len(encoder.memo) == 3


def test_batches_are_encoded_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(packing, "PART_WORDS", 10)
    sizes = [4, 4, 4, 30, 0, None, 3, 7, 1]
    lists = [None if n is None else [f"{i}.{k}" for k in range(n)] for i, n in enumerate(sizes)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(lists, pa.list_(pa.string()))], names=["id", "words"])
    parts = list(packing.batch_parts([batch.slice(0, 2), batch.slice(2), batch.slice(9)], 1))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= 10 for p in parts)


def test_best_fit_is_best_fit():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3, 4]]


# --- licenses -----------------------------------------------------------------------------------


def test_licenses_equal_duckdb(spark):
    assert difference(spark, connect(FOLDER), "op3_license_scan", FOLDER) is None


def test_licenses_of_odd_rows(spark):
    notice = "Permission is hereby granted, FREE of charge, to any person obtaining a copy of this software and"
    rest = "associated documentation files (the Software), to deal in the Software without restriction."
    rows = [
        (1, None), (2, ""), (3, "!!"), (4, "cc by cc-by CC BY, éapache License apache LICENSE"), (4, "mit license"),
        (5, f"Some words.\n\n{notice}\n{rest}\n\nMore."), (None, "the MIT license"), (6, "x\nAll rights\nreserved"),
        (7, "all rights reserved"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("label", F.lit(2))
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == len(rows)
    empty = (0, None, None, [], [], 0.0)
    for key in ((1, 0), (2, 0), (3, 0)):
        assert tuple(got[key])[2:] == empty
    assert tuple(got[(4, 10)])[2:6] == (4, 0, 8, ["apache", "cc-by"])
    assert tuple(got[(4, 2)])[2:5] == (1, 0, 0)
    whole = next(r for r in got.values() if r.doc_id == 5)
    assert whole.found == ["mit"] and whole.n_base == 0 and whole.score >= licenses.THRESHOLD
    assert tuple(got[(None, 3)])[2:5] == (1, 1, 1)
    assert got[(6, 4)].found == got[(7, 3)].found == ["all-rights-reserved"]  # lines play no part
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


GPL_NOTICE = """This program is free software; you can redistribute it
and/or modify it under the terms of the GNU General Public
Licence as published by the Free Software Foundation; either
version 3, or any later version."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""


def brute_labels(text):
    """Labels and the largest containment by looking at every block that begins with a template word."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]
    every = {w for t in licenses.TEMPLATES for part in (t.words, t.required, t.without) for w in part.split()}
    labels, most = set(), 0.0
    for t in licenses.TEMPLATES:
        sequence = t.words.split()
        own = set(sequence)
        for i, word in enumerate(words):
            if word not in every:
                continue
            if len(sequence) < licenses.EXACT_BELOW:
                share = float(words[i : i + len(sequence)] == sequence)
            else:
                block = set(words[i : i + licenses.window_words(len(sequence))])
                allowed = set(t.required.split()) <= block and not block & set(t.without.split())
                share = len(block & own) / len(own) * allowed
            if share >= licenses.THRESHOLD - 1e-9:
                labels.add(t.label)
                most = max(most, share)
    return sorted(labels), most


@pytest.mark.parametrize(
    "text, labels",
    [
        ("released under the GPL license", ["gpl"]),
        ("the film was released in may and the driver held a license under another name", []),
        ("We reserved all the rights of way", []),
        ("the press released a note under the bridge; a fishing license is needed", []),
        (MIT_GRANT, ["mit"]),
        (GPL_NOTICE, ["gpl"]),
        (GPL_NOTICE.replace("Public", "Affero Public"), ["agpl"]),
        ("This library" + GPL_NOTICE[12:].replace("General", "Lesser General"), ["lgpl"]),
        ("the license under which it is released may be the mit one", []),
    ],
)
def test_labels_of_notices_and_of_ordinary_sentences(spark, text, labels):
    for docs in ([(1, text)], [(1, "word " * 300 + text + " word" * 300)], [(1, text.replace(" ", "\n\n"))]):
        row = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).first()
        assert row.found == labels == brute_labels(docs[0][1])[0]


def test_labels_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(licenses, "SEGMENT", 16)
    draw = random.Random(3)
    sentences = [t.words.split() for t in licenses.TEMPLATES] + [GPL_NOTICE.split(), MIT_GRANT.split()]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(draw.randint(1, 4)):
            part = list(draw.choice(sentences))
            for _ in range(draw.choice((0, 1, 3, 6, 9))):  # edits
                at = draw.randrange(len(part))
                part[at : at + draw.choice((0, 1))] = draw.choice(([], ["lesser"], ["word"], ["the", "software"]))
                part = part or ["x"]
            words += part + ["pad"] * draw.choice((0, 2, 30))
        texts.append(" ".join(words))
    texts.append("the software " * 4_000 + MIT_GRANT + " license" * 4_000)  # long, with many template words
    rows = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = 0
    for i, text in enumerate(texts):
        labels, most = brute_labels(text)
        base = set(rows[i].base_found)
        assert rows[i].found == sorted({*labels, *base})
        assert base or rows[i].score == pytest.approx(most)
        found += bool(labels)
    assert found > 75


# --- language -----------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    got = QUERIES["op8_language_id"](spark, FOLDER).join(documents(spark).select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(got) == documents(spark).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.n_chars > 100]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_languages_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et la vache", "fr"), (3, None, "en"), (4, "12 !?", None), (5, "\0ab\0", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.learn_prototypes(docs, F.col("text"), F.col("lang"))
    got = {r.id: r for r in langid.predict_languages(docs, F.col("text"), {"id": F.col("doc_id")}, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "fr", "und", "und"] and got[3].score == 0
    nothing = langid.learn_prototypes(docs.limit(0), F.col("text"), F.col("lang"))
    untold = langid.predict_languages(docs, F.col("text"), {"id": F.col("doc_id")}, nothing).collect()
    assert {r.lang_pred for r in untold} == {"und"}


def test_dot_products_are_those_of_bundled_vectors():
    text = "Bound, permuted and bundled: étude 7"
    grams = langid.Trigrams([text])
    whole = np.zeros(langid.DIMENSIONS)
    for _, vectors in grams.vectors(grams.ids, langid.DIMENSIONS):
        whole += vectors.sum(axis=0)
    letters = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    letters = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
    by_hand = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        one, two, three = (langid.letter_vectors(np.array([ord(x)], np.uint32), langid.DIMENSIONS)[0] for x in (a, b, c))
        by_hand += np.roll(one, 2) * np.roll(two, 1) * three
    assert (whole == by_hand).all()


# --- quality ------------------------------------------------------------------------------------


def quality_rows():
    rng = random.Random(8)
    rows, labels = [], []
    for doc in range(260):
        text = " ".join(f"w{rng.randrange(300)}" for _ in range(40))
        bad, toxic = doc % 5 == 0, doc % 7 == 0
        if toxic:
            text += " you nasty thing"
        if bad:
            text = text.replace(" ", "*** ")
        rows.append((doc, text, f"s{doc % 3}", "en"))
        if doc < 200:
            labels.append((doc, int(not bad), int(toxic)))
    return rows, labels


def test_quality_learns_both_traits(spark):
    rows, labels = quality_rows()
    rows += [(900, None, "s0", None), (901, "", None, "en"), (None, "w1 w2", "s1", "en"), (902, rows[1][1], "s1", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("kept", F.lit("x"))
    marks = spark.createDataFrame(labels + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = sitequality.SiteQuality(docs, marks)
    got = model.judge(docs, keep_only=False)
    result = [tuple(r) for r in got.collect()]
    assert len(result) == len(rows)
    for doc, text, _, _, _, low, toxic, kept in result:
        if doc is not None and 200 <= doc < 260:
            assert (low >= 0.5, toxic >= 0.5, kept) == (doc % 5 == 0, doc % 7 == 0, bool(doc % 5 and doc % 7))
        if doc in (900, 901, None):
            assert kept
    stays = model.judge(docs, keep_only=True)
    assert stays.columns == docs.columns and stays.count() == sum(r[-1] for r in result)


def test_quality_without_labels_or_rows(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sitequality.SiteQuality(docs, none).judge(docs, keep_only=True).count() == len(rows)
    assert sitequality.SiteQuality(docs.limit(0), none).judge(docs.limit(0), keep_only=True).count() == 0


def test_sparse_sites_shrink_toward_their_host(spark):
    sites = [("a", "x", 1000, 900.0, 0.0), ("a", "y", 1, 0.0, 0.0), ("b", "x", 1000, 50.0, 0.0), ("c", "x", 1, 1.0, 0.0)]
    df = spark.createDataFrame(sites, "host string, path string, n long, low_quality double, toxic double")
    got = {(r.host, r.path): r.low_quality_rate for r in sitequality.site_rates(df).collect()}
    assert abs(got["a", "x"] - 0.9) < 0.02 and abs(got["b", "x"] - 0.05) < 0.02
    assert 0.2 < got["a", "y"] < 0.9 and got["c", "x"] < 1


# --- decontamination ----------------------------------------------------------------------------


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"zz{rng.randrange(99)}"
        elif kind == 1:
            out.insert(at, f"yy{rng.randrange(99)}")
        else:
            del out[at]
    return out


def levenshtein_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        fresh = [i]
        for j, b in enumerate(text, 1):
            fresh.append(min(row[j - 1] + (a != b), row[j] + 1, fresh[j - 1] + 1))
        row = fresh
    return min(row)


def test_items_are_found_within_their_edits(spark):
    rng = random.Random(6)
    items = [(i, [f"i{i}w{k}" if k % 3 else "the" for k in range(n)]) for i, n in enumerate([8, 15, 30, 45, 59])]
    rows, doc = [], 0
    for item, words in items:
        for edits in range(0, len(words) // 5 + 6, 2):
            body = [f"w{rng.randrange(500)}" for _ in range(30)]
            rows.append((doc, body[:13] + edited(rng, words, edits) + body[13:]))
            doc += 1
    texts = [(d, " ".join(w).upper() + ".") for d, w in rows]
    texts += [(None, " ".join(items[2][1])), (900, None), (901, ""), (902, texts[0][1]), (902, texts[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(
        [(i, " ".join(w)) for i, w in items] + [(70, "too short"), (71, None), (72, "")], "item_id long, text string"
    )
    expected = set()
    for d, text in texts:
        for item, words in items:
            if text and levenshtein_inside(words, text.lower().rstrip(".").split()) <= len(words) // 5:
                expected.add((d, item))
    for block in (1 << 23, 300):
        got = decontaminate.find_items(docs, bench, block_bytes=block)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == expected
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in texts} - {d for d, _ in expected}
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(texts)


def test_short_items_are_found_word_for_word(spark):
    texts = [(1, "Well: what is the capital of France?"), (2, "what is the old capital of"), (3, "what is the capital"), (4, "Pi, pi")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is the capital of"), (2, "pi"), (3, "?!")], "item_id long, text string")
    got = decontaminate.find_items(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.item_words) for r in got) == [(1, 1, 0, 5), (4, 2, 0, 1)]
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {2, 3}


# --- registration and pipeline -------------------------------------------------------------------


def test_registration():
    assert {f"op{n}" for n in range(1, 14)} == {name.partition("_")[0] for name in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


def test_pipeline_stages_hold_on_their_own_input(spark):
    docs = documents(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, FOLDER), name)
        seen[name] = (docs, out)
        docs = out
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == before.columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    before, after = seen["benchmark_decontamination"]
    held = {r.doc_id for r in decontaminate.find_items(before, table(spark, FOLDER, "benchmark")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - held
    before, after = seen["best_fit_packing"]
    tokenizer = Tokenizer.from_str(tokenizer_definition())
    check_packing(
        after.collect(),
        {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [0] for r in before.collect()},
        packing.CAPACITY,
    )
    assert before.where("n_chars <> length(text)").count() == 0


def test_pipeline_stages_take_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing names and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, band array<int>, c1 string"
    rows = [
        (1, None, None, None, None, None, None, None),
        (None, "some words that nobody else has", "en", "s", 31, True, [1], "x"),
        (2, "", "", "", 0, False, [], ""),
        (3, "twice the same row", "en", "s", 18, None, None, "y"),
        (3, "twice the same row", "en", "s", 18, None, None, "y"),
    ]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, FOLDER), name)
            assert docs.count() == n, name
            if name != "best_fit_packing":
                assert docs.schema.simpleString().split("<", 1)[1] == spark.createDataFrame([], schema).schema.simpleString().split("<", 1)[1]
