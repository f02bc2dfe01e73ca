"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from lexigrain.llm import spelling
from lexigrain.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_counts(docs, plant=None, min_length=5, min_count=3):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if plant and key is not None and h % plant == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def brute_groups(counts, ratio=2):
    near = {w: [] for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w in counts:
        for size in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [o for o in by_length.get(size, ()) if one_edit(w, o)]
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    rows = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        rows.add((w, f, root, n, len(near[w]), counts[f] if f else None))
    return rows


def result(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def test_registered_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    df = QUERIES["op11_spelling_variants"](spark, FOLDER)
    assert result(df) == brute_groups(brute_counts(docs, plant=97))
    assert df.count() == len(brute_counts(docs, plant=97))


def test_many_close_words_equal_brute_force(spark):
    draw = random.Random(5)
    counts = {}
    for _ in range(1_500):
        word = "".join(draw.choice("abcéiÿ") for _ in range(draw.randint(5, 8)))
        counts[word] = draw.choice((3, 4, 6, 6, 13, 40))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(spelling.group_variants(words)) == brute_groups(counts)


def test_chains_of_forms_end_in_one_root(spark):
    counts = {"aaaaa" + "b" * k: 3 * 2**k for k in range(9)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = result(spelling.group_variants(words))
    assert rows == brute_groups(counts) and {r[2] for r in rows} == {"aaaaabbbbbbbb"}


@pytest.mark.parametrize("plant", [None, 2])
def test_odd_rows(spark, plant):
    texts = [
        (1, "Straße straßE STRAße Éclair éclair"),
        (1, "Straße straßE STRAße Éclair éclair"),  # a repeated row counts again
        (None, "Straße strasse strasse strasse"),
        (2, None),
        (3, ""),
        (4, "tiny 12345 KKKKK İİİİİİ ŁŁŁŁŁŁ日本語日本語"),
        (5, "×÷×÷× ×÷×÷× ×÷×÷×"),
    ]
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t in texts], "doc_id long, text string, word string, n int")
    df = spelling.spelling_variants(docs, plant_every=plant)
    assert result(df) == brute_groups(brute_counts(texts, plant))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    df = spelling.spelling_variants(docs, plant_every=97)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == 0


def test_very_long_words_and_texts(spark, monkeypatch):
    long_word = "ab" * 10_000
    variant = long_word[:5_001] + "x" + long_word[5_002:]
    text = " ".join([long_word] * 7 + [variant] * 3 + ["house"] * 200_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.word: (r.n_near, r.form) for r in spelling.spelling_variants(docs).collect()}
    assert got == {long_word: (1, None), variant: (1, long_word), "house": (0, None)}


def test_neighbourhoods_made_in_pieces_are_the_same(monkeypatch):
    words = ["aabbcc", "abcdefgh", "zzzzz"]
    whole = set()
    for own, near in spelling.neighbour_hashes(words):
        whole |= set(zip(own.tolist(), near.tolist()))
    monkeypatch.setattr(spelling, "CELLS", 8)
    parts = set()
    for own, near in spelling.neighbour_hashes(words):
        parts |= set(zip(own.tolist(), near.tolist()))
    assert parts == whole
