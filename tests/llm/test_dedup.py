"""Near duplicates, line runs and components against brute force, with all odd rows."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import hashing, linededup, minhash
from lexigrain.llm.components import connected_components

ASCII_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return ASCII_WORDS.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    union = Union()
    for i, (a, s) in enumerate(sets):
        union.find(a)
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                union.join(a, b)
    return union


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents():
    rng = random.Random(5)
    rows, common = [], prose(rng, 60)
    for base in range(6):
        text = prose(rng, 120)
        for copy in range(rng.randint(2, 12)):
            own = list(text)
            for _ in range(copy // 2):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            rows.append((len(rows) * 3 % 400, " ".join(own)))
    # A passage that many share without being alike, a chain of drifting copies, and short texts.
    rows += [(1000 + i, " ".join(common + prose(rng, 100))) for i in range(30)]
    drift = prose(rng, 90)
    for i in range(12):
        rows.append((2000 - i, " ".join(drift)))
        drift = drift[2:] + prose(rng, 2)
    rows += [(3000, "One TWO three"), (3001, "one two\tthree "), (3002, "one two"), (3003, ""), (3004, None), (3005, "  \n")]
    rows += [(3006, "é É x y z"), (3007, "É é x y z"), (None, rows[0][1]), (3008, rows[0][1]), (3008, rows[0][1]), (3009, "one two three")]
    return rows


@pytest.mark.parametrize("group", [2_000, 3])
def test_components_equal_brute_force(spark, group):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("band", F.lit(1)).repartition(5)
    union = brute_components(rows)
    got = minhash.near_duplicates(docs, group=group).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter((d, len(shingles(t))) for d, t in rows)
    assert collections.Counter((r.id, r.n_shingles) for r in got) == sizes
    for r in got:
        if r.id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.component_id, r.kept) == (union.find(r.id), union.find(r.id) == r.id)


def test_large_groups_are_searched_completely(spark):
    """A pair in a large group is found even if it shares no further band."""
    rng = random.Random(6)
    texts = {i: " ".join(prose(rng, 60)) for i in range(8)}
    texts[5] = texts[2] + " more"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [(i, len(shingles(t)), [7] + [1000 * i + b for b in range(1, minhash.BANDS)], bytes(minhash.BINS)) for i, t in texts.items()]
    classes = spark.createDataFrame(rows, "id long, n long, bands array<bigint>, bytes binary")
    component = spark.createDataFrame([], "id long, component long")
    got = minhash._remaining_links(docs, classes, component, 3, "doc_id", "text").collect()
    assert {tuple(sorted(r)) for r in got} == {(2, 5)}


def test_a_search_without_large_groups_reads_no_local_rows(spark):
    """Local rows are read by Python workers of their own, which stay in every executor for a while."""
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    classes = spark.range(3).select("id", F.lit(2).cast("long").alias("n"), F.array("id").alias("bands"), F.lit(b"").alias("bytes"))
    component = spark.range(0).select("id", F.col("id").alias("component"))
    got = minhash._remaining_links(docs, classes, component, 3, "doc_id", "text")
    assert got.columns == ["a", "b"] and got.count() == 0
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()


def test_tasks_of_large_groups_are_bounded(spark):
    rows = [(9, 0, i, 10, 0 if i < 700 else i // 2) for i in range(1500)] + [(8, 0, i, 10, i) for i in range(5)]
    group = spark.createDataFrame(rows, "band long, number int, id long, n long, component long")
    tasks = collections.defaultdict(list)
    for r in minhash._dealt(group, 200).collect():
        tasks[r.band, r.task].append(r)
    assert max(map(len, tasks.values())) <= 200
    met = collections.Counter()
    for own in tasks.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                if a.component != b.component and (not a.side or a.side != b.side):
                    met[a.band, min(a.id, b.id), max(a.id, b.id)] += 1
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] and a[4] != b[4]]
    assert len(met) == len(pairs) and set(met.values()) == {1}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    assert linededup.dedup_lines(docs).count() == 0


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, shared in ((1, 1), (3, 2), (400, 300), (5000, 4000)):
        both = rng.integers(0, 1 << 63, shared).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, n - shared).astype(np.uint64)]) for _ in range(2))
        agreement = np.mean(minhash.sketch(a) == minhash.sketch(b))
        assert abs(agreement - shared / (2 * n - shared)) < 0.12
        assert (minhash.sketch(a) == minhash.sketch(a[::-1])).all()


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = ["", "a", "  Ab  ab\n", "é" * 30 + " x", "long" * 40, " ".join(f"w{i}" for i in range(50))]
    data, offsets = hashing.text_buffers(pa.array(texts))
    whole = hashing.hash_words(data, offsets)
    monkeypatch.setattr(hashing, "PIECE", 16)
    monkeypatch.setattr(hashing, "_powers", {})
    pieces = hashing.hash_words(data, offsets)
    for a, b in zip(whole, pieces):
        assert a.tolist() == b.tolist()
    assert np.diff(whole[1]).tolist() == [len(words(t)) for t in texts]
    assert whole[0][1] == whole[0][2]


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 500 + i) for i in range(40)] + [(3, 3)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: union.find(n) for e in edges if e[0] != e[1] for n in e}


def brute_lines(rows, least):
    """Keeps first occurrences of every least run, forward and backward."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, gone = {}, {}
    for doc, text in order:
        lines = [tuple(words(line)) for line in (text or "").split("\n")]
        runs = set()
        for i in range(len(lines)):
            for step in (1, -1):
                total, j = 0, i
                while 0 <= j < len(lines):
                    total += len(lines[j])
                    if total >= least:
                        runs.add((min(i, j), max(i, j)))
                        break
                    j += step
        gone[doc] = set()
        for a, b in sorted(runs):
            source = first.setdefault(tuple(lines[a : b + 1]), (doc, a, b))
            if source[0] != doc or source[2] < a:
                gone[doc].update(range(a, b + 1))
    return {
        d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows
    }


def test_repeated_runs_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(prose(rng, rng.choice([1, 2, 5, 12, 30]))) for _ in range(60)]
    passage = "\n".join(pool[:6])
    rows = []
    for doc in range(40):
        lines = [rng.choice(pool[6:]) for _ in range(rng.randint(0, 14))]
        if doc % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        rows.append((doc * 7 % 41, "\n".join(lines)))
    rows += [(50, "Tic tac.\n" * 60), (51, None), (52, ""), (53, "\n\n"), (None, passage), (54, passage.upper())]
    rows += [(55, " ".join(prose(rng, 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit("clash")).repartition(3)
    got = linededup.dedup_lines(docs, min_words=20, keep_emptied=True)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows, 20)
    left = linededup.dedup_lines(docs, min_words=20)
    emptied = {d for d, t in brute_lines(rows, 20).items() if not t and dict(rows)[d]} - {53}
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - emptied
