import random

import pytest

from lexigrain.operators import slicing as C
from reference_rules import take_bytes

PIECES = ["a", "é", "€", "😀", "word ", "\n"]


def corpus(spark, rows, rows_per_range=3):
    df = spark.createDataFrame(rows, "doc int, part int, text string").repartition(3)
    return C.OrderedCorpus(df, ["doc", "part"], rows_per_range=rows_per_range)


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(rng.randint(1, 6)):
        for part in range(rng.randint(1, 4)):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6)))
            rows.append((doc, part, rng.choice([text, text, None])))
    return rows


def collected(df):
    return sorted(((r["doc"], r["part"]), r["text"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(5))
def test_slices_follow_the_sequential_rule(spark, seed):
    rows = random_rows(seed)
    plain = [((d, p), t) for d, p, t in sorted(rows, key=lambda r: r[:2])]
    taken = corpus(spark, rows)
    total = max(1, taken.total_bytes)
    rng = random.Random(seed + 100)
    for _ in range(2):
        skip, size = rng.randint(0, total), rng.randint(1, total + 4)
        kept = take_bytes(plain, size)[0]
        assert collected(C.byte_budget_prefix(taken, size)) == kept
        used = taken.stats(size)
        assert (used.bytes_used, used.documents_used) == (sum(len(t.encode()) for _, t in kept), len(kept))
        after = take_bytes(plain, skip)[1] if skip else 0
        assert collected(C.heldout_slice(taken, skip, size)) == take_bytes(plain[after:], size)[0]


def test_running_totals_across_ranges(spark):
    rows = [(d, p, "x" * (d + p)) for d in range(1, 8) for p in range(3)]
    taken = corpus(spark, rows, rows_per_range=2)
    got = taken.running_totals().orderBy("doc", "part").collect()
    used = 0
    for i, (row, (_, _, text)) in enumerate(zip(got, sorted(rows))):
        assert (row["bytes_before"], row["documents_before"], row["n_bytes"]) == (used, i, len(text))
        used += len(text)


def test_exact_budget_ends_the_slice_and_parts_are_disjoint(spark):
    rows = [(0, 0, "abc"), (1, 0, "de"), (2, 0, "fgh")]
    taken = corpus(spark, rows)
    assert collected(C.byte_budget_prefix(taken, 5)) == [((0, 0), "abc"), ((1, 0), "de")]
    assert collected(C.heldout_slice(taken, 4, 9)) == [((2, 0), "fgh")]
    assert collected(C.heldout_slice(taken, 5, 2)) == [((2, 0), "fg")]


def test_row_cut_to_nothing_is_not_counted(spark):
    taken = corpus(spark, [(0, 0, "ab"), (1, 0, "😀")])
    stats = C.read_stats(C.byte_budget_prefix(taken, 4))
    assert (stats.bytes_used, stats.documents_used) == (2, 1)
    C.require_bytes(stats, 4, "size")
    with pytest.raises(ValueError):
        C.require_bytes(stats, 6, "size")


def test_order_keys_must_be_unique_and_known(spark):
    for keys in ([(None, 0, "abc"), (1, 0, "def")], [(1, 0, "abc"), (1, 0, "def"), (2, 0, "g")]):
        with pytest.raises(ValueError):
            C.byte_budget_prefix(corpus(spark, keys), 3)


def test_a_small_budget_sizes_the_first_rows_only(spark):
    rows = [(d, 0, "x" * 10) for d in range(4000)]
    taken = corpus(spark, rows, rows_per_range=50)
    assert C.byte_budget_prefix(taken, 95).count() == 10
    assert taken.sizes.count() < 400
    assert taken.stats(95) == C.CorpusStats(95, 10)
    assert C.heldout_slice(taken, 20_000, 30).count() == 3
    assert taken.total_bytes == 40_000 and taken.sizes.count() == 4000


def test_marks_of_a_cut_prefix(spark):
    taken = corpus(spark, [(i, 0, "x" * n) for i, n in enumerate([4, 7, 25, 1, 3])])
    marks = C.progress_marks(taken, 30, 10).orderBy("doc").collect()
    assert [(m["doc"], m["bytes_used"], m["documents_used"]) for m in marks] == [(1, 11, 2), (2, 30, 3)]


def test_progress_marks(spark):
    taken = corpus(spark, [(i, 0, "x" * n) for i, n in enumerate([4, 7, 25, 1, 3])])
    marks = C.progress_marks(taken, 40, 10).orderBy("doc").collect()
    assert [(m["doc"], m["bytes_used"], m["documents_used"]) for m in marks] == [(1, 11, 2), (2, 36, 3), (4, 40, 5)]
    assert marks[0]["pct"] == 100 * 11 / 40


def test_guards(spark):
    with pytest.raises(ValueError):
        C.check_budgets(-1, 1)
    with pytest.raises(ValueError):
        C.check_budgets(0, 0)
    empty = corpus(spark, [(0, 0, None), (1, 0, "")])
    with pytest.raises(ValueError):
        C.require_documents(C.read_stats(C.byte_budget_prefix(empty, 5)))


def test_a_kept_layout_serves_later_runs_without_sizing(spark, tmp_path, monkeypatch):
    texts = [(i, f"text {i} " * (i % 7 + 1)) for i in range(300)]
    path, kept = str(tmp_path / "corpus"), str(tmp_path / "layout")
    spark.createDataFrame(texts, "doc int, text string").repartition(3).write.parquet(path)
    total = sum(len(t) for _, t in texts)

    def ends(layout):
        corpus = C.OrderedCorpus(spark.read.parquet(path).select("doc", "text"), ["doc"], rows_per_range=40, layout=layout)
        return [(corpus.take(total * k // 5)[1], corpus.stats(total * k // 5)) for k in range(1, 6)]

    sized = []
    real = C.OrderedCorpus._grow
    monkeypatch.setattr(C.OrderedCorpus, "_grow", lambda self: (made := real(self), sized.append(made))[0])
    first = ends(kept)
    assert first == ends(None) and any(sized)
    sized.clear()
    assert ends(kept) == first and not any(sized)
    more = spark.createDataFrame([(900, "one more text")], "doc int, text string")
    more.write.mode("append").parquet(path)
    longer = C.OrderedCorpus(spark.read.parquet(path), ["doc"], rows_per_range=40, layout=kept)
    assert longer.total_bytes == total + 13 and any(sized)
