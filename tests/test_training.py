import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.functions.bpe import MergeTable, Trace, merge_words, play_in_order
from lexigrain.operators.model import check_vocab_size
from lexigrain.operators.scoring import token_totals
from lexigrain.operators.training import TrainingReport, _sums, train_bpe
from lexigrain.operators.words import word_types
from lexigrain.storage import store
from reference_rules import UNICODE_TEXTS, library_merges, library_model


def trained(spark, texts, vocab_size, **options):
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    return train_bpe(word_types(corpus), vocab_size, **options)


def merges(model):
    return [(r["left"], r["right"]) for r in model.merges.orderBy("rank").collect()]


def random_text(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aabbc") for _ in range(rng.randint(1, 9))) for _ in range(60))


@pytest.mark.parametrize(
    "texts, vocab_size",
    [
        (["aaaa"], 300),
        (["aaa aaa"], 300),
        (["abab abab xy"], 300),
        (["aaaaa bababab abaab"], 300),
        (UNICODE_TEXTS, 330),
        (["[UNK] a[UNK]b [UNK]"], 275),
        (["x"], 300),
    ],
)
def test_merges_equal_the_library(spark, texts, vocab_size):
    library = library_model(texts, vocab_size)
    model = trained(spark, texts, vocab_size)
    assert merges(model) == library_merges(library)
    vocab = {r["token"]: r["token_id"] for r in model.vocab.collect()}
    assert vocab == library.get_vocab()


@pytest.mark.parametrize("seed, frontier, length", [(1, 3, 2), (2, 5, 4), (3, 40, 16), (4, 1, 1), (5, 4096, 256)])
def test_small_frontiers_and_rounds_change_nothing(spark, seed, frontier, length):
    texts = [random_text(seed)]
    model = trained(spark, texts, 290, frontier_size=frontier, round_length=length)
    assert merges(model) == library_merges(library_model(texts, 290))


def test_shorter_training_is_a_prefix_and_rounds_are_few(spark):
    texts, report = [random_text(s) for s in range(3)], TrainingReport()
    long = merges(trained(spark, texts, 310, report=report))
    assert merges(trained(spark, texts, 280)) == long[: 280 - 257]
    assert report.rounds < len(long)


def test_vocab_size_bounds():
    check_vocab_size(257)
    check_vocab_size(2_000_000)
    for size in (256, 2**31):
        with pytest.raises(ValueError):
            check_vocab_size(size)


def test_rounds_play_only_words_that_hold_a_proposed_pair(spark):
    texts, report = [random_text(s) for s in range(6)] + ["qz qz qz zq"], TrainingReport()
    model = trained(spark, texts, 340, round_length=8, report=report)
    assert merges(model) == library_merges(library_model(texts, 340))
    words = len({w for t in texts for w in t.split(" ")})
    assert len(report.words_played) == report.rounds > 4
    assert report.words_played[0] > 4 * report.words_played[-1] and sum(report.words_played) < report.rounds * words / 2


def test_summing_up_the_index_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr("lexigrain.operators.training.ROUNDS_PER_STORE", 2)
    texts = [random_text(s) for s in (11, 12)]
    model = trained(spark, texts, 300, frontier_size=30, round_length=5)
    assert merges(model) == library_merges(library_model(texts, 300))


def test_approximate_training_takes_fewer_rounds_and_loses_little(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    words = store(word_types(documents), "words")
    totals, rounds = {}, {}
    for share in (1.0, 0.7):
        report = TrainingReport()
        model = train_bpe(words, 900, round_length=128, report=report, share=share)
        assert model.vocab_size == 900
        own = words.withColumn("word_id", F.monotonically_increasing_id())
        totals[share] = token_totals(own, {"m": model}).first()["token_count"]
        rounds[share] = report.rounds
    assert rounds[0.7] < rounds[1.0] and totals[0.7] < 1.01 * totals[1.0]
    with pytest.raises(ValueError, match="share"):
        train_bpe(words, 300, share=0)


def test_a_rehearsal_saves_rounds_and_changes_no_merge(spark, monkeypatch):
    texts, rounds = [random_text(20)] * 50 + [random_text(s) for s in range(21, 26)], {}
    expected = library_merges(library_model(texts, 300))
    for words in (100_000, 50):
        monkeypatch.setattr("lexigrain.operators.training.REHEARSED_WORDS", words)
        report = TrainingReport()
        assert merges(trained(spark, texts, 300, report=report)) == expected
        rounds[words] = report.rounds
    assert rounds[50] < rounds[100_000]


def test_sums_handed_on_early_change_nothing(spark, monkeypatch):
    monkeypatch.setattr("lexigrain.operators.training.SUMS_PER_TASK", 8)
    texts = [random_text(s) for s in (31, 32)]
    assert merges(trained(spark, texts, 275)) == library_merges(library_model(texts, 275))


@pytest.mark.parametrize("seed", range(40))
def test_merges_played_in_order_do_what_the_tracing_encoder_records(seed):
    rng = np.random.default_rng(seed)
    kinds, sizes = int(rng.integers(1, 4)), rng.integers(0, 12, 25)
    ids, freq = rng.integers(0, kinds, sizes.sum()), rng.integers(1, 9, 25)
    merges = []
    for made in range(kinds, kinds + int(rng.integers(0, 10))):
        # Some merges respell a token that exists.
        merges.append((*rng.integers(0, made, 2), made if rng.random() < 0.8 else int(rng.integers(0, made))))
    merges = np.array(merges, np.int64).reshape(-1, 3)
    since = int(rng.integers(0, len(merges) + 1))
    trace = Trace(since)
    table = MergeTable(merges[:, 0], merges[:, 1], np.arange(len(merges)), merges[:, 2])
    merge_words(ids.copy(), sizes, table, in_rank_order=True, trace=trace)
    word, step, pair, change = trace.columns()
    *played, touched = play_in_order(ids, sizes, freq, merges, since)
    for ours, theirs in zip(_sums(*played), _sums(step, pair, freq[word] * change)):
        assert ours.tolist() == theirs.tolist()
    assert touched == len(np.unique(word))


def test_training_keeps_nothing_cached(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    trained(spark, [random_text(9)], 300, round_length=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
