import json
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex as TokenizerRegex, Tokenizer, decoders, models, normalizers, pre_tokenizers, trainers

import lexigrain.operators.encoding as E
from lexigrain.operators import eventstore
from lexigrain.operators.joinkernel import merge_events_by_joins
from lexigrain.operators.model import model_from_merges
from lexigrain.functions import bpe
from lexigrain.functions.bpe import WordEncoder
from lexigrain.functions.symbols import SPECIAL_ID, base_tokens, byte_alphabet
from lexigrain.operators.prefixes import measure_prefix, prefix_sweep, size_grid, vocabulary_grid
from lexigrain.operators.scoring import corpus_token_totals, token_totals, tokenizer_report
from lexigrain.sources.tokenizer_files import load_json, load_tables, save_model
from reference_rules import UNICODE_TEXTS, library_model

TEXTS = [*UNICODE_TEXTS, "a[UNK]b", "[UNK]", "x [UNK] y[[UNK]]!! [UNK][UNK]", "   [UNK]", "banana bandana ananas"]


def as_model(spark, library):
    model = json.loads(library.to_str())["model"]
    vocab = model["vocab"]
    tokens = sorted(vocab, key=vocab.get)
    return model_from_merges(spark, [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], tokens)


@pytest.fixture(scope="module")
def library():
    return library_model([t.replace("[UNK]", "") for t in TEXTS] * 2, 400)


@pytest.fixture(scope="module")
def model(spark, library):
    return as_model(spark, library)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc int, text string")


@pytest.fixture(scope="module")
def words(corpus):
    return E.word_table(corpus)


def test_ids_and_counts_equal_the_library(corpus, library, model):
    ids = {r["doc"]: r["ids"] for r in E.document_token_ids(corpus, ["doc"], model).collect()}
    counts = {r["doc"]: r["n_tokens"] for r in E.document_token_counts(corpus, ["doc"], model).collect()}
    for doc, text in enumerate(TEXTS):
        expected = library.encode(text).ids
        assert ids[doc] == expected
        assert counts[doc] == len(expected)


def test_decode_restores_text_without_specials(corpus, model):
    ids = E.document_token_ids(corpus, ["doc"], model)
    texts = {r["doc"]: r["text"] for r in E.decode_documents(ids, ["doc"], model).collect()}
    assert texts == {doc: text.replace("[UNK]", "") for doc, text in enumerate(TEXTS)}


def test_decoding_takes_parts_of_rows_and_replaces_incomplete_characters(spark, model, monkeypatch):
    monkeypatch.setattr(E, "WORDS_AT_ONCE", 3)
    letters = {r["token"]: r["token_id"] for r in model.vocab.collect()}
    alphabet = byte_alphabet()
    spelled = [b"ab", "é€".encode(), b"\xe2\x82", b"x\xffy\xc3", b"", "😀".encode() + b"\xf0\x9f"]
    rows = [(i, [letters[alphabet[b]] for b in data] + [SPECIAL_ID]) for i, data in enumerate(spelled)] + [(6, []), (7, None)]
    ids = spark.createDataFrame(rows, "doc int, ids array<int>").coalesce(1)
    texts = {r["doc"]: r["text"] for r in E.decode_documents(ids, ["doc"], model).collect()}
    assert texts == {i: data.decode("utf-8", "replace") for i, data in enumerate(spelled)} | {6: "", 7: ""}
    data, starts, sizes = E._spellings(model)
    assert sizes[SPECIAL_ID] == 0 and len(data) == sizes.sum() and len(starts) == len(sizes) == model.vocab_size


def test_a_literal_before_many_wide_characters_is_cut_off(spark, library, model):
    text = "[UNK]" + "-😀" * 8000
    corpus = spark.createDataFrame([(0, text)], "doc int, text string")
    assert E.document_token_ids(corpus, ["doc"], model).first()["ids"] == library.encode(text).ids


LAYOUTS = {
    "no special token": {"specials": [], "unk": None, "space": False},
    "two special tokens": {"specials": ["<eot>", "<eot>>"], "unk": "<eot>", "space": False},
    "leading blank": {"specials": ["[UNK]"], "unk": "[UNK]", "space": True},
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_other_base_vocabularies_encode_as_the_library(spark, tmp_path, layout):
    form = LAYOUTS[layout]
    other = Tokenizer(models.BPE(unk_token=form["unk"]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=form["space"])
    other.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(
        vocab_size=330,
        special_tokens=form["specials"],
        initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
        show_progress=False,
    )
    texts = ["the cat<eot> sat on the mat and that is that", "  <eot>><eot>the the", "that[UNK] that", "é <eot>"]
    other.train_from_iterator(texts * 2, trainer)
    path = str(tmp_path / "tokenizer.json")
    other.save(path)
    loaded = load_json(spark, path)
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    ids = {r["doc"]: r["ids"] for r in E.document_token_ids(corpus, ["doc"], loaded).collect()}
    assert ids == {doc: other.encode(text).ids for doc, text in enumerate(texts)}
    totals = corpus_token_totals(corpus, {"a": loaded, "b": loaded}).collect()
    assert {r["token_count"] for r in totals} == {sum(map(len, ids.values()))}
    save_model(loaded, str(tmp_path / "saved"))
    for again in (load_tables(spark, str(tmp_path / "saved")), load_json(spark, str(tmp_path / "saved/tokenizer.json"))):
        assert (again.specials, again.unknown, again.prefix_space) == (loaded.specials, loaded.unknown, loaded.prefix_space)


def test_settings_that_encode_differently_are_refused(spark, tmp_path, library):
    source = json.loads(library.to_str())
    refused = (
        {"normalizer": {"type": "Nmt"}},
        {"pre_tokenizer": {"type": "Whitespace"}},  # words without byte-level spelling
        {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "UnicodeScripts"}, source["pre_tokenizer"]]}},
        {"normalizer": {"type": "Lowercase"}, "added_tokens": [{"id": 0, "content": "[UNK]", "normalized": True}]},
    )
    for change in refused:
        path = tmp_path / "tokenizer.json"
        path.write_text(json.dumps(source | change))
        with pytest.raises(ValueError, match="not supported"):
            load_json(spark, str(path))


def hand_made(spark, pairs):
    """A model from a merge list, and the library's tokenizer for the same list."""
    tokens = base_tokens()
    made = {left + right for left, right in pairs}
    tokens += sorted(made, key=len)
    ids = {t: i for i, t in enumerate(tokens)}
    library = Tokenizer(models.BPE(vocab=ids, merges=pairs, unk_token="[UNK]"))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.decoder = decoders.ByteLevel()
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    return model_from_merges(spark, merges, tokens), library


@pytest.mark.parametrize(
    "pairs",
    [
        # Two merges spell abc.
        [("a", "b"), ("c", "d"), ("ab", "c"), ("b", "c"), ("a", "bc"), ("abc", "cd")],
        # The first merges need tokens that later ones make.
        [("ab", "c"), ("abc", "cd"), ("a", "b"), ("c", "d"), ("b", "c")],
    ],
)
def test_lists_out_of_order_encode_as_the_library(spark, pairs):
    model, library = hand_made(spark, pairs)
    texts = ["abc", "abcd", "abcabcd", "bcabcabcd abccd", "aabbccdd", "xyz", "abcdabcdab abcbc"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    ids = {r["doc"]: r["ids"] for r in E.document_token_ids(corpus, ["doc"], model).collect()}
    assert ids == {doc: library.encode(text).ids for doc, text in enumerate(texts)}


def test_long_word_is_encoded_whole(spark, library, model):
    text = "banana" * 3000 + "an"
    corpus = spark.createDataFrame([(0, text)], "doc int, text string")
    encoded = E.encode_word_types(E.word_table(corpus), model)
    assert encoded.first()["ids"] == library.encode(text).ids


def test_a_long_word_is_quick_with_long_tokens():
    """8,001 bytes against a list whose longest token has 1,024."""
    rules = {"left": [], "right": [], "token": [], "rank": []}
    for rank in range(10):
        last = 65 if rank == 0 else 256 + rank
        for column, value in zip(rules, (last, last, 257 + rank, rank)):
            rules[column].append(value)
    content = {k: np.array(v, np.int32) for k, v in rules.items()}
    content |= {"start": np.tile(np.arange(256), (4, 1)), "specials": {}, "whole": {}}
    started = time.perf_counter()
    merged = WordEncoder(content).encode(pa.array(["A" * 8001]))
    assert time.perf_counter() - started < 1
    ids = merged.ids.tolist()
    assert ids == [266] * 7 + [265, 264, 262, 65] and sum(n.sum() for _, _, n in merged.events) == 8001 - len(ids)


PUBLIC_TEXTS = [*TEXTS, "Straße ΣΊΣΥΦΟΣ İstanbul K", "cafe\u0301 > \u0338 x", "A<|endoftext|>b  <|startoftext|>\n\n c", "we'll WE'LL 1234 ½", ""]


def test_public_tokenizer_with_normalizer_and_word_ends_equals_the_library(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library, model = Tokenizer.from_file(path), load_json(spark, path)
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(PUBLIC_TEXTS)], "doc_id long, text string")
    corpus = documents.unionByName(more)
    ids = {r["doc_id"]: r["ids"] for r in E.document_token_ids(corpus, ["doc_id"], model).collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in E.document_token_counts(corpus, ["doc_id"], model).collect()}
    for row in corpus.where("text <> ''").collect():
        expected = library.encode(row["text"], add_special_tokens=False).ids
        assert ids[row["doc_id"]] == expected and counts[row["doc_id"]] == len(expected)
    total = corpus_token_totals(corpus, {"word": model}).first()["token_count"]
    assert total == sum(counts.values())


SETTINGS = [
    {"pre_tokenizer": pre_tokenizers.Sequence([
        pre_tokenizers.Split(TokenizerRegex(r"(?i:'s|'t)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+"), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])},
    {"pre_tokenizer": pre_tokenizers.Sequence([
        pre_tokenizers.Split(TokenizerRegex(r"(b)(a)|\d"), "removed"), pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)])},
    {"pre_tokenizer": pre_tokenizers.Sequence([
        pre_tokenizers.Split(TokenizerRegex(r"\w+"), "removed", invert=True), pre_tokenizers.Digits(individual_digits=True),
        pre_tokenizers.ByteLevel(add_prefix_space=False)])},
    {"pre_tokenizer": pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Punctuation(), pre_tokenizers.Split("a.", "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])},
    {"normalizer": normalizers.Sequence([normalizers.NFKD(), normalizers.Lowercase()])},
    {"normalizer": normalizers.Sequence([normalizers.Strip(), normalizers.Replace("a", "$1b"), normalizers.Prepend("x ")])},
    {"normalizer": normalizers.Replace(TokenizerRegex(r"\s+"), " "), "literal": {"lstrip": True, "rstrip": True}},
    {"literal": {"rstrip": True}},
]


@pytest.mark.parametrize("number", range(len(SETTINGS)))
def test_file_settings_encode_as_the_library_does(spark, tmp_path, library, number):
    settings = SETTINGS[number]
    other = Tokenizer.from_str(library.to_str())
    if "pre_tokenizer" in settings:
        other.pre_tokenizer = settings["pre_tokenizer"]
    if "normalizer" in settings:
        other.normalizer = settings["normalizer"]
    source = json.loads(other.to_str())
    for entry in source["added_tokens"]:
        entry |= {"normalized": False} | settings.get("literal", {})
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(source))
    other, model = Tokenizer.from_file(str(path)), load_json(spark, str(path))
    corpus = spark.createDataFrame(list(enumerate(PUBLIC_TEXTS)), "doc int, text string")
    save_model(model, str(tmp_path / "saved"))
    for read in (model, load_tables(spark, str(tmp_path / "saved")), load_json(spark, str(tmp_path / "saved/tokenizer.json"))):
        ids = {r["doc"]: r["ids"] for r in E.document_token_ids(corpus, ["doc"], read).collect()}
        for i, text in enumerate(PUBLIC_TEXTS):
            assert ids.get(i, []) == other.encode(text, add_special_tokens=False).ids, text


def test_whole_words_are_not_merged_if_the_file_says_so(spark, tmp_path, library):
    source = json.loads(library.to_str())
    source["model"]["ignore_merges"] = True
    source["model"]["merges"] = source["model"]["merges"][:60]  # later entries can only be met whole
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(source))
    other, model = Tokenizer.from_file(str(path)), load_json(spark, str(path))
    corpus = spark.createDataFrame(list(enumerate(PUBLIC_TEXTS)), "doc int, text string")
    ids = {r["doc"]: r["ids"] for r in E.document_token_ids(corpus, ["doc"], model).collect()}
    assert [ids.get(i, []) for i in range(len(PUBLIC_TEXTS))] == [other.encode(t).ids for t in PUBLIC_TEXTS]


def test_both_ways_of_encoding_count_the_same_merges(spark, words, model):
    flat = {(r["rank"], r["n"]) for r in E.merge_events(words, model).collect()}
    assert {(r["rank"], r["n"]) for r in merge_events_by_joins(words, model).collect()} == flat
    # Rules whose token stands in earlier rules are applied one place at a time.
    tokens = base_tokens()
    ids = {t: i for i, t in enumerate(tokens)}
    a, b, c = (ids[x] for x in "abc")
    n = len(tokens)
    odd = model_from_merges(spark, [(a, b, n), (n, c, n + 1), (b, c, n + 2), (a, n + 2, n + 1), (c, a, n)], [*tokens, "ab", "abc", "bc"])
    text = spark.createDataFrame([("abcabcca bcabca ccaabc acabcab",)], "text string")
    own = E.word_table(text)
    flat = {(r["rank"], r["n"]) for r in E.merge_events(own, odd).collect()}
    assert {(r["rank"], r["n"]) for r in merge_events_by_joins(own, odd).collect()} == flat


def test_stored_events_serve_new_text_and_encode_only_new_words(spark, words, model, tmp_path, monkeypatch):
    encoded = []
    real = eventstore.word_events
    monkeypatch.setattr(eventstore, "word_events", lambda new, m: (encoded.append(new.count()), real(new, m))[1])
    kept = eventstore.EventStore(spark, str(tmp_path), model)
    as_rows = lambda df: {(r["rank"], r["n"]) for r in df.collect()}
    assert as_rows(kept.events(words)) == as_rows(E.merge_events(words, model))
    more = E.word_table(spark.createDataFrame([(t + " unheard-of bananas",) for t in TEXTS], "text string"))
    again = eventstore.EventStore(spark, str(tmp_path), model)
    assert as_rows(again.events(more)) == as_rows(E.merge_events(more, model))
    assert encoded[0] == words.count() and 0 < encoded[1] < 6
    other = eventstore.EventStore(spark, str(tmp_path), model.prefix(300))
    assert other.folder != kept.folder and as_rows(other.events(words)) == as_rows(E.merge_events(words, model.prefix(300)))
    grid = spark.createDataFrame([(300,), (model.vocab_size,)], "vocab_size int")
    curves = [prefix_sweep(more, model, grid, 1, e) for e in (None, again.events(more))]
    assert curves[0].orderBy("vocab_size").collect() == curves[1].orderBy("vocab_size").collect()


def test_unlike_tokenizers_are_scored_in_one_scan(spark, library, model, tmp_path):
    other = Tokenizer.from_str(library.to_str())
    other.normalizer = normalizers.Lowercase()
    source = json.loads(other.to_str())
    source["added_tokens"][0]["normalized"] = False
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(source))
    other, lower = Tokenizer.from_file(str(path)), load_json(spark, str(path))
    corpus = tmp_path / "corpus"
    spark.createDataFrame([(t,) for t in TEXTS], "text string").write.parquet(str(corpus))
    totals = corpus_token_totals(spark.read.parquet(str(corpus)), {"plain": model, "lower": lower, "part": model.prefix(300)})
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    found = {r["name"]: r["token_count"] for r in totals.collect()}
    assert found["plain"] == sum(len(library.encode(t).ids) for t in TEXTS)
    assert found["lower"] == sum(len(other.encode(t).ids) for t in TEXTS)
    assert found["part"] > found["plain"]


def random_rules(draw, letters, n):
    """A merge list in no order: pairs repeat, and different pairs make the same token."""
    known, rules = list(range(letters)), []
    for rank in draw.sample(range(3 * n), n):
        a, b = draw.choice(known), draw.choice(known)
        made = draw.choice(known[letters:]) if len(known) > letters and draw.random() < 0.3 else letters + len(rules)
        known.append(made)
        rules.append((a, b, rank, made))
    return [np.array(c, np.int64) for c in zip(*rules)]


@pytest.mark.parametrize("seed", range(30))
def test_words_merged_together_equal_one_at_a_time(seed):
    draw = random.Random(seed)
    table = bpe.MergeTable(*random_rules(draw, 3, draw.choice((1, 4, 12, 40))))
    words = [[draw.randrange(3) for _ in range(draw.choice((0, 1, 2, 5, 9, 30)))] for _ in range(60)]
    merged = bpe.merge_words(np.array(sum(words, []), np.int64), np.array([len(w) for w in words]), table)
    per_word = {}
    for word, rank, n in merged.events:
        for w, r, k in zip(word.tolist(), rank.tolist(), n.tolist()):
            per_word.setdefault(w, []).extend([r] * k)
    at = 0
    for i, word in enumerate(words):
        ids, ranks = bpe.merge_long_word(list(word), table)
        assert merged.ids[at : at + merged.sizes[i]].tolist() == ids and per_word.get(i, []) == ranks
        at += merged.sizes[i]


@pytest.mark.parametrize("seed", range(30))
def test_merging_in_rank_order_equals_replacing_step_by_step(seed):
    draw = random.Random(seed)
    left, right, rank, made = random_rules(draw, 3, draw.choice((1, 4, 12, 40)))
    words = [[draw.randrange(3) for _ in range(draw.choice((0, 1, 2, 5, 9, 30)))] for _ in range(40)]
    since = int(np.median(rank))
    trace = bpe.Trace(since)
    table = bpe.MergeTable(left, right, rank, made)
    merged = bpe.merge_words(np.array(sum(words, []), np.int64), np.array([len(w) for w in words]), table, True, trace)
    expected = Counter()
    at = 0
    for i, word in enumerate(words):
        text = list(word)
        for step in np.argsort(rank):
            before = Counter(zip(text, text[1:]))
            out, j = [], 0
            while j < len(text):
                if j + 1 < len(text) and (text[j], text[j + 1]) == (left[step], right[step]):
                    out.append(int(made[step]))
                    j += 2
                else:
                    out.append(text[j])
                    j += 1
            if rank[step] >= since and out != text:
                after = Counter(zip(out, out[1:]))
                for pair in before.keys() | after.keys():
                    if after[pair] != before[pair]:
                        expected[i, int(rank[step]), pair[0] << 32 | pair[1]] += after[pair] - before[pair]
            text = out
        assert merged.ids[at : at + merged.sizes[i]].tolist() == text
        at += merged.sizes[i]
    got = Counter()
    for word, step, pair, change in zip(*(c.tolist() for c in trace.columns())):
        got[word, step, pair] += change
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in expected.items() if v}


def test_sweep_equals_prefix_models_and_the_library(spark, words, model, library):
    sizes = [257, 270, 301, 355, model.vocab_size]
    grid = words.sparkSession.createDataFrame([(s,) for s in sizes], "vocab_size int")
    sweep = {r["vocab_size"]: r["token_count"] for r in prefix_sweep(words, model, grid, 1).collect()}
    assert list(sweep.values()) == sorted(sweep.values(), reverse=True)
    for size in (257, 301):
        assert measure_prefix(words, model, size, 1).first()["token_count"] == sweep[size]
    every = size_grid(spark, 257, model.vocab_size, 1)
    all_points = {r["vocab_size"]: r["token_count"] for r in prefix_sweep(words, model, every, 1).collect()}
    assert len(all_points) == model.vocab_size - 256
    assert {size: all_points[size] for size in sizes} == sweep
    assert sweep[model.vocab_size] == sum(len(library.encode(t).ids) for t in TEXTS)
    source = json.loads(library.to_str())
    source["model"]["vocab"] = {t: i for t, i in source["model"]["vocab"].items() if i < 301}
    source["model"]["merges"] = source["model"]["merges"][: 301 - 257]
    cut = Tokenizer.from_str(json.dumps(source))
    assert sweep[301] == sum(len(cut.encode(t).ids) for t in TEXTS)


def test_comparison_report(words, model):
    models = {"full": model, "bytes": model.prefix(257)}
    report = {r["name"]: r for r in tokenizer_report(token_totals(words, models), models, 1000).collect()}
    assert report["bytes"]["fixed_id_bits_per_token"] == 9
    full = report["full"]
    assert full["bytes_per_token"] == 1000 / full["token_count"]
    assert full["fixed_id_compression_ratio"] == 8000 / (full["token_count"] * 9)
    with pytest.raises(ValueError):
        token_totals(words, {})


def test_fixed_width_bits(spark):
    from lexigrain.operators.scoring import id_bits

    sizes = [1, 2, 3, 32_000, 32_768, 32_769, 1_000_000]
    rows = spark.createDataFrame([(s,) for s in sizes], "v int").select(id_bits(F.col("v"))).collect()
    assert [r[0] for r in rows] == [1, 1, 2, 15, 15, 16, 20]


def test_grids(spark, model):
    def grid(base, full, step):
        return sorted(r[0] for r in size_grid(spark, base, full, step).collect())

    assert len(grid(257, 1_000_000, 16_000)) == 63
    assert grid(257, 300, 500) == [300]
    assert grid(257, 300, 20) == [257, 277, 297, 300]
    assert vocabulary_grid(model, 1000).count() == 1
    with pytest.raises(ValueError):
        grid(257, 300, 0)


def test_prefix_bounds(spark, model):
    for size in (256, model.vocab_size + 1):
        with pytest.raises(ValueError):
            model.prefix(size)
    holes = type(model)(model.vocab.withColumn("token_id", F.col("token_id") * 2), model.merges)
    with pytest.raises(ValueError):
        holes.prefix(300)


def test_documents_are_encoded_in_parts_of_bounded_size(spark, monkeypatch):
    from lexigrain.operators.training import train_bpe

    corpus = spark.createDataFrame([(i, f"ab cd{i} " * (i % 7) + "x") for i in range(40)], "doc_id long, text string")
    model = train_bpe(E.word_types(corpus), 270)
    whole = {r.doc_id: r.ids for r in E.document_token_ids(corpus, ["doc_id"], model).collect()}
    lists = pa.array([["ab"] * n for n in (3, 0, 9, 1, 1)] + [None, ["cd"]])
    monkeypatch.setattr(E, "WORDS_AT_ONCE", 4)
    parts = [p.column(0).to_pylist() for p in E._parts(pa.record_batch([lists], ["words"]), 0)]
    assert sum(parts, []) == lists.to_pylist() and all(len(p) == 1 or sum(len(w or ()) for w in p) <= 4 for p in parts)
    assert {r.doc_id: r.ids for r in E.document_token_ids(corpus, ["doc_id"], model).collect()} == whole
    counts = {r.doc_id: r.n_tokens for r in E.document_token_counts(corpus, ["doc_id"], model).collect()}
    assert counts == {i: len(ids) for i, ids in whole.items()}
