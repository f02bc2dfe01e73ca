import random

import pytest
from pyspark.sql import functions as F

from lexigrain.functions import cutting, pretokens as P, symbols as S, text as T
from lexigrain.operators.words import word_types
from reference_rules import UNICODE_TEXTS
from tokenizers import pre_tokenizers


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "text, n, expected",
    [("aé", 2, "a"), ("a€b", 3, "a"), ("😀x", 3, ""), ("😀x", 4, "😀"), ("abc", 2, "ab"), ("abc", 9, "abc"), ("é", 0, "")],
)
def test_utf8_prefix(spark, text, n, expected):
    assert one(spark, text, lambda c: T.utf8_prefix(c, n)) == expected


@pytest.mark.parametrize(
    "literal, size",
    [("1MB", 10**6), ("10 gb", 10**10), ("1B", 1), ("7kb", 7000), ("0MB", None), ("1.5GB", None), ("5TB", None), ("MB", None), ("", None), ("1MB\n", None), ("1\x1cMB", 10**6), ("2\u3000KB", 2000), ("3 \t\x85B", 3)],
)
def test_size_literals(spark, literal, size):
    assert one(spark, literal, T.size_bytes) == size
    if size is None:
        with pytest.raises(ValueError):
            T.parse_size(literal)
    else:
        assert T.parse_size(literal) == size


def test_axis_labels(spark):
    rows = spark.createDataFrame([(0,), (999,), (16_000,), (999_999,), (1_000_000,)], "v int")
    labels = [r[0] for r in rows.select(T.vocab_axis_label(F.col("v"))).collect()]
    assert labels == ["0", "0k", "16k", "999k", "1M"]


@pytest.mark.parametrize("text", UNICODE_TEXTS)
def test_pretokens_equal_the_library(spark, text):
    alphabet = S.byte_alphabet()
    expected = [w for w, _ in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
    got = one(spark, text, P.pretokens)
    assert ["".join(alphabet[b] for b in w.encode()) for w in got] == expected


def test_byte_alphabet_equals_the_library():
    assert set(S.byte_alphabet().values()) == set(pre_tokenizers.ByteLevel.alphabet())
    assert len(S.base_tokens()) == S.BASE_SIZE


@pytest.mark.parametrize("text", [*UNICODE_TEXTS, "", "".join(map(chr, range(256)))])
def test_symbols_round_trip(spark, text):
    letters = one(spark, text, S.to_byte_alphabet)
    alphabet = S.byte_alphabet()
    assert letters == "".join(alphabet[b] for b in text.encode())
    assert one(spark, text, lambda c: S.decode_tokens(F.array(S.to_byte_alphabet(c)))) == text
    ids = {token: i for i, token in enumerate(S.base_tokens())}
    assert one(spark, text, lambda c: S.symbols_to_ids(S.to_symbols(c))) == [ids[c] for c in letters]


def test_decode_replaces_broken_characters_and_drops_specials(spark):
    tokens = spark.createDataFrame([(["[UNK]", "a", "Ã"],)], "t array<string>")
    assert tokens.select(S.decode_tokens(F.col("t"))).first()[0] == "a�"


@pytest.mark.parametrize("token_id", [0, 1, 256, 257, 55_263, 55_264, 65_535, 1_000_000, S.MAX_SYMBOLS - 1])
def test_symbol_ids_cover_the_code_space(spark, token_id):
    char = S.symbol_char(token_id)
    assert S.symbol_id(char) == token_id
    row = spark.createDataFrame([(token_id,)], "i int").select(S.id_to_symbol(F.col("i")).alias("c"))
    assert row.first()[0] == char
    assert row.select(S.symbols_to_ids(F.col("c"))).first()[0] == [token_id]


def test_word_types_skip_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id int, text string")
    assert {tuple(r) for r in word_types(df).collect()} == {("a", 1), (" b", 1), (" a", 1)}


def test_words_cut_on_bytes_are_those_of_the_pattern(spark, monkeypatch):
    monkeypatch.setattr(cutting, "BYTES_AT_ONCE", 200)
    rng = random.Random(5)
    pieces = "' s t re r e ve v m ll l d S 's 1 \u0663 \u00bd ! \u00e9 \u4e2d \U0001d4b3 \U0001f600 \u0301 \u200b [UNK] \u2167 \u180e".split(" ")
    pieces += ["  ", " ", " ", "\n", "\t", "\u00a0", "\u3000", "\u2009", "\x85", "\x1c", "\x00", "a"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(4_000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "it's 12345678 123456789", None]], "text string").where(T.is_nonempty(F.col("text")))
    expected = df.select(F.explode(P.pretokens(F.col("text"))).alias("word"))
    cut = cutting.cut_texts(df.toArrow().column(0).combine_chunks(), cutting.character_classes(spark))
    assert cut.to_pylist() == [r["word"] for r in expected.collect()]
    counts = {r["word"]: r["freq"] for r in word_types(df).collect()}
    assert counts == {r["word"]: r["count"] for r in expected.groupBy("word").count().collect()}
    assert "Generate" not in word_types(df)._jdf.queryExecution().executedPlan().toString()


def test_words_of_malformed_texts_are_those_of_the_pattern(spark):
    df = spark.sql("SELECT CAST(x AS STRING) AS text FROM VALUES (X'61FF62'), (X'E28261'), (X'C328'), (X'EDA080'), (X'206120') t(x)")
    expected = df.select(F.explode(P.pretokens(F.col("text"))).alias("word")).groupBy("word").count()
    assert sorted(map(tuple, word_types(df).collect())) == sorted(map(tuple, expected.collect()))
