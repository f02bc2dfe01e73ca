"""Registered queries against DuckDB on the smallest tables; ``compare.py`` runs all of them."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tokenizers import Tokenizer

from lexigrain.checks import queries
from lexigrain.checks.queries import QUERIES
from lexigrain.sources.tokenizer_files import export_json
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "corpus_stats utf8_truncate size_parse tokenizer_select byte_budget_prefix_turns byte_budget_prefix_scaled "
    "heldout_slice progress_marks shortfall_check word_type_counts bpe_train_exact doc_token_ids byte_decode "
    "tokenizer_comparison prefix_sweep parity_check"
).split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def test_every_query_has_a_statement():
    # Models of thousands of merges and a public tokenizer are compared with the library or a second kernel.
    assert set(QUERIES) - set(entry.oracle_sql()) == {"prefix_sweep_large", "parity_large", "word_tokenizer_counts"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["word", "freq"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_duckdb(spark, name):
    assert difference(spark, connect(FOLDER), name, FOLDER) is None


def test_the_whole_large_curve_equals_the_library_and_the_second_kernel(spark, tmp_path):
    rows = {r["vocab_size"]: r for r in QUERIES["parity_large"](spark, FOLDER).collect()}
    model = queries._large(spark, FOLDER)
    assert len(rows) > 250 and max(rows) == model.vocab_size > 4_096 + 257 and all(r["equal"] for r in rows.values())
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for size in (*sorted(rows)[1::90], model.vocab_size):
        path = str(tmp_path / f"{size}.json")
        export_json(model.prefix(size), path)
        library = Tokenizer.from_file(path)
        assert rows[size]["token_count"] == sum(len(e.ids) for e in library.encode_batch(texts))
    points = {r["vocab_size"] for r in QUERIES["prefix_sweep_large"](spark, FOLDER).collect()}
    assert points == set(rows)
