import json

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigrain.operators.selection import (
    parse_tokenizer_spec,
    parse_tokenizer_specs,
    select_tokenizers,
)
from lexigrain.operators.slicing import OrderedCorpus
from lexigrain.operators.training import train_bpe
from lexigrain.operators.words import word_types
from lexigrain.plans.runs import compression_run, evaluate_run, train_run
from lexigrain.sources import heldout, reports
from lexigrain.sources.corpus import read_corpus
from lexigrain.sources.tokenizer_files import load_json, load_tables, save_model
from lexigrain.storage import require_empty_directory
from reference_rules import library_merges, library_model

TEXTS = [f"document {i}: the quick brown fox, it's {i * 7} times “über” the lazy dog 😀" for i in range(40)]


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "docs")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, text string")
    df.withColumn("split", F.when(F.col("doc") < 35, "train").otherwise("test")).write.partitionBy(
        "split"
    ).parquet(path)
    return path


def test_text_column_checks(spark, dataset):
    with pytest.raises(ValueError, match="missing; columns: doc, text, split"):
        read_corpus(spark, dataset, ["doc"], text_column="body")
    with pytest.raises(ValueError, match="holds int"):
        read_corpus(spark, dataset, ["doc"], text_column="doc")
    with pytest.raises(ValueError):
        read_corpus(spark, dataset, ["nowhere"])
    with pytest.raises(ValueError):
        read_corpus(spark, dataset, ["doc"], config="en")


def test_split_selects_a_partition_and_rows_have_an_order(spark, dataset):
    df = read_corpus(spark, dataset, ["doc"], split="test")
    assert {r["doc"] for r in df.collect()} == set(range(35, 40))
    stream = read_corpus(spark, dataset)
    assert stream.columns == ["file_path", "row_index", "text"]
    assert stream.select("file_path", "row_index").distinct().count() == len(TEXTS)


def test_other_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a, b"), (2, "é")], "doc int, text string")
    for fmt, options in (("json", {}), ("csv", {"header": "true", "inferSchema": "true"}), ("orc", {})):
        path = str(tmp_path / fmt)
        rows.write.format(fmt).options(**options).save(path)
        got = read_corpus(spark, path, ["doc"], fmt=fmt, **options)
        assert {(r["doc"], r["text"]) for r in got.collect()} == {(1, "a, b"), (2, "é")}
    with pytest.raises(ValueError, match="unknown corpus format"):
        read_corpus(spark, str(tmp_path / "json"), fmt="avro")
    # A corpus without splits is its train split and no other.
    assert read_corpus(spark, str(tmp_path / "json"), ["doc"], fmt="json", split="train").count() == 2
    with pytest.raises(ValueError, match="split"):
        read_corpus(spark, str(tmp_path / "json"), ["doc"], fmt="json", split="test")


def test_model_files(spark, tmp_path):
    corpus = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    model = train_bpe(word_types(corpus), 330)
    folder = str(tmp_path / "model")
    save_model(model, folder)
    expected = sorted(tuple(r) for r in model.merges.collect())
    assert sorted(tuple(r) for r in load_tables(spark, folder).merges.collect()) == expected
    loaded = load_json(spark, f"{folder}/tokenizer.json")
    assert sorted(tuple(r) for r in loaded.merges.collect()) == expected
    library, ours = library_model(TEXTS, 330), Tokenizer.from_file(f"{folder}/tokenizer.json")
    assert library_merges(library) == library_merges(ours)
    for text in [*TEXTS, "a[UNK]b ünseen ✓"]:
        assert library.encode(text).ids == ours.encode(text).ids
        assert ours.decode(library.encode(text).ids) == library.decode(library.encode(text).ids)


def test_model_file_errors_and_old_merge_layout(spark, tmp_path):
    library = library_model(TEXTS, 300)
    source = json.loads(library.to_str())

    def write(name, change):
        data = json.loads(json.dumps(source))
        change(data["model"])
        path = tmp_path / name
        path.write_text(json.dumps(data), encoding="utf-8")
        return str(path)

    old = write("old.json", lambda m: m.update(merges=[" ".join(p) for p in m["merges"]]))
    assert [(r["left"], r["right"]) for r in load_json(spark, old).merges.orderBy("rank").collect()] == library_merges(library)
    for name, change in (
        ("type.json", lambda m: m.update(type="WordPiece")),
        ("vocab.json", lambda m: m.update(vocab=[1, 2])),
        ("merges.json", lambda m: m.update(merges={})),
        ("token.json", lambda m: m["merges"].append(["zz", "qq"])),
    ):
        with pytest.raises(ValueError):
            load_json(spark, write(name, change))
    with pytest.raises(ValueError):
        load_json(spark, str(tmp_path / "absent.json"))


def test_output_guards(spark, tmp_path):
    require_empty_directory(spark, str(tmp_path / "new"))
    require_empty_directory(spark, str(tmp_path))
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError, match="holds files"):
        require_empty_directory(spark, str(tmp_path))
    with pytest.raises(ValueError, match="is a file"):
        require_empty_directory(spark, str(tmp_path / "file"))
    with pytest.raises(ValueError, match="something at"):
        reports.write_summary(spark, {}, str(tmp_path / "file"))


def test_legacy_cache_is_migrated(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "heldout.jsonl").write_text('"a \\"q\\" é"\n"b\\n"\n', encoding="utf-8")
    (tmp_path / "heldout_meta.json").write_text('{"format": "old", "cached_documents": 2}')
    metadata = heldout.prepare_heldout(None, spark, folder, 0, 1)
    assert metadata.pop("text_path").startswith(folder)
    assert metadata == {"format": "jsonl-text-v1", "cached_documents": 2}
    assert not (tmp_path / "heldout.jsonl").exists()
    assert {r["text"] for r in heldout.open_heldout(spark, folder)[0].collect()} == {'a "q" é', "b\n"}


@pytest.mark.parametrize("line", ["12", "null", '{"text": "a"}', '"open', ""])
def test_bad_legacy_lines(spark, tmp_path, line):
    (tmp_path / "heldout.jsonl").write_text(f'"good"\n{line}\n"x"\n')
    (tmp_path / "heldout_meta.json").write_text('{"format": "old"}')
    with pytest.raises(ValueError, match="single JSON string"):
        heldout.prepare_heldout(None, spark, str(tmp_path), 0, 1)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", range(8))
def test_a_cache_is_valid_whatever_step_its_migration_stops_at(spark, tmp_path, monkeypatch, step):
    """Every file operation of a migration is made to fail in turn, before and after it happens."""
    (tmp_path / "heldout.jsonl").write_text('"a"\n"b"\n', encoding="utf-8")
    (tmp_path / "heldout_meta.json").write_text('{"format": "old"}')
    folder, made = str(tmp_path), 0

    def stopping(module, name):
        real = getattr(module, name)

        def run(*args, **options):
            nonlocal made
            for before in (True, False):
                if made == step:
                    raise Stopped
                made += 1
                if before:
                    result = real(*args, **options)
            return result

        monkeypatch.setattr(module, name, run)

    for name in ("legacy_texts", "write_summary", "replace_file", "remove"):
        stopping(heldout, name)
    with pytest.raises(Stopped):
        heldout.migrate(spark, folder, {"format": "old"})
    monkeypatch.undo()
    assert heldout.is_cached(spark, folder)
    heldout.prepare_heldout(None, spark, folder, 0, 1)  # migrates if the old cache is still the one in place
    texts, metadata = heldout.open_heldout(spark, folder)
    assert sorted(r["text"] for r in texts.collect()) == ["a", "b"] and metadata["format"] == "jsonl-text-v1"


def test_a_cache_that_was_not_finished_is_prepared_anew(spark, tmp_path, monkeypatch):
    corpus = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc int, text string")
    opened = lambda: OrderedCorpus(corpus, ["doc"])

    def stop(*_):
        raise Stopped

    monkeypatch.setattr(heldout, "publish", stop)
    with pytest.raises(Stopped):
        heldout.prepare_heldout(opened, spark, str(tmp_path), 12, 18)
    monkeypatch.undo()
    assert not heldout.is_cached(spark, str(tmp_path))
    heldout.prepare_heldout(opened, spark, str(tmp_path), 12, 18)
    moved = tmp_path.parent / f"{tmp_path.name}-moved"
    tmp_path.rename(moved)  # texts are found beside the metadata
    rows = heldout.read_ordered_texts(spark, str(moved)).orderBy("doc").collect()
    assert [(r["doc"], r["text"]) for r in rows] == [(2, "text 2"), (3, "text 3"), (4, "text 4")]


@pytest.mark.parametrize("fmt", ["json", "csv", "text", "orc"])
def test_rows_without_an_order_column_stand_in_file_order(spark, tmp_path, monkeypatch, fmt):
    texts = [f"line {i} of a corpus in files" for i in range(400)]
    path = tmp_path / "corpus"
    path.mkdir()
    if fmt == "orc":
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("overwrite").orc(str(path))
    else:
        for part in range(2):
            own = texts[200 * part : 200 * part + 200]
            lines = {"json": [json.dumps({"text": t}) for t in own], "csv": ["text", *own], "text": own}[fmt]
            (path / f"part-{part}").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several blocks to a file
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        options = {"header": "true"} if fmt == "csv" else {}
        corpus = read_corpus(spark, str(path), fmt=fmt, **options)
        order = [c for c in corpus.columns if c != "text"]
        assert [r["text"] for r in corpus.orderBy(*order).collect()] == texts
        size = sum(len(t) for t in texts[:150])
        ordered = OrderedCorpus(corpus, order)
        first, position = ordered.take(size)
        second, _ = ordered.take(size, position)
        assert {r["text"] for r in first.collect()} == set(texts[:150])
        start = {r["text"] for r in second.collect()}
        assert not start & set(texts[:150]) and texts[150] in start
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_partial_cache_is_an_error(spark, tmp_path):
    (tmp_path / "heldout_meta.json").write_text("{}")
    with pytest.raises(ValueError, match="incomplete"):
        heldout.prepare_heldout(None, spark, str(tmp_path), 0, 1)


def test_selection(spark):
    assert parse_tokenizer_spec("a=b=c") == ("a", "b=c")
    for bad in ("a", "=b", "a="):
        with pytest.raises(ValueError):
            parse_tokenizer_spec(bad)
    with pytest.raises(ValueError):
        parse_tokenizer_specs(["a=x", "a=y"])
    registry = spark.createDataFrame([("32k", "/p"), ("1m", "/q")], "name string, path string")
    assert select_tokenizers(registry, " 1m ,, 32k") == {"1m": "/q", "32k": "/p"}
    for bad, message in (("", "at least one"), ("z,32k,y", "y, z"), ("1m,1m", "once")):
        with pytest.raises(ValueError, match=message):
            select_tokenizers(registry, bad)


def test_three_runs(spark, dataset, tmp_path):
    total = sum(len(t.encode()) for t in TEXTS)
    size = total // 2
    model_dir, eval_dir = str(tmp_path / "model"), str(tmp_path / "eval")
    run = train_run(spark, dataset, size, 300, model_dir, ["doc"])
    assert run["vocab_size_actual"] == 300 and size - 3 <= run["bytes_used"] <= size
    assert json.loads((tmp_path / "model" / "run.json").read_text())["documents_used"] == run["documents_used"]
    with pytest.raises(ValueError, match="holds files"):
        train_run(spark, dataset, size, 300, model_dir, ["doc"])

    source = f"{model_dir}/tokenizer.json"
    result = evaluate_run(spark, {"32k": source}, dataset, eval_dir, size, total // 4, ["doc"], layout=str(tmp_path / "layout"))
    corpus = OrderedCorpus(read_corpus(spark, dataset, ["doc"]), ["doc"])
    metadata = heldout.prepare_heldout(lambda: corpus, spark, eval_dir, size, total // 4)
    texts = [r["text"] for r in heldout.read_texts(spark, eval_dir).collect()]
    library = Tokenizer.from_file(source)
    expected = sum(len(library.encode(t).ids) for t in texts)
    assert result["tokenizers"]["32k"]["token_count"] == expected
    assert metadata["cached_utf8_bytes"] == result["evaluated_utf8_bytes"] == sum(len(t.encode()) for t in texts)
    assert heldout.prepare_heldout(None, spark, eval_dir, size, total // 4) == metadata

    summary = compression_run(spark, source, eval_dir, f"{eval_dir}/compression.json", 20)
    assert [p["vocab_size"] for p in summary["points"]] == [257, 277, 297, 300]
    assert summary["points"][-1]["token_count"] == expected
    assert summary["parity"] is None
    for again in range(2):  # with stored merges, made by the first of the two
        other = compression_run(spark, source, eval_dir, f"{eval_dir}/again{again}.json", 20, str(tmp_path / "events"))
        assert [p["token_count"] for p in other["points"]] == [p["token_count"] for p in summary["points"]]
    points = reports.read_points(spark, f"{eval_dir}/compression.json")
    assert [p.asDict() for p in points.collect()] == summary["points"]
    reports.write_points_csv(points, f"{eval_dir}/points.csv")
    lines = [r[0] for r in spark.read.text(f"{eval_dir}/points.csv").collect()]
    assert lines[0] == "vocab_size,token_count,bytes_per_token,tokens_per_byte,seconds"
    assert len(lines) == 5
    (tmp_path / "empty.json").write_text('{"points": []}')
    with pytest.raises(ValueError):
        reports.read_points(spark, str(tmp_path / "empty.json"))
    with pytest.raises(ValueError, match="before the requested"):
        evaluate_run(spark, {"a": source}, dataset, str(tmp_path / "e2"), size, total, ["doc"])
    with pytest.raises(ValueError, match="no file"):
        evaluate_run(spark, {"a": "/nowhere"}, dataset, str(tmp_path / "e3"), 0, 1, ["doc"])


def test_parity(spark):
    from lexigrain.operators.prefixes import require_parity

    schema = "vocab_size int, token_count bigint"
    points = spark.createDataFrame([(300, 10), (310, 8)], schema)
    rows = require_parity(points, spark.createDataFrame([(310, 8)], schema)).collect()
    assert {(r["vocab_size"], r["equal"]) for r in rows} == {(300, None), (310, True)}
    with pytest.raises(ValueError, match="310"):
        require_parity(points, spark.createDataFrame([(310, 9)], schema))
