"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrain.functions.pretokens import encoding_pretokens, pretokens
from lexigrain.functions.symbols import SPECIAL_ID, SPECIAL_TOKEN, symbols_to_ids, to_byte_alphabet
from lexigrain.functions.text import (
    is_nonempty,
    size_bytes,
    utf8_bytes,
    utf8_prefix,
    vocab_axis_label,
)
from lexigrain.operators.encoding import (
    decode_documents,
    document_token_counts,
    document_token_ids,
    encode_word_types,
    word_table,
)
from lexigrain.operators.joinkernel import merge_events_by_joins
from lexigrain.operators.model import BASE_SIZE, PLAIN, BpeModel, base_vocabulary
from lexigrain.operators.prefixes import (
    measure_prefix,
    parity,
    prefix_sweep,
    require_parity,
    size_grid,
    sweep_summary,
    vocabulary_grid,
)
from lexigrain.operators.scoring import tokenizer_report, token_totals, with_ratios
from lexigrain.operators.selection import resolve_names
from lexigrain.operators.slicing import (
    OrderedCorpus,
    byte_budget_prefix,
    corpus_stats,
    heldout_slice,
    progress_marks,
    read_stats,
    shortfall_report,
)
from lexigrain.operators.training import pair_counts, symbol_words, train_bpe
from lexigrain.operators.words import word_types
from lexigrain.sources.corpus import read_corpus
from lexigrain.sources.heldout import (
    legacy_texts,
    meta_path,
    migrate,
    open_heldout,
    prepare_heldout,
    text_path,
    write_texts,
)
from lexigrain.sources.reports import read_points, write_points_csv, write_summary
from lexigrain.sources.tokenizer_files import export_json, load_json, load_tables, parse_json, save_model
from lexigrain.storage import checkpoint_root

SMALL_VOCAB = BASE_SIZE + 8
VOCAB = 320
LARGE_VOCAB = BASE_SIZE + 4_200
GRID_STEP = 16
TURN_KEYS = ["conv_id", "turn"]

_models: dict[tuple[str, str], BpeModel] = {}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_corpus(spark, f"{sf}/documents.parquet", ["doc_id"])


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return read_corpus(spark, f"{sf}/conversations.parquet", TURN_KEYS)


def ordered_documents(spark: SparkSession, sf: str) -> OrderedCorpus:
    return OrderedCorpus(documents(spark, sf), ["doc_id"])


def ordered_turns(spark: SparkSession, sf: str) -> OrderedCorpus:
    """Turns in about eight ranges, so that the prefix sum of any corpus spans several of them."""
    turns = conversations(spark, sf)
    return OrderedCorpus(turns, TURN_KEYS, rows_per_range=max(1, turns.count() // 8))


def share(total: int, percent: int) -> int:
    """A byte budget that grows with the corpus."""
    return total * percent // 100


def trained(spark: SparkSession, sf: str) -> BpeModel:
    """The model trained on all documents; later queries of a session reuse it like a saved file."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        _models[key] = train_bpe(word_types(documents(spark, sf)), VOCAB)
    return _models[key]


def merges_of(model: BpeModel) -> DataFrame:
    return model.merges.select("rank", "left", "right", "token", "token_id")


def joined(ids) -> F.Column:
    return F.array_join(ids.cast("array<string>"), " ")


# --- corpus and text -------------------------------------------------------------------------


def corpus_scan(spark, sf):
    return documents(spark, sf)


def corpus_stats_query(spark, sf):
    return corpus_stats(documents(spark, sf))


def nonempty_docs(spark, sf):
    """Documents that hold an e-mail address: the extract is empty for all others."""
    address = F.regexp_extract("text", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", 0)
    return documents(spark, sf).select("doc_id", address.alias("text")).where(is_nonempty(F.col("text")))


def utf8_bytes_query(spark, sf):
    return documents(spark, sf).select("doc_id", utf8_bytes(F.col("text")).alias("n_bytes"))


def utf8_truncate(spark, sf):
    half = F.floor(F.octet_length("text") / 2)
    return documents(spark, sf).select("doc_id", utf8_prefix(F.col("text"), half).alias("text"))


def size_parse(spark, sf):
    """Size literals made from every document's length, good and bad spellings alike."""
    n = F.col("n_chars").cast("string")
    spellings = F.array(
        F.concat(n, F.lit("B")), F.concat(n, F.lit(" kb")), F.concat(n, F.lit("mb")),
        F.concat(n, F.lit("  GB")), F.concat(F.lit("0"), n, F.lit("MB")),
        F.concat(n, F.lit(".5GB")), F.concat(n, F.lit("TB")), n,
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.explode(spellings).alias("literal"))
    return docs.select("doc_id", "literal", size_bytes(F.col("literal")).alias("n_bytes"))


def tokenizer_select(spark, sf):
    """Every source asks for its own name, a shared name and a name nobody registered."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    registry = docs.select(F.col("lang").alias("name")).distinct().withColumn(
        "path", F.concat(F.lit("/models/"), "name", F.lit("/tokenizer.json"))
    )
    requests = docs.select(
        F.concat(F.lit(" "), "lang", F.lit(" ,, "), "source", F.lit(",")).alias("names")
    )
    return resolve_names(requests, registry)


def byte_budget_prefix_query(spark, sf):
    corpus = ordered_documents(spark, sf)
    return byte_budget_prefix(corpus, share(corpus.total_bytes, 60))


def byte_budget_prefix_scaled(spark, sf):
    """The prefix sum itself, over a corpus ordered by two columns."""
    return ordered_turns(spark, sf).running_totals()


def byte_budget_prefix_turns(spark, sf):
    corpus = ordered_turns(spark, sf)
    return byte_budget_prefix(corpus, share(corpus.total_bytes, 35))


def heldout_slice_query(spark, sf):
    corpus = ordered_documents(spark, sf)
    total = corpus.total_bytes
    return heldout_slice(corpus, share(total, 60), share(total, 20))


def progress_marks_query(spark, sf):
    corpus = ordered_documents(spark, sf)
    total = corpus.total_bytes
    return progress_marks(corpus, share(total, 60), share(total, 2))


def shortfall_check(spark, sf):
    corpus = ordered_documents(spark, sf)
    reports = None
    for percent in (50, 150):
        requested = share(corpus.total_bytes, percent)
        row = shortfall_report(corpus_stats(corpus.take(requested)[0]), requested)
        reports = row if reports is None else reports.unionByName(row)
    return reports


def heldout_cache(spark, sf):
    """The held-out slice after writing and reading its JSON-lines cache."""
    corpus = ordered_documents(spark, sf)
    total = corpus.total_bytes
    path = f"{checkpoint_root(spark)}/heldout-{_fresh()}"
    write_texts(heldout_slice(corpus, share(total, 60), share(total, 20)), ["doc_id"], path)
    return spark.read.schema("text string").json(path)


def heldout_legacy(spark, sf):
    """Conversation turns written as bare JSON strings and read through the migration."""
    lines = conversations(spark, sf).select(F.to_json(F.struct("text")).alias("value")).select(
        F.expr("substr(value, 9, char_length(value) - 9)").alias("value")
    )
    return legacy_texts(lines)


def _fresh() -> str:
    import uuid

    return uuid.uuid4().hex


# --- tokens ------------------------------------------------------------------------------------


def pretokenize(spark, sf):
    words = pretokens(F.col("text"))
    return documents(spark, sf).select(
        "doc_id", F.size(words).alias("n_words"), F.array_join(words, "|").alias("words")
    )


def pretokenize_pages(spark, sf):
    pages = read_corpus(spark, f"{sf}/pages.parquet", ["page_id"], "html")
    words = pretokens(F.col("html"))
    return pages.select(
        "page_id", F.size(words).alias("n_words"), F.array_join(words, "|").alias("words")
    )


def byte_alphabet_query(spark, sf):
    return word_types(documents(spark, sf)).select(
        "word", to_byte_alphabet(F.col("word")).alias("letters")
    )


def word_type_counts(spark, sf):
    return word_types(documents(spark, sf))


def base_vocabulary_query(spark, sf):
    """Every entry of the base vocabulary with its frequency before any merge."""
    symbols = symbol_words(word_types(documents(spark, sf)))
    counts = (
        symbols.select(F.explode(symbols_to_ids(F.col("s"))).alias("token_id"), "freq")
        .groupBy("token_id")
        .agg(F.sum("freq").alias("n"))
    )
    return base_vocabulary(spark).join(counts, "token_id", "left").select(
        "token_id", "token", F.coalesce("n", F.lit(0)).alias("n")
    )


def pair_counts_query(spark, sf):
    ids = symbols_to_ids(F.col("pair"))
    return pair_counts(symbol_words(word_types(documents(spark, sf)))).select(
        ids[0].alias("left_id"), ids[1].alias("right_id"), "n"
    )


def bpe_train_small(spark, sf):
    return merges_of(train_bpe(word_types(documents(spark, sf)), SMALL_VOCAB))


def bpe_train_exact(spark, sf):
    return merges_of(train_bpe(word_types(documents(spark, sf)), VOCAB))


def vocab_size(spark, sf):
    model = trained(spark, sf)
    return model.vocab.agg(F.count("*").alias("vocab_size"))


def tokenizer_files(spark, sf):
    """The model after saving it, as tables and as one JSON document, and loading both."""
    folder = f"{checkpoint_root(spark)}/model-{_fresh()}"
    save_model(trained(spark, sf), folder)
    from_json = merges_of(load_json(spark, f"{folder}/tokenizer.json"))
    tables = load_tables(spark, folder).merges.select("rank", F.col("token_id").alias("table_id"))
    return from_json.join(tables, "rank")


def bpe_encode_words(spark, sf):
    encoded = encode_word_types(word_table(conversations(spark, sf)), trained(spark, sf))
    return encoded.select(
        "word", "freq", "n_tokens", joined(F.col("ids")).alias("ids")
    )


def doc_token_counts(spark, sf):
    return document_token_counts(documents(spark, sf), ["doc_id"], trained(spark, sf))


def _turn_ids(spark, sf):
    return document_token_ids(conversations(spark, sf), TURN_KEYS, trained(spark, sf))


def doc_token_ids(spark, sf):
    return _turn_ids(spark, sf).select(*TURN_KEYS, joined(F.col("ids")).alias("ids"))


def byte_decode(spark, sf):
    return decode_documents(_turn_ids(spark, sf), TURN_KEYS, trained(spark, sf))


# --- scores --------------------------------------------------------------------------------------


def token_totals_query(spark, sf):
    return token_totals(word_table(conversations(spark, sf)), {"full": trained(spark, sf)})


def _candidates(spark, sf) -> dict[str, BpeModel]:
    model = trained(spark, sf)
    return {"bytes": model.prefix(BASE_SIZE), "small": model.prefix(SMALL_VOCAB), "full": model}


def tokenizer_comparison(spark, sf):
    corpus = conversations(spark, sf)
    models = _candidates(spark, sf)
    used = read_stats(corpus).bytes_used
    return tokenizer_report(token_totals(word_table(corpus), models), models, used).drop("tokenizer_path")


def compression_ratios(spark, sf):
    corpus = documents(spark, sf)
    totals = token_totals(word_table(corpus), {"full": trained(spark, sf)})
    return with_ratios(totals, F.lit(read_stats(corpus).bytes_used))


def fixed_id_stats(spark, sf):
    return tokenizer_comparison(spark, sf).select(
        "name",
        "vocab_size",
        "fixed_id_bits_per_token",
        "fixed_id_bits_per_byte",
        "fixed_id_compression_ratio",
    )


# --- prefixes --------------------------------------------------------------------------------------


def vocab_grid(spark, sf):
    return vocabulary_grid(trained(spark, sf), GRID_STEP)


def merge_prefix(spark, sf):
    return merges_of(trained(spark, sf).prefix(SMALL_VOCAB))


def _points(spark, sf):
    corpus, model = conversations(spark, sf), trained(spark, sf)
    grid = vocabulary_grid(model, GRID_STEP)
    return prefix_sweep(word_table(corpus), model, grid, read_stats(corpus).bytes_used)


def prefix_point(spark, sf):
    corpus = conversations(spark, sf)
    used = read_stats(corpus).bytes_used
    return measure_prefix(word_table(corpus), trained(spark, sf), 304, used)


def prefix_sweep_query(spark, sf):
    return _points(spark, sf)


def prefix_sweep_documents(spark, sf):
    corpus, model = documents(spark, sf), trained(spark, sf)
    grid = vocabulary_grid(model, GRID_STEP)
    return prefix_sweep(word_table(corpus), model, grid, read_stats(corpus).bytes_used)


def sweep_summary_query(spark, sf):
    """The summary row with its points flattened to one text per row."""
    row = sweep_summary(_points(spark, sf), corpus_stats(conversations(spark, sf)))
    point = lambda p: F.concat_ws(":", p["vocab_size"], p["token_count"])
    return row.select(
        "evaluated_utf8_bytes",
        "evaluated_documents",
        F.array_join(F.transform("points", point), " ").alias("points"),
    )


def parity_check(spark, sf):
    """The sweep against the second way of encoding, which joins words with a prefix of the merge list."""
    corpus = conversations(spark, sf)
    words, part = word_table(corpus), trained(spark, sf).prefix(304)
    size = spark.createDataFrame([(304,)], "vocab_size int")
    joined_point = prefix_sweep(words, part, size, read_stats(corpus).bytes_used, merge_events_by_joins(words, part))
    return parity(_points(spark, sf), joined_point)


def points_csv(spark, sf):
    """The sweep after writing and reading its CSV export."""
    path = f"{checkpoint_root(spark)}/points-{_fresh()}"
    points = _points(spark, sf).select("vocab_size", "token_count")
    write_points_csv(points, path)
    return spark.read.option("header", True).schema(points.schema).csv(path)


# --- further layouts and longer lists ----------------------------------------------------------------


def special_literal(spark, sf):
    """Every document with the special literal put into its middle, cut the way encoding cuts it."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    marked = F.concat(
        F.substring(F.col("text"), F.lit(1), half), F.lit(SPECIAL_TOKEN), F.substring(F.col("text"), half + 1, F.char_length("text"))
    )
    words = encoding_pretokens(F.col("text"), PLAIN)
    return (
        documents(spark, sf)
        .select("doc_id", marked.alias("text"))
        .select("doc_id", F.size(words).alias("n_words"), F.array_join(words, "|").alias("words"))
    )


def bpe_encode_other_base(spark, sf):
    """Words under a JSON model without a special token, whose ids therefore start one lower."""
    model = trained(spark, sf)
    vocab = model.vocab.where(F.col("token_id") != SPECIAL_ID).withColumn("token_id", F.col("token_id") - 1)
    ids = {c: F.col(c) - 1 for c in ("token_id", "left_id", "right_id")}
    path = f"{checkpoint_root(spark)}/other-{_fresh()}.json"
    export_json(BpeModel(vocab, model.merges.withColumns(ids), specials=(), unknown=None), path)
    other = load_json(spark, path)
    words = word_table(conversations(spark, sf), splitting=other.splitting)
    return encode_word_types(words, other).select("word", "freq", "n_tokens", joined(F.col("ids")).alias("ids"))


def _large(spark, sf):
    """Words of all documents and a model of more than 4,096 merges trained on them."""
    key = (spark.sparkContext.applicationId, f"{sf}, large")
    if key not in _models:
        _models[key] = train_bpe(word_types(documents(spark, sf)), LARGE_VOCAB)
    return _models[key]


def word_tokenizer_counts(spark, sf, name: str = "word_bpe_49k.json"):
    """Token counts of all documents under a public tokenizer that normalizes, drops blanks and marks word ends."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as file:  # a file of the driver's own disk
        model = parse_json(spark.createDataFrame([(file.read(),)], "value string"), path)
    return document_token_counts(documents(spark, sf), ["doc_id"], model)


def prefix_sweep_large(spark, sf):
    """All points of a sweep over a model of more than 4,096 merges."""
    corpus, model = conversations(spark, sf), _large(spark, sf)
    grid = size_grid(spark, model.base_size, model.vocab_size, GRID_STEP)
    return prefix_sweep(word_table(corpus), model, grid, read_stats(corpus).bytes_used)


def parity_large(spark, sf):
    """Both ways of encoding over all documents at every size of a grid up to the whole large model."""
    corpus, model = documents(spark, sf), _large(spark, sf)
    words, used = word_table(corpus), read_stats(corpus).bytes_used
    grid = size_grid(spark, model.base_size, model.vocab_size, GRID_STEP)
    flat = prefix_sweep(words, model, grid, used)
    return require_parity(flat, prefix_sweep(words, model, grid, used, merge_events_by_joins(words, model)))


def heldout_meta(spark, sf):
    """Totals of a prepared cache, after preparing it, finding it complete, and reading its metadata."""
    folder = f"{checkpoint_root(spark)}/cache-{_fresh()}"
    corpus = ordered_documents(spark, sf)
    total = corpus.total_bytes
    for _ in range(2):  # the second call finds the cache complete
        prepare_heldout(lambda: corpus, spark, folder, share(total, 60), share(total, 20))
    fields = ("skipped_utf8_bytes", "skipped_documents", "cached_utf8_bytes", "cached_documents")
    found = spark.read.json(meta_path(folder), multiLine=True)
    return found.select(*(F.col(f).cast("bigint").alias(f) for f in fields))


def heldout_migrated(spark, sf):
    """Conversation turns written as a legacy cache, migrated and read."""
    folder = f"{checkpoint_root(spark)}/legacy-{_fresh()}"
    lines = conversations(spark, sf).select(F.to_json(F.struct("text")).alias("value")).select(
        F.expr("substr(value, 9, char_length(value) - 9)").alias("value")
    )
    lines.write.text(text_path(folder))
    write_summary(spark, {"format": "older"}, meta_path(folder))
    migrate(spark, folder, {"format": "older"})
    return open_heldout(spark, folder)[0]


def points_read(spark, sf):
    """The sweep's points after writing a compression summary and reading them from it."""
    path = f"{checkpoint_root(spark)}/compression-{_fresh()}.json"
    listed = [r.asDict() | {"seconds": 0.0} for r in _points(spark, sf).collect()]  # one row per grid size
    write_summary(spark, {"points": listed}, path)
    return read_points(spark, path).select("vocab_size", "token_count", "bytes_per_token", "tokens_per_byte")


def axis_label(spark, sf):
    """Axis labels of sizes taken from all order keys, in thousands."""
    keys = spark.read.parquet(f"{sf}/orders.parquet").select(
        ((F.col("o_orderkey") - 1) * 1000).cast("bigint").alias("size")
    )
    return keys.select("size", vocab_axis_label(F.col("size")).alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_scan": corpus_scan,
    "corpus_stats": corpus_stats_query,
    "nonempty_docs": nonempty_docs,
    "utf8_bytes": utf8_bytes_query,
    "utf8_truncate": utf8_truncate,
    "size_parse": size_parse,
    "tokenizer_select": tokenizer_select,
    "byte_budget_prefix": byte_budget_prefix_query,
    "byte_budget_prefix_turns": byte_budget_prefix_turns,
    "byte_budget_prefix_scaled": byte_budget_prefix_scaled,
    "heldout_slice": heldout_slice_query,
    "heldout_cache": heldout_cache,
    "heldout_legacy": heldout_legacy,
    "progress_marks": progress_marks_query,
    "shortfall_check": shortfall_check,
    "pretokenize": pretokenize,
    "pretokenize_pages": pretokenize_pages,
    "byte_alphabet": byte_alphabet_query,
    "word_type_counts": word_type_counts,
    "base_vocabulary": base_vocabulary_query,
    "pair_counts": pair_counts_query,
    "bpe_train_small": bpe_train_small,
    "bpe_train_exact": bpe_train_exact,
    "vocab_size": vocab_size,
    "tokenizer_files": tokenizer_files,
    "bpe_encode_words": bpe_encode_words,
    "doc_token_counts": doc_token_counts,
    "doc_token_ids": doc_token_ids,
    "byte_decode": byte_decode,
    "token_totals": token_totals_query,
    "tokenizer_comparison": tokenizer_comparison,
    "compression_ratios": compression_ratios,
    "fixed_id_stats": fixed_id_stats,
    "vocab_grid": vocab_grid,
    "merge_prefix": merge_prefix,
    "prefix_point": prefix_point,
    "prefix_sweep": prefix_sweep_query,
    "prefix_sweep_documents": prefix_sweep_documents,
    "sweep_summary": sweep_summary_query,
    "parity_check": parity_check,
    "points_csv": points_csv,
    "axis_label": axis_label,
    "special_literal": special_literal,
    "bpe_encode_other_base": bpe_encode_other_base,
    "prefix_sweep_large": prefix_sweep_large,
    "parity_large": parity_large,
    "word_tokenizer_counts": word_tokenizer_counts,
    "heldout_meta": heldout_meta,
    "heldout_migrated": heldout_migrated,
    "points_read": points_read,
}
