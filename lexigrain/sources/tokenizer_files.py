"""Saving and loading a model: tables, and the single-JSON layout other tools read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrain.functions.pretokens import PRETOKEN_PATTERN, Splitting, java_literal
from lexigrain.functions.symbols import SPECIAL_ID, SPECIAL_TOKEN
from lexigrain.operators.model import BpeModel
from lexigrain.storage import is_file, require_new_path, store, write_one_file

# The settings of a byte-level model in the published JSON layout.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
DECODER = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
SPECIAL_FLAGS = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
MODEL_SETTINGS = {
    "type": "BPE",
    "dropout": None,
    "unk_token": None,
    "continuing_subword_prefix": None,
    "end_of_word_suffix": None,
    "fuse_unk": False,
    "byte_fallback": False,
    "ignore_merges": False,
}


def settings_table(model: BpeModel) -> DataFrame:
    rows = [
        ("BPE", model.prefix_space, model.unknown, [{"content": c, "id": i} for c, i in model.specials], model.sections or None)
    ]
    return model.vocab.sparkSession.createDataFrame(
        rows,
        "model_type string, add_prefix_space boolean, unknown_id int, "
        "specials array<struct<content: string, id: int>>, sections string",
    )


def _unknown_token(model: BpeModel) -> str | None:
    if model.unknown is None:
        return None
    row = model.vocab.where(F.col("token_id") == model.unknown).first()
    return row["token"] if row else dict((i, c) for c, i in model.specials).get(model.unknown)


def tokenizer_json(model: BpeModel) -> DataFrame:
    """The whole model as one JSON document; its size is that of the vocabulary, not of any text."""
    token = F.struct("token_id", "token").alias("token")
    merge = F.struct("rank", "left", "right").alias("merge")
    # Both lists in one aggregate: each row fills one of the two columns, and nulls are not collected.
    lists = (
        model.vocab.select(token)
        .unionByName(model.merges.select(merge), allowMissingColumns=True)
        .agg(
            F.sort_array(F.collect_list("token")).alias("tokens"),
            F.sort_array(F.collect_list("merge")).alias("merges"),
        )
    )
    vocab = F.map_from_entries(F.transform("tokens", lambda t: F.struct(t["token"], t["token_id"])))
    merges = F.transform("merges", lambda m: F.array(m["left"], m["right"]))
    document = {
        "version": "1.0",
        "truncation": None,
        "padding": None,
        "added_tokens": [{"id": i, "content": c} | SPECIAL_FLAGS for c, i in model.specials],
        "normalizer": None,
        "pre_tokenizer": PRE_TOKENIZER | {"add_prefix_space": model.prefix_space},
        "post_processor": None,
        "decoder": DECODER,
        "model": MODEL_SETTINGS | {"unk_token": _unknown_token(model)},
    }
    if model.sections:
        read = json.loads(model.sections)
        document |= {k: v for k, v in read.items() if k != "model"}
        document["model"] |= read["model"]
    # The two lists follow as the last entries of the last entry.
    head = json.dumps(document, ensure_ascii=False, separators=(",", ":"))[:-2] + ',"vocab":'
    return lists.select(
        F.concat(
            F.lit(head), F.to_json(vocab), F.lit(',"merges":'), F.to_json(merges), F.lit("}}")
        ).alias("value")
    )


def export_json(model: BpeModel, path: str) -> None:
    require_new_path(model.vocab.sparkSession, path)
    write_one_file(tokenizer_json(model), path)


def save_model(model: BpeModel, folder: str) -> None:
    """Tables ``vocab``, ``merges`` and ``settings``, and ``tokenizer.json``, under ``folder``."""
    model.vocab.write.parquet(f"{folder}/vocab")
    model.merges.write.parquet(f"{folder}/merges")
    settings_table(model).write.parquet(f"{folder}/settings")
    export_json(model, f"{folder}/tokenizer.json")


def load_tables(spark: SparkSession, folder: str) -> BpeModel:
    settings = spark.read.parquet(f"{folder}/settings").first()
    tables = spark.read.parquet(f"{folder}/vocab"), spark.read.parquet(f"{folder}/merges")
    specials = tuple((s["content"], s["id"]) for s in settings["specials"])
    if settings["sections"]:
        read = read_settings(json.loads(settings["sections"]), folder)
        return BpeModel(*tables, folder, specials, settings["unknown_id"], **read, sections=settings["sections"])
    cutting = Splitting(prefix_space=settings["add_prefix_space"])
    return BpeModel(*tables, folder, specials, settings["unknown_id"], cutting)


def _require(condition: bool, path: str, what: str) -> None:
    if not condition:
        raise ValueError(f"the tokenizer in {path} uses {what}, which is not supported")


def _java_words(pattern: str) -> str:
    r"""``\w`` of a file's patterns covers all numbers, in Java decimal digits only."""
    out, inside, at = [], 0, 0
    while at < len(pattern):
        part = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        inside += (part == "[") - (part == "]" and inside > 0)
        out.append((r"\w\p{N}" if inside else r"[\w\p{N}]") if part == r"\w" else part)
        at += len(part)
    return "".join(out)


def _pattern(setting: dict | str) -> str:
    """A pattern of the file as a Java pattern with Unicode classes."""
    if isinstance(setting, dict) and "Regex" in setting:
        return "(?U)" + _java_words(setting["Regex"])
    return java_literal(setting["String"] if isinstance(setting, dict) else setting)


def _normal_steps(setting: dict | None, path: str) -> tuple[tuple[str, ...], ...]:
    """The normalizer of a file as steps of :func:`normalized`."""
    if not setting:
        return ()
    kind = setting["type"]
    if kind == "Sequence":
        return tuple(s for part in setting["normalizers"] for s in _normal_steps(part, path))
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return (("form", kind),)
    if kind == "Lowercase":
        return (("lower",),)
    if kind == "Replace":
        pattern = setting["pattern"]
        if isinstance(pattern, dict) and "String" in pattern:
            return (("replace_text", pattern["String"], setting["content"]),)
        return (("replace", _pattern(pattern), setting["content"]),)
    if kind == "Strip":
        sides = [p for p, wanted in ((r"^\s+", setting["strip_left"]), (r"\s+$", setting["strip_right"])) if wanted]
        return (("strip", "(?U)" + "|".join(sides)),) if sides else ()
    if kind == "Prepend":
        return (("prepend", setting["prepend"]),)
    raise ValueError(f"the tokenizer in {path} uses the normalizer {kind}, which is not supported")


# What the published simple pre-tokenizers cut at.
_SIMPLE_CUTS = {
    "Whitespace": ("matches", r"(?U)\w+|[^\w\s]+"),
    "WhitespaceSplit": ("matches", r"(?U)\S+"),
    "Punctuation": ("both", r"(?U)[!-/:-@\[-`{-~]|\p{P}"),
}


def _cut_steps(setting: dict | None, path: str) -> tuple[tuple[str, str], ...]:
    """The pre-tokenizer of a file as steps of :func:`cut_pieces`; byte-level spelling itself is part of the model."""
    kind = (setting or {}).get("type")
    if kind == "Sequence":
        return tuple(s for part in setting["pretokenizers"] for s in _cut_steps(part, path))
    if kind == "ByteLevel":
        lead = (("lead", " "),) if setting.get("add_prefix_space", True) else ()
        return lead + ((("matches", PRETOKEN_PATTERN),) if setting.get("use_regex", True) else ())
    if kind == "Split":
        behavior, invert = setting["behavior"], bool(setting.get("invert"))
        _require(behavior in ("Removed", "Isolated"), path, f"splitting with {behavior}")
        way = "both" if behavior == "Isolated" else "matches" if invert else "gaps"
        return ((way, _pattern(setting["pattern"])),)
    if kind == "Digits":
        return (("both", r"(?U)\p{N}" + ("" if setting.get("individual_digits") else "+")),)
    if kind in _SIMPLE_CUTS and setting.get("behavior", "Isolated") == "Isolated":
        return (_SIMPLE_CUTS[kind],)
    raise ValueError(f"the tokenizer in {path} uses the pre-tokenizer {kind}, which is not supported")


def _is_byte_level(setting: dict | None) -> bool:
    if not setting:
        return False
    return setting["type"] == "ByteLevel" or any(_is_byte_level(p) for p in setting.get("pretokenizers", ()))


def read_settings(read: dict, path: str) -> dict:
    """Fields of a :class:`BpeModel` from the settings of a file; raises on those that encode differently."""
    model = read["model"]
    cutting, after = read["pre_tokenizer"], read["post_processor"] or {"type": "ByteLevel"}
    _require(_is_byte_level(cutting), path, f"the pre-tokenizer {(cutting or {}).get('type')} without byte-level spelling")
    _require(after["type"] == "ByteLevel", path, f"the post-processor {after['type']}")
    _require(not model.get("dropout"), path, "dropout")
    normal = _normal_steps(read["normalizer"], path)
    for entry in read["added_tokens"]:
        _require(not entry.get("single_word"), path, "added tokens that must stand as words")
        _require(not (normal and entry.get("normalized")), path, "added tokens that are normalized")
    left, right = (
        tuple(e["content"] for e in read["added_tokens"] if e.get(flag)) for flag in ("lstrip", "rstrip")
    )
    plain = cutting["type"] == "ByteLevel" and cutting.get("use_regex", True)
    cuts = (("matches", PRETOKEN_PATTERN),) if plain else _cut_steps(cutting, path)
    lead = bool(plain and cutting.get("add_prefix_space", True))
    return {
        "cutting": Splitting((), lead, left, right, normal, cuts),
        "inner_prefix": model.get("continuing_subword_prefix") or "",
        "word_end": model.get("end_of_word_suffix") or "",
        "whole_words": bool(model.get("ignore_merges")),
    }


def _token_id(vocab: DataFrame, token: str | None) -> int | None:
    row = None if token is None else vocab.where(F.col("token") == token).first()
    return row["token_id"] if row else None


_SECTIONS = ("normalizer", "pre_tokenizer", "post_processor", "added_tokens", "decoder")
_MODEL_SECTIONS = (
    "unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges",
)


def load_json(spark: SparkSession, path: str) -> BpeModel:
    """Read and check a single-JSON model; merges may be pairs or ``"left right"`` strings."""
    if not is_file(spark, path):
        raise ValueError(f"there is no tokenizer file at {path}")
    return parse_json(spark.read.text(path, wholetext=True), path)


def parse_json(text: DataFrame, path: str) -> BpeModel:
    """:func:`load_json` from a table with the file's text as its only value; ``path`` names it."""
    document = text.select(
        F.from_json(
            "value",
            ", ".join(f"{name} string" for name in _SECTIONS)
            + f", model struct<type: string, vocab: string, merges: string, {', '.join(f'{n}: string' for n in _MODEL_SECTIONS)}>",
        ).alias("d")
    )
    model = store(document.select("d.*").select("*", "model.*").drop("model"), "tokenizer-json")
    head = model.select(
        *[c for c in model.columns if c not in ("vocab", "merges")],
        F.col("vocab").startswith("{").alias("has_vocab"),
        F.col("merges").startswith("[").alias("has_merges"),
    ).first()
    if head["type"] != "BPE":
        raise ValueError(f"the tokenizer in {path} is not BPE")
    if not (head["has_vocab"] and head["has_merges"]):
        raise ValueError(f"the tokenizer in {path} has no valid vocabulary and merge list")
    read = {name: json.loads(head[name] or "null") for name in _SECTIONS}
    read["added_tokens"] = read["added_tokens"] or []
    # Strings come without their quotes, the other settings as JSON.
    texts = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix")
    read["model"] = {n: head[n] if n in texts else json.loads(head[n] or "null") for n in _MODEL_SECTIONS}
    settings = read_settings(read, path)
    specials = tuple((entry["content"], entry["id"]) for entry in read["added_tokens"])
    vocab = store(
        model.select(
            F.explode(F.from_json("vocab", "map<string,int>")).alias("token", "token_id")
        ).select("token_id", "token"),
        "vocab",
    )
    raw = model.select(F.posexplode(F.from_json("merges", "array<string>")).alias("rank", "entry"))
    pair = F.from_json("entry", "array<string>")
    parts = F.when(F.col("entry").startswith('["'), pair).otherwise(F.split("entry", " ", 2))
    merges = raw.select("rank", parts.alias("p")).select(
        "rank", F.element_at("p", 1).alias("left"), F.element_at("p", 2).alias("right")
    )
    # The right side of a merge gives up the mark of symbols that do not begin a word.
    found = merges.withColumn("token", F.concat("left", F.substring("right", len(settings["inner_prefix"]) + 1, 1 << 30)))
    for token, token_id in (("token", "token_id"), ("left", "left_id"), ("right", "right_id")):
        ids = vocab.select(F.col("token").alias(token), F.col("token_id").alias(token_id))
        found = found.join(ids, token, "left")
    unknown = read["model"]["unk_token"]
    result = BpeModel(
        vocab,
        store(
            found.select("rank", "left", "right", "token", "token_id", "left_id", "right_id"),
            "merges",
        ),
        path,
        specials,
        dict(specials).get(unknown, _token_id(vocab, unknown)),
        **settings,
        sections=json.dumps(read),
    )
    if not result.merges.where("token_id IS NULL OR left_id IS NULL OR right_id IS NULL").isEmpty():
        raise ValueError(f"a merge in {path} names a token that is not in the vocabulary")
    if read["model"]["byte_fallback"] or read["model"]["fuse_unk"]:
        letters = set(result.first_tokens())
        known = vocab.where(F.col("token").isin(list(letters))).count()
        _require(known == len(letters), path, "byte fallback or joined unknown bytes")
    return result
