"""Quality and toxicity by hierarchical empirical Bayes over sites.

A logistic classifier on text figures and telling words gives each document a log-likelihood ratio. Sites
have two levels, host and path (``source`` and ``lang`` where documents carry no address). Every document
counts at its site with its label or else with the classifier's probability; grouped sums give each host a
rate shrunk toward the global one, and each path one shrunk toward its host's. How strongly sparse sites
shrink comes from the spread between sites (method of moments). A document's posterior is its likelihood
ratio times its path's odds. Documents with a posterior of at least ``REJECT`` on either trait go.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows, taken in the order of a hash of the id;
all other steps cover all rows.

Defined results: a null text is empty, and an empty text has no evidence, so its site's rate decides. Null
sites share the site ''. Labels with a null id or value are left out; of several labels of one id the worst
counts, and of several texts the first in order is learned from. A trait with no label, or labels of one kind only, is never a reason to reject. Repeated rows are
decided each. An empty table gives no rows. Other columns are passed on untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexigrain.llm.hashing import byte_classes, hash_words, row_groups, text_buffers
from lexigrain.storage import StoredTable

SAMPLE_ROWS = 20_000
TELLING_WORDS = 200
TELLING_SCORE = 2.5
REJECT = 0.5
#: Sites sent to all tasks; more are joined by shuffle.
BROADCAST_SITES = 200_000
#: Prior weight that stands for no spread between sites at all.
NO_SPREAD = 1e9
TRAITS = ("low_quality", "toxic")

_WORDS = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()))
_PLAIN = b".,;:?'\"()-"
_KINDS = np.zeros(256, np.uint8)  # 0 symbols
_KINDS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KINDS[list(range(0x41, 0x5B))] = 2
_KINDS[list(range(0x30, 0x3A))] = 3
_KINDS[[0x20, 0x09, 0x0D]] = 4
_KINDS[0x0A] = 5
_KINDS[list(_PLAIN)] = 6
_KINDS[ord("!")] = 7
_N_KINDS = 8
FIGURES = 13


def figures(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
    """Dense figures of each text: shares of kinds of characters, and how far words repeat at once."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(rows, dtype=np.int64) * _N_KINDS, lengths)
    kinds = np.bincount(owner + _KINDS[data], minlength=rows * _N_KINDS).reshape(rows, _N_KINDS)
    shares = kinds / np.maximum(lengths, 1)[:, None]
    n = np.diff(word_offsets)
    text = np.repeat(np.arange(rows), n)
    repeats = []
    for lag in (1, 2, 3):
        same = (words[lag:] == words[:-lag]) & (text[lag:] == text[:-lag])
        repeats.append(np.bincount(text[lag:][same], minlength=rows) / np.maximum(n, 1))
    size = np.log1p(n)
    return np.column_stack([shares, *repeats, size, np.minimum(lengths / np.maximum(n, 1), 50.0)])


def _batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with their bytes, offsets, word hashes and word offsets."""
    data, offsets = text_buffers(column)
    for a, b in row_groups(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words, word_offsets, _ = hash_words(part, own, _WORDS)
        yield a, b, part, own, words, word_offsets


@dataclass
class Trait:
    """A fitted classifier of one trait; without ``weights`` it has no evidence."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FIGURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FIGURES))
    weights: np.ndarray | None = None
    base: float = 0.0

    def inputs(self, dense: np.ndarray, words: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(dense), 1 + FIGURES + len(self.words)))
        out[:, 0] = 1
        out[:, 1 : 1 + FIGURES] = np.clip((dense - self.mean) / self.scale, -6, 6)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == words)
            text = np.searchsorted(word_offsets, hit, side="right") - 1
            out[text, 1 + FIGURES + at[hit]] = 1
        return out

    def evidence(self, dense: np.ndarray, words: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each text; 0 for texts without a word."""
        if self.weights is None:
            return np.zeros(len(dense))
        ratio = self.inputs(dense, words, word_offsets) @ self.weights - self.base
        return np.where(np.diff(word_offsets) > 0, ratio, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Weights by Newton steps with a ridge: strong on figures, weak on telling words, none on the constant."""
    ridge = np.full(x.shape[1], 0.1)
    ridge[: 1 + FIGURES] = 1.0
    ridge[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def clean_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per id the worst of its labels as ``low_quality`` and ``toxic`` (0, 1 or null)."""
    return (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("label_id"))
        .agg((1 - F.min("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic"))
    )


def fit_traits(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int = SAMPLE_ROWS) -> dict[str, Trait]:
    """Classifiers of both traits from a bounded sample. The driver gets the sample's figures and word counts."""
    chosen = labels.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    chosen = F.broadcast(chosen)  # at most sample_rows
    # One text per id keeps the sample bounded however often an id stands; it is read three times.
    texts = rows.join(chosen.select("label_id"), "label_id", "left_semi").groupBy("label_id").agg(F.min("text").alias("text"))
    sample = StoredTable(texts.join(chosen, "label_id").select("label_id", "text", *TRAITS), "sample").df

    def word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [batch.column(2 + k).fill_null(-1).to_numpy(zero_copy_only=False) for k in range(2)]
            for a, b, _, _, words, offsets in _batches(batch.column(1)):
                text = np.repeat(np.arange(b - a), np.diff(offsets))
                order = np.lexsort((text, words))
                words, text = words[order], text[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
                used, at = np.unique(words[new], return_inverse=True)
                columns = []
                for mark in marks:
                    for value in (0, 1):
                        own = mark[a:b][text[new]] == value
                        columns.append(pa.array(np.bincount(at[own], minlength=len(used))))
                yield pa.RecordBatch.from_arrays([pa.array(used.view(np.int64)), *columns], names=["word", "q0", "q1", "t0", "t1"])

    totals = sample.agg(*(F.count(F.when(F.col(t) == v, 1)).alias(f"{t[0]}{v}") for t in TRAITS for v in (0, 1))).first()
    counts = (
        sample.mapInArrow(word_counts, "word long, q0 long, q1 long, t0 long, t1 long")
        .groupBy("word")
        .agg(*(F.sum(c).alias(c) for c in ("q0", "q1", "t0", "t1")))
    )
    traits = {}
    for name, short in zip(TRAITS, ("q", "t")):
        no, yes = totals[f"{name[0]}0"], totals[f"{name[0]}1"]
        if not no or not yes:
            traits[name] = Trait()
            continue
        c, a = F.col(f"{short}0") + 0.5, F.col(f"{short}1") + 0.5
        odds = F.log(a / (yes + 1 - a)) - F.log(c / (no + 1 - c))
        spread = F.sqrt(1 / a + 1 / c + 1 / (yes + 1 - a) + 1 / (no + 1 - c))
        best = (
            counts.select("word", (odds / spread).alias("score"))
            .where(F.col("score") >= TELLING_SCORE)
            .orderBy(F.desc("score"), "word")
            .limit(TELLING_WORDS)
            .collect()
        )
        traits[name] = Trait(words=np.sort(np.array([r.word for r in best], np.int64).view(np.uint64)))
    _fit_weights(sample, traits)
    return traits


def _fit_weights(sample: DataFrame, traits: dict[str, Trait]) -> None:
    """Second pass over the sample, with the telling words known."""
    lists = [t.words for t in traits.values()]

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, own, words, offsets in _batches(batch.column(1)):
                dense = figures(data, own, words, offsets)
                columns = [pa.array(dense.tolist(), pa.list_(pa.float64()))]
                for known in lists:
                    found: list[list[int]] = [[] for _ in range(b - a)]
                    if len(known):
                        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                        hit = np.flatnonzero(known[at] == words)
                        for t, w in zip(np.searchsorted(offsets, hit, side="right") - 1, at[hit]):
                            found[t].append(int(w))
                    columns.append(pa.array([sorted(set(f)) for f in found], pa.list_(pa.int32())))
                n = pa.array(np.diff(offsets))
                yield pa.RecordBatch.from_arrays(
                    [*columns, n, *batch.slice(a, b - a).columns[2:4]], names=["dense", "q", "t", "n", *TRAITS]
                )

    kind = "dense array<double>, q array<int>, t array<int>, n long, low_quality int, toxic int"
    rows = [r for r in sample.mapInArrow(describe, kind).orderBy("dense").collect() if r.n]
    for (name, trait), short in zip(traits.items(), ("q", "t")):
        own = [r for r in rows if r[name] is not None]
        y = np.array([r[name] for r in own], float)
        if len(own) < 2 or y.min() == y.max():
            continue
        dense = np.array([r.dense for r in own])
        trait.mean, trait.scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6)
        x = trait.inputs(dense, np.zeros(0, np.uint64), np.zeros(len(own) + 1, np.int64))
        for i, r in enumerate(own):
            x[i, [1 + FIGURES + w for w in r[short]]] = 1
        trait.weights = fit_logistic(x, y)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        trait.base = float(np.log(rate / (1 - rate)))


def _site(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _shrinkage(groups: DataFrame, rate: Column, prior: Column) -> float:
    """Prior weight in documents from the spread of group rates around their priors (method of moments)."""
    got = groups.agg(
        F.sum(F.col("n") * (rate - prior) ** 2).alias("spread"),
        F.sum(prior * (1 - prior)).alias("chance"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("noise"),
    ).first()
    if not got.n or got.n2 >= got.n * got.n:
        return NO_SPREAD
    between = (got.spread - got.chance) / (got.n - got.n2 / got.n)
    return NO_SPREAD if between <= 0 else min(NO_SPREAD, max(1.0, got.noise / got.n / between - 1))


def site_rates(sites: DataFrame) -> DataFrame:
    """``host, path`` with the posterior rate of each trait, from sums ``n``, ``low_quality`` and ``toxic`` per path."""
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in TRAITS))
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in TRAITS)).first()
    paths = sites
    for trait in TRAITS:
        overall = F.lit((total[trait] + 0.5) / (total.n + 1) if total.n else 0.5)
        weight = _shrinkage(hosts, F.col(trait) / F.col("n"), overall)
        host_rate = hosts.select("host", ((F.col(trait) + weight * overall) / (F.col("n") + weight)).alias(f"{trait}_host"))
        paths = paths.join(host_rate, "host")
        weight = _shrinkage(paths, F.col(trait) / F.col("n"), F.col(f"{trait}_host"))
        posterior = (F.col(trait) + weight * F.col(f"{trait}_host")) / (F.col("n") + weight)
        paths = paths.withColumn(f"{trait}_rate", F.least(F.greatest(posterior, F.lit(1e-6)), F.lit(1 - 1e-6)))
    return paths.select("host", "path", *(f"{t}_rate" for t in TRAITS))


class SiteQuality:
    """Classifiers and site rates learned from documents and labels; see the module's text."""

    def __init__(
        self,
        docs: DataFrame,
        labels: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        host_col: str = "source",
        path_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS,
    ):
        self.text_col, self.host_col, self.path_col = text_col, host_col, path_col
        marked = clean_labels(labels)
        self.traits = fit_traits(docs, marked, id_col, text_col, sample_rows)
        narrow = self._evidence(docs.select(F.col(id_col).cast("long"), text_col, _site(F.col(host_col)), _site(F.col(path_col))))
        known = narrow.join(marked, narrow.id == marked.label_id, "left")
        logits = {t: F.col(f"{t}_evidence") + self.traits[t].base for t in TRAITS}
        soft = {
            t: F.coalesce(F.col(t).cast("double"), 1 / (1 + F.exp(-logits[t])) if self.traits[t].weights is not None else F.lit(0.0))
            for t in TRAITS
        }
        # Read by about ten jobs below, so the texts are judged once for it.
        sites = StoredTable(
            known.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(c).alias(t) for t, c in soft.items())), "site-sums"
        )
        self.rates = StoredTable(site_rates(sites.df), "site-rates").df
        sites.drop()

    def _evidence(self, rows: DataFrame) -> DataFrame:
        traits = list(self.traits.values())

        def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, own, words, offsets in _batches(batch.column(1)):
                    dense = figures(data, own, words, offsets)
                    part = batch.slice(a, b - a)
                    values = [pa.array(t.evidence(dense, words, offsets)) for t in traits]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(2), part.column(3), *values],
                        names=["id", "host", "path", *(f"{t}_evidence" for t in TRAITS)],
                    )

        return rows.mapInArrow(measure, "id long, host string, path string, low_quality_evidence double, toxic_evidence double")

    def judge(self, docs: DataFrame, keep_only: bool) -> DataFrame:
        """All columns of ``docs``; either only the rows that stay, or all rows with their posteriors.

        The posteriors are columns ``low_quality``, ``toxic`` and ``kept`` behind those of ``docs``. Site
        rates are sent to all tasks if they are few; otherwise rows are shuffled to them by site, and
        adaptive execution splits a site that holds a large part of the rows.
        """
        traits, width = list(self.traits.values()), len(docs.columns)
        rates = self.rates.select(
            F.col("host").alias("h"), F.col("path").alias("p"), *(F.log(F.col(f"{t}_rate") / (1 - F.col(f"{t}_rate"))).alias(t) for t in TRAITS)
        )
        # Columns are told apart by place, so names of further columns do no harm.
        plain = docs.toDF(*(f"c{i}" for i in range(width)))
        place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
        text = docs.columns.index(self.text_col)
        site = [_site(plain[place[c]]) == rates[k] for c, k in ((self.host_col, "h"), (self.path_col, "p"))]
        few = rates.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
        rows = plain.join(F.broadcast(rates) if few else rates, site, "left").select(*plain.columns, *TRAITS)

        def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, own, words, offsets in _batches(batch.column(text)):
                    dense = figures(data, own, words, offsets)
                    part = batch.slice(a, b - a)
                    posteriors = []
                    for k, trait in enumerate(traits):
                        prior = part.column(width + k).fill_null(0.0).to_numpy(zero_copy_only=False)
                        logit = np.clip(trait.evidence(dense, words, offsets) + prior, -500, 500)
                        posteriors.append(1 / (1 + np.exp(-logit)) if trait.weights is not None else np.zeros(b - a))
                    kept = np.all([p < REJECT for p in posteriors], axis=0)
                    columns = part.columns[:width]
                    if not keep_only:
                        columns += [*map(pa.array, posteriors), pa.array(kept)]
                    out = pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])
                    yield out.filter(pa.array(kept)) if keep_only else out

        schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
        names = list(docs.columns)
        if not keep_only:
            for i, kind in enumerate((T.DoubleType(), T.DoubleType(), T.BooleanType())):
                schema.add(f"c{width + i}", kind)
            names += [*TRAITS, "kept"]
        return rows.mapInArrow(decide, schema).toDF(*names)
