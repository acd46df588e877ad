"""Problem 8: mixing sources to target weights.

A naive Bayes classifier of a bounded sample of labelled documents gives each document without a usable source its
posterior over all sources; a document with a source belongs to it wholly. A document's rate is the mean, by its
posterior, of a rate per source, and never above the repeats of any source it may well belong to. The rates are fitted
by projected-gradient least squares so that the expected tokens per source meet the targets. The gradient needs no more
of the documents than the sums of tokens times posterior times posterior, one number for each two sources, and what
the bounds on single documents take off; both are summed over all documents, in a few rounds, by distributed aggregation.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkraal.functions.normalize import clean_key
from textkraal.llm._flat import codes_of, gram_hashes
from textkraal.operators.records import bounded_sample
from textkraal.session import load, materialize

#: Vocabulary file of a public tokenizer; a parameter of token_sizes().
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that tokenizer cuts texts with before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bound on the labelled documents the classifier is fitted on, chosen by hash; its features; the most sources it takes.
LABELLED, FEATURES, MAX_SOURCES = 20_000, 1 << 14, 2000
#: Steps of the gradient between two passes over the documents, and passes.
STEPS, PASSES = 4000, 5
#: A document without a source is bound by the repeats of each source it belongs to with this probability.
LIKELY = 0.1


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class SourceClassifier:
    """Multinomial naive Bayes over hashed 4-character pieces, tempered by the length of the text."""

    def __init__(self, texts: list[str], sources: list[str]):
        self.names = sorted(set(sources))
        if len(self.names) > MAX_SOURCES:
            raise ValueError(f"{len(self.names)} sources; the classifier is broadcast and takes {MAX_SOURCES}")
        at = {s: i for i, s in enumerate(self.names)}
        counts = np.ones((max(1, len(self.names)), FEATURES))
        for t, s in zip(texts, sources):
            counts[at[s]] += np.bincount(self._features([t])[1], minlength=FEATURES)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)
        self.prior = np.log(np.maximum(1, np.bincount([at[s] for s in sources], minlength=max(1, len(self.names)))) / max(1, len(sources)))

    @staticmethod
    def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of every piece."""
        flat, off = codes_of([t.lower() for t in texts])
        h = gram_hashes(flat, 4)
        row = np.repeat(np.arange(len(texts)), np.diff(off))[: len(h)]
        whole = np.arange(len(h)) + 4 <= off[row + 1]
        return row[whole], (h[whole] % np.uint64(FEATURES)).astype(np.int64)

    def posterior(self, texts: list[str]) -> np.ndarray:
        """Texts x sources; a text without pieces has the prior."""
        row, f = self._features(texts)
        n = np.bincount(row, minlength=len(texts))
        score = np.tile(self.prior, (len(texts), 1))
        some = np.flatnonzero(n)
        if len(some):
            score[some] += np.add.reduceat(self.log[f], (np.cumsum(n) - n)[some], axis=0) / np.sqrt(n[some])[:, None]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def token_sizes(docs: DataFrame, classifier: SourceClassifier, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, posterior): a document's tokens and, where it states no source, its posterior over classifier.names.

    A null text has no tokens; a blank source is missing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for b in batches:
            texts, sources = [t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist()
            n = [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]
            soft = [i for i, s in enumerate(sources) if s is None] if shared.value.names else []
            post: list = [None] * len(texts)
            for i, x in zip(soft, shared.value.posterior([texts[i] for i in soft]).tolist()):
                post[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(post, pa.list_(pa.float64()))], names=["doc_id", "source", "tokens", "posterior"])

    d = docs.select("doc_id", "text", clean_key(F.col("source")).alias("source"))
    return d.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, tokens long, posterior array<double>")


def fit_rates(m: np.ndarray, want: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Rates r between 0 and cap of least squared misses of m r from want, by accelerated projected gradient.

    Each source's miss is taken relative to what it has or wants, so that small sources count like large ones.
    """
    if not len(want):
        return np.zeros(0)
    scale = np.maximum(1.0, np.maximum(want, m.sum(axis=1)))
    a, want = m / scale[:, None], want / scale
    rate = np.minimum(cap, 1.0)
    step = 1.0 / max(1e-12, np.linalg.norm(a, 2) ** 2)
    momentum, t = rate.copy(), 1.0
    for _ in range(STEPS):
        new = np.clip(momentum - step * (a.T @ (a @ momentum - want)), 0, cap)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum, t = new + (t - 1) / s * (new - rate), s
        done = np.abs(new - rate).max() < 1e-10
        rate = new
        if done:
            break
    return rate


def soft_rates(post: np.ndarray, rate: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """The rates of documents of given posteriors: their sources' mean rate, within the repeats of all likely sources."""
    bound = np.where(post >= LIKELY, cap, np.inf).min(axis=1, initial=np.inf)
    return np.minimum(post @ rate, np.where(np.isfinite(bound), bound, 0))


def mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(documents, targets, names): doc_id, source, posterior, tokens, repeats; source, target_share, max_repeats; the posterior's order."""
    sc = spark.sparkContext
    d = load(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text", "source").dropDuplicates(["doc_id"])
    lab = bounded_sample(d.select("doc_id", "text", clean_key(F.col("source")).alias("source")).dropna(), ["doc_id"], LABELLED).collect()
    names = (classifier := SourceClassifier([r.text for r in lab], [r.source for r in lab])).names
    sized = materialize(token_sizes(d, classifier), "p8sized")
    targets = load(spark, sf_dir, "mix_targets").select(clean_key(F.col("source")).alias("source"), "target_share", "max_repeats").dropna()
    goal = {r.source: (r.target_share, float(r.max_repeats)) for r in targets.collect()}  # 14 rows
    at = {s: i for i, s in enumerate(names)}
    every = sorted(goal)
    hard = {r.source: float(r.tokens) for r in sized.where(F.col("source").isin(every)).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    want = np.array([goal[s][0] * total for s in every])
    cap = np.array([goal[s][1] for s in every])
    # the classifier's sources among the targets; the posterior's other mass counts for no target
    pick = [(at[s], k) for k, s in enumerate(every) if s in at]
    inside, outside = [i for i, _ in pick], [k for _, k in pick]
    soft = sized.where("posterior is not null").select("tokens", "posterior")
    rate, own = np.zeros(len(every)), np.array([hard.get(s, 0.0) for s in every])
    for k in range(PASSES if len(every) and names else 0):
        shared = sc.broadcast((rate[outside], cap[outside]))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """Of one task: (i, j, sum of tokens x posterior x posterior), and (i, -1, expected tokens at the present rates)."""
            m, got = np.zeros((len(inside), len(inside))), np.zeros(len(inside))
            for b in batches:
                post = b.column("posterior").flatten().to_numpy().reshape(b.num_rows, -1)[:, inside]
                tokens = b.column("tokens").to_numpy()
                m += (post * tokens[:, None]).T @ post
                got += (post * (tokens * soft_rates(post, *shared.value))[:, None]).sum(axis=0)
            i, j = np.indices(m.shape)
            n = np.arange(len(inside))
            cols = [np.append(i, n).astype(np.int32), np.append(j, np.full(len(n), -1)).astype(np.int32), np.append(m, got)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["i", "j", "v"])

        m, got = np.diag(own), own * rate
        for r in soft.mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # sources x sources rows
            if r.j < 0:
                got[outside[r.i]] += r.v
            else:
                m[outside[r.i], outside[r.j]] += r.v
        shared.destroy()
        rate = fit_rates(m, want - got + m @ rate, cap)
    if not names:
        rate = fit_rates(np.diag(own), want, cap)
    shared = sc.broadcast((rate[outside], cap[outside]))

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = dict(zip(every, rate.tolist()))
        for b in batches:
            r = np.array([of.get(s, 0.0) for s in b.column("source").to_pylist()])
            has = np.flatnonzero(b.column("posterior").is_valid().to_numpy(zero_copy_only=False))
            if len(has) and inside:
                r[has] = soft_rates(b.column("posterior").take(pa.array(has)).flatten().to_numpy().reshape(len(has), -1)[:, inside], *shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], names=[*b.schema.names, "rate"])

    x = sized.mapInArrow(rates, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema) + ", rate double")
    # whole repeats whose mean is the rate: the fraction is met by the hash of the document
    chance = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    repeats = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return x.select("doc_id", "source", "posterior", "tokens", repeats.alias("repeats")), targets, names


def p8_mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: its documents, tokens, repeated tokens, target share, and the share reached of all tokens and of the mix.

    A document without a source counts for every source by its posterior, in tokens and in documents, as in the fit. A
    target without documents has share 0. most_repeats is of the documents that state the source.
    """
    docs, targets, names = mixture(spark, sf_dir)
    part = F.when(F.col("posterior").isNull(), F.array(F.struct("source", F.lit(1.0).alias("p"), F.lit(True).alias("stated"))))
    order = F.array(*[F.lit(n) for n in names]) if names else F.lit(None).cast("array<string>")
    soft = F.transform(F.arrays_zip(order.alias("source"), F.col("posterior").alias("p")), lambda z: F.struct(z["source"].alias("source"), z["p"].alias("p"), F.lit(False).alias("stated")))
    g = docs.select("tokens", "repeats", F.explode(part.otherwise(soft)).alias("s")).groupBy("s.source").agg(
        F.round(F.sum("s.p"), 2).alias("documents"), F.round(F.sum(F.col("s.p") * F.col("tokens"))).cast("long").alias("tokens"),
        F.round(F.sum(F.col("s.p") * F.col("tokens") * F.col("repeats"))).cast("long").alias("mixed_tokens"), F.max(F.when(F.col("s.stated"), F.col("repeats"))).alias("most_repeats"),
    )
    g = targets.join(g, "source", "left").na.fill(0, ["documents", "tokens", "mixed_tokens", "most_repeats"])
    total = g.agg(F.sum("mixed_tokens").alias("total")).crossJoin(F.broadcast(docs.agg(F.sum("tokens").alias("everything"))))
    of_all = F.round(F.try_divide(F.col("mixed_tokens"), F.col("everything")), 6).alias("share_of_all")
    share = F.round(F.try_divide(F.col("mixed_tokens"), F.col("total")), 6).alias("actual_share")
    return g.crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", "documents", "tokens", "mixed_tokens", "most_repeats", of_all, share)


def p8_document_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document goes into the mix; without a source of its own it is given its likeliest one."""
    docs, _, names = mixture(spark, sf_dir)
    likeliest = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("posterior", F.array_max("posterior")).cast("int")) if names else F.lit(None).cast("string")
    return docs.select("doc_id", F.coalesce("source", likeliest).alias("source"), "tokens", "repeats")


SQL: dict[str, str] = {}
QUERIES = {"p8_document_repeats": p8_document_repeats, "p8_mix_report": p8_mix_report}
