"""Problem 9: the subject areas of each document.

Documents and their sentences are embedded by weighted terms and a truncated singular value decomposition, and go to the
subjects whose centroids they are near by cosine. The centroids are seeded by labelled documents and refined, as are the
terms and their weights, with counts over all documents:

1. A bounded number of labelled documents gives the first terms: words far more usual in one subject than elsewhere.
2. The matrix of all documents and these terms is decomposed by subspace iteration; each product with the matrix is one
   pass over a table of term numbers, summed by term. Centroids start from the labelled documents, then move to the mean
   of all sentences near them.
3. With that model every document is read: a word becomes a term of the next model by the share of its documents whose
   other sentences are about a subject. Words of every form and frequency that the labels never showed are found here.
4. The model of the new terms is built as in 2 and applied to all documents.

A text need not have three full stops for three sentences, nor name its subject in each. So the number of sentences near
a centroid, the terms in them and the length of the text are weighed by a logistic function fitted on the labelled
documents, instead of a bare count of three.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkraal.functions.normalize import clean_key
from textkraal.llm._flat import codes_of, segment_hashes
from textkraal.llm.p1_language import LABELS, LANGS
from textkraal.operators.records import bounded_sample
from textkraal.session import load, materialize

SUBJECTS = ["education", "farming", "health", "law", "religion", "science", "software", "sport", "trade"]
S = len(SUBJECTS)
MIN_SENTENCES = 3
#: Bound on the labelled documents that give the seeds and the final weighing.
LABELLED = 8_000
RANK, POWERS, REFINEMENTS = 24, 3, 2
#: A word of a seed stands in at least SEED_DOCS labelled documents, a later term in MIN_DOCS documents at least.
SEED_DOCS, MIN_DOCS = 2, 3
#: How far a word's share of a subject exceeds the usual share, (share - usual) / (1 - usual): no term below the first
#: figure, full strength from the second on; of seeds and of later terms.
SEED_LIFT, LIFT = (0.3, 0.6), (0.2, 0.4)
#: Documents of the usual share that are added to every word's count.
PRIOR = 5
#: A sentence is about a subject if its vector is at least this long and this close to the subject's centroid; while
#: centroids and words are being refined, it must be closer.
LENGTH, COSINE, FIT_COSINE = 0.5, 0.2, 0.55
#: The model is broadcast: about 150 bytes a term. A corpus with more terms needs a higher MIN_DOCS; nothing is cut.
MAX_TERMS = 400_000
_SPACE = np.zeros(0x3001, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_SPACE[[34, 39, 41, 93]] = True  # a quote or bracket that closes the sentence


def prepared(text: Column) -> Column:
    """Lower case, old spelling replaced, an empty line as one mark; null as an empty text."""
    low = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("6"), F.lit("bh")), F.lit("5"), F.lit("hl"))
    return F.regexp_replace(low, r"\n\s*\n", "\u2029")


def bag(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, word, owner): the distinct hashed words of each sentence, sentences ascending; owner[sentence] is its text.

    Texts are prepared() ones. A sentence ends at . ! or ? before white space or a closing quote, or at an empty line;
    one without words does not count.
    """
    flat, off = codes_of(texts)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = (flat >= 97) & (flat <= 122)
    other = np.flatnonzero(flat >= 128)
    if len(other):
        u, inv = np.unique(flat[other], return_inverse=True)
        letter[other] = np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in u])[inv]
    begins = np.zeros(len(flat), bool)  # of a text
    begins[off[:-1][np.diff(off) > 0]] = True
    before = np.concatenate(([False], letter[:-1])) & ~begins
    start = np.flatnonzero(letter & ~before)
    after = np.concatenate((letter[1:] & ~begins[1:], [False]))
    end = np.flatnonzero(letter & ~after) + 1
    gap = np.concatenate((_SPACE[np.minimum(flat[1:], 0x3000)], [False]))
    ends = ((flat == 46) | (flat == 33) | (flat == 63)) & gap | (flat == 0x2029)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.cumsum(ends + begins.astype(np.int64))[start]
    number, sent = np.unique(raw, return_inverse=True)
    owner = np.zeros(len(number), np.int64)
    owner[sent] = np.searchsorted(off, start, side="right") - 1
    word = segment_hashes(flat, start, end)
    order = np.lexsort((word, sent))
    sent, word = sent[order], word[order]
    new = np.ones(len(sent), bool)
    new[1:] = (sent[1:] != sent[:-1]) | (word[1:] != word[:-1])
    return sent[new], word[new], owner


def _unit(a: np.ndarray) -> np.ndarray:
    return (a / np.maximum(np.sqrt((a * a).sum(axis=-1, keepdims=True)), 1e-9)).astype(np.float32)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values (len(rows) x m) by row."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        r = rows[order]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        out[r[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


@dataclass
class SubjectModel:
    """Terms (hashed words, ascending), each with its language, unit vector and strength; a centroid per language and subject.

    Terms of two languages share hardly any document, so each language has a space of its own; a term belongs to
    the language whose documents have it most often. weights: of the logistic function of features(), or None.
    """

    keys: np.ndarray
    lang: np.ndarray
    near: np.ndarray
    strength: np.ndarray
    centroid: np.ndarray
    weights: np.ndarray | None = None

    def terms(self, sent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, term) of those words that are terms."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, word), len(self.keys) - 1)
        ok = self.keys[at] == word
        return sent[ok], at[ok]

    def about(self, sent: np.ndarray, term: np.ndarray, n: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Which of n sentences are about which subject, and their cosines to the centroids."""
        about, best = np.zeros((n, S), bool), np.zeros((n, S), np.float32)
        for k in range(len(LANGS)):
            on = self.lang[term] == k
            if not on.any():
                continue
            t = term[on]
            rows, at = np.unique(sent[on], return_inverse=True)
            e = _sums(at, self.near[t] * self.strength[t, None], len(rows))
            length = np.sqrt((e * e).sum(axis=1))
            cos = e @ self.centroid[k].T / np.maximum(length, 1e-9)[:, None]
            close = (cos >= cosine) & (length >= LENGTH)[:, None]
            about[rows] |= close
            best[rows] = np.maximum(best[rows], np.where(close, cos, 0))
        return about, best

    def affinity(self) -> np.ndarray:
        """Terms x subjects: the share each term counts for a subject, halved where it is as near to another one."""
        cos = np.einsum("tr,tsr->ts", self.near, self.centroid[self.lang]) if len(self.keys) else np.zeros((0, S))
        close = (cos >= FIT_COSINE) & (self.strength >= LENGTH)[:, None]
        return close / np.maximum(1, close.sum(axis=1, keepdims=True))

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, sentences about each subject, mean cosine of those) of prepared() texts; features: texts x subjects x m."""
        sent, word, owner = bag(texts)
        n = len(texts)
        s, t = self.terms(sent, word)
        about, best = self.about(s, t, len(owner), COSINE)
        hits, cos = _sums(owner, about.astype(np.float32), n), _sums(owner, best, n)
        share = self.affinity()
        own, any_ = _sums(owner[s], share[t].astype(np.float32), n), _sums(owner[s], (share[t] > 0).astype(np.float32), n)
        sentences, words = np.bincount(owner, minlength=n)[:, None], np.bincount(owner[sent], minlength=n)[:, None]
        long = np.log1p(sentences) + 0 * hits
        upto = np.minimum(hits, 4)
        x = [np.ones_like(hits), upto, hits == 2, hits >= 3, np.minimum(own, 6), np.minimum(any_, 6), long, np.log1p(words) + 0 * hits, upto * long]
        return np.stack(x, axis=-1).astype(float), hits.astype(np.int64), cos / np.maximum(hits, 1)

    def chance(self, x: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Of each text and subject, the probability of its label; without weights 1 from MIN_SENTENCES on."""
        if self.weights is None:
            return (hits >= MIN_SENTENCES).astype(float)
        return np.where(hits > 0, 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), 0.0)

    def weigh(self, texts: list[str], truth: np.ndarray) -> None:
        """Fit the weights on labelled texts; with labels of one kind only they stay None."""
        x, hits, _ = self.features(texts)
        on = hits > 0
        x, y = x[on], truth[on].astype(float)
        if not 0 < y.sum() < len(y):
            return
        b = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(b)), x.T @ (y - p) - b)
        self.weights = b


def seed_terms(texts: list[str], truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words ascending, strengths) of labelled texts; truth: texts x subjects."""
    sent, word, owner = bag(texts)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(0)
    keys, at = np.unique(word, return_inverse=True)
    pair = np.unique(owner[sent] * len(keys) + at)
    doc, term = pair // len(keys), pair % len(keys)
    seen = np.bincount(term, minlength=len(keys))
    usual = truth.mean(axis=0)
    share = (_sums(term, truth[doc].astype(np.float32), len(keys)) + 2 * usual) / (seen[:, None] + 2)
    lift = ((share - usual) / np.maximum(1 - usual, 1e-9)).max(axis=1)
    strength = np.clip((lift - SEED_LIFT[0]) / (SEED_LIFT[1] - SEED_LIFT[0]), 0, 1) * (seen >= SEED_DOCS)
    return keys[strength > 0], strength[strength > 0]


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def term_table(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """(doc_id, lang, sents, terms): the sentence and number of each term in each document that has one; written."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SubjectModel(shared.value, *[None] * 4)  # type: ignore[arg-type]
        for b in _batches(batches):
            sent, word, owner = bag(b.column("text").to_pylist())
            s, t = model.terms(sent, word)
            n = np.bincount(owner[s], minlength=b.num_rows)
            has = np.flatnonzero(n)
            off = np.concatenate(([0], np.cumsum(n[has])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(has)), b.column("lang").take(pa.array(has)), _lists(off, s), _lists(off, t)], names=["doc_id", "lang", "sents", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang int, sents array<int>, terms array<int>"), "p9terms")


def _flat_lists(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column."""
    c = b.column(name)
    return np.repeat(np.arange(b.num_rows), np.diff(c.offsets.to_numpy())), c.flatten().to_numpy()


def _summed(table: DataFrame, per_batch, columns: int, kind: str = "double") -> tuple[np.ndarray, np.ndarray]:
    """per_batch(batch) gives (key, values); the sums of the values by key, over all tasks. As many rows as there are keys."""
    names = [f"v{i}" for i in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 20_000):
            key, value = per_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *[pa.array(value[:, i].astype(float)) for i in range(columns)]], names=["key", *names])

    got = table.mapInArrow(run, f"key long, {', '.join(n + ' double' for n in names)}").groupBy("key").agg(*[F.sum(n).cast(kind).alias(n) for n in names]).toArrow()
    return got["key"].to_numpy(), np.stack([got[n].to_numpy() for n in names], axis=1) if len(got) else np.zeros((0, columns))


def build(docs: DataFrame, per_lang: np.ndarray, keys: np.ndarray, strength: np.ndarray, labelled: dict, sc: SparkContext) -> SubjectModel:
    """The model of given terms: languages, decomposition and centroids from all documents."""
    K, L = len(keys), len(LANGS)
    empty = SubjectModel(keys, np.zeros(K, np.int64), np.zeros((K, RANK), np.float32), np.asarray(strength, np.float32), np.zeros((L, S, RANK), np.float32))
    if not K:
        return empty
    table = term_table(docs, keys)

    def pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        row, term = _flat_lists(b, "terms")
        p = np.unique(row * K + term)
        return p // K, p % K

    def counted(b: pa.RecordBatch):
        row, term = pairs(b)
        lang = b.column("lang").to_numpy(zero_copy_only=False)[row]
        x = np.zeros((len(term) + 1, 2 + L))
        x[:-1, 0] = 1
        for k in range(L):
            x[:-1, 2 + k] = lang == k
        x[-1, 1] = b.num_rows
        key, at = np.unique(np.append(term, -1), return_inverse=True)
        return key, _sums(at, x, len(key))

    key, n = _summed(table, counted, 2 + L)
    rows, own = n[key == -1, 1].sum(), key >= 0
    df, in_lang = np.zeros(K), np.zeros((K, L))
    df[key[own]], in_lang[key[own]] = n[own, 0], n[own, 2:]
    lang = (in_lang / np.maximum(per_lang, 1)).argmax(axis=1)
    mean_row = max(1e-9, (strength * df).sum() / max(1, rows))
    col = np.sqrt(strength * df + 5)
    shared = sc.broadcast((lang, strength, col, mean_row))

    def product(q: np.ndarray) -> np.ndarray:
        """The matrix, transposed, times the matrix times q, each language's documents by themselves."""
        sent_q = sc.broadcast(q.astype(np.float32))

        def per_batch(b: pa.RecordBatch):
            lang, strength, col, mean_row = shared.value
            row, term = pairs(b)
            row = row * L + lang[term]
            total = np.bincount(row, weights=strength[term], minlength=b.num_rows * L)
            x = (strength[term] / (np.sqrt(total[row] + mean_row) * col[term])).astype(np.float32)
            y = _sums(row, x[:, None] * sent_q.value[term], b.num_rows * L)
            key, at = np.unique(term, return_inverse=True)
            return key, _sums(at, x[:, None] * y[row], len(key))

        key, v = _summed(table, per_batch, RANK)
        out = np.zeros((K, RANK))
        out[key] = v
        sent_q.destroy()
        return out

    q = np.random.default_rng(7).standard_normal((K, RANK))
    near = np.zeros((K, RANK), np.float32)
    for step in range(POWERS):
        for k in range(L):  # the languages' terms are disjoint, so each has orthogonal columns of its own
            on = np.flatnonzero(lang == k)
            basis = np.linalg.qr(q[on])[0]
            q[on] = np.pad(basis, ((0, 0), (0, RANK - basis.shape[1])))
        z = product(q)
        if step == POWERS - 1:
            for k in range(L):
                on = np.flatnonzero(lang == k)
                value, turn = np.linalg.eigh(q[on].T @ z[on])
                near[on] = q[on] @ turn * np.sqrt(np.maximum(value, 0))
        q = z
    model = SubjectModel(keys, lang, _unit(near), empty.strength, empty.centroid)

    # seeds: labelled documents of one subject only, at most LABELLED of them
    ids = table.sparkSession.createDataFrame([(i,) for i in labelled], T.StructType([T.StructField("doc_id", table.schema["doc_id"].dataType)]))
    for r in table.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "terms").collect():
        which = labelled[r.doc_id]
        if len(which) == 1 and which <= set(SUBJECTS):
            t = np.unique(np.array(r.terms))
            for k in range(L):
                on = t[lang[t] == k]
                if len(on):
                    model.centroid[k, SUBJECTS.index(next(iter(which)))] += _unit((model.near[on] * model.strength[on, None]).sum(axis=0))
    model.centroid = _unit(model.centroid)

    for _ in range(REFINEMENTS):
        current = sc.broadcast(model)

        def moved(b: pa.RecordBatch, current=current):
            m = current.value
            row, sent = _flat_lists(b, "sents")
            term = b.column("terms").flatten().to_numpy()
            _, sent = np.unique(row * (int(sent.max(initial=0)) + 1) + sent, return_inverse=True)
            out = np.zeros((L * S, RANK))
            for k in range(L):
                on = m.lang[term] == k
                e = _sums(sent[on], m.near[term[on]] * m.strength[term[on], None], int(sent.max(initial=-1)) + 1)
                length = np.sqrt((e * e).sum(axis=1))
                close = (e @ m.centroid[k].T >= FIT_COSINE * length[:, None]) & (length >= LENGTH)[:, None]
                out[k * S : (k + 1) * S] = close.T.astype(np.float32) @ e
            return np.arange(L * S), out

        key, v = _summed(table, moved, RANK)
        c = model.centroid.reshape(L * S, RANK).copy()
        some = np.abs(v).sum(axis=1) > 0
        c[key[some]] = _unit(v[some])
        model = SubjectModel(keys, lang, model.near, model.strength, c.reshape(L, S, RANK))
        current.destroy()
    return model


def all_terms(docs: DataFrame, model: SubjectModel, sc: SparkContext) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words ascending, strengths) from all documents, those about a subject by their other sentences."""
    shared = sc.broadcast(model)
    names = ["n", *[f"c{j}" for j in range(S)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _batches(batches, 8000):
            sent, word, owner = bag(b.column("text").to_pylist())
            about, _ = m.about(*m.terms(sent, word), len(owner), FIT_COSINE)
            hits = _sums(owner, about.astype(np.float32), b.num_rows)
            keys, at = np.unique(word, return_inverse=True)
            pair, inv = np.unique(owner[sent] * max(1, len(keys)) + at, return_inverse=True)
            doc, term = pair // max(1, len(keys)), pair % max(1, len(keys))
            rest = hits[doc] - _sums(inv, about[sent].astype(np.float32), len(pair))
            counts = _sums(term, (rest >= MIN_SENTENCES - 1).astype(np.float32), len(keys))
            n = np.bincount(term, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), *[pa.array(counts[:, j].astype(np.int64)) for j in range(S)]], names=["word", *names])

    w = docs.select("text").mapInArrow(run, f"word long, {', '.join(x + ' long' for x in names)}")
    w = materialize(w.groupBy("word").agg(*[F.sum(x).alias(x) for x in names]), "p9words")
    total = w.agg(*[F.sum(x).alias(x) for x in names]).first()
    if not total.n:
        return np.zeros(0, np.uint64), np.zeros(0)
    n = F.col("n") + F.lit(float(PRIOR))
    lifts = []
    for j in range(S):
        usual = total[f"c{j}"] / total.n
        share = (F.col(f"c{j}") + F.lit(PRIOR * usual)) / n
        lifts.append((share - F.sqrt(share * (F.lit(1.0) - share) / n) - F.lit(usual)) / F.lit(max(1 - usual, 1e-9)))  # a standard error below
    strength = (F.greatest(*lifts) - F.lit(LIFT[0])) / F.lit(LIFT[1] - LIFT[0])
    kept = w.where(F.col("n") >= MIN_DOCS).select("word", F.least(strength, F.lit(1.0)).alias("strength")).where("strength > 0")
    got = kept.limit(MAX_TERMS + 1).toArrow()
    if len(got) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms of subjects; raise MIN_DOCS")
    keys = got["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["strength"].to_numpy()[order]


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> SubjectModel:
    """The model for documents(doc_id, text, lang) and labels(doc_id, subject), of which at most `most` documents are used.

    Without labels the model has no terms and finds no subject. Labels other than the subjects mean `none`.
    """
    sc = spark.sparkContext
    langs = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, LANGS.index(v))])
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", prepared(F.col("text")).alias("text"), F.coalesce(F.element_at(langs, clean_key(F.col("lang"))), F.lit(-1)).alias("lang"))
    chosen = bounded_sample(labels.dropna(subset=["doc_id", "subject"]).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")), ["doc_id"], most)
    known = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "subjects").orderBy("doc_id").collect()
    labelled = {r.doc_id: set(r.subjects) for r in known}
    texts = [r.text for r in known]
    truth = np.array([[s in r.subjects for s in SUBJECTS] for r in known], bool).reshape(len(known), S)
    keys, strength = seed_terms(texts, truth) if len(known) else (np.zeros(0, np.uint64), np.zeros(0))
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # at most six rows
    per_lang = np.array([counts.get(k, 0) for k in range(len(LANGS))])
    model = build(docs, per_lang, keys, strength, labelled, sc)
    if len(keys):
        model = build(docs, per_lang, *all_terms(docs, model, sc), labelled, sc)
        model.weigh(texts, truth)
    return model


def subjects_of(docs: DataFrame, model: SubjectModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject, sentences, cosine, probability): the subjects that at least three sentences of a text are about.

    Null and empty texts have no row, nor has a text without a subject; repeated rows give repeated rows. `sentences`
    counts those with words of the subject; others of a text about it may have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[key], T.StructField("subject", T.StringType()), T.StructField("sentences", T.LongType())]
    schema = T.StructType([*fields, T.StructField("cosine", T.DoubleType()), T.StructField("probability", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _batches(batches):
            x, n, c = m.features(b.column(1).to_pylist())
            p = m.chance(x, n)
            i, j = np.nonzero(p >= 0.5)
            cols = [b.column(0).take(pa.array(i)), pa.array([SUBJECTS[k] for k in j], pa.string()), pa.array(n[i, j]), pa.array(c[i, j].astype(float)), pa.array(p[i, j])]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(key, prepared(F.col(text)).alias("_text")).mapInArrow(run, schema)


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and subjects, with the number of sentences, their mean cosine, and the probability."""
    docs = load(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text", "lang")
    model = fit(spark, docs, load(spark, sf_dir, "subject_labels").select("doc_id", "subject"))
    found = subjects_of(docs, model).dropDuplicates(["doc_id", "subject"])
    return found.withColumn("cosine", F.round("cosine", 4)).withColumn("probability", F.round("probability", 4))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and subject that at least three of its sentences are about."""
    return p9_subjects(spark, sf_dir).select("doc_id", "subject")


def p9_subject_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject and their share of all documents; `none` for those without."""
    found = p9_found(spark, sf_dir)
    docs = load(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id").distinct()
    all_ = docs.join(found, "doc_id", "left").withColumn("subject", F.coalesce("subject", F.lit("none")))
    total = docs.agg(F.count("*").alias("total"))
    return all_.groupBy("subject").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(total)).select("subject", "documents", F.round(F.col("documents") / F.col("total"), 6).alias("share"))


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_subjects": p9_subjects, "p9_subject_shares": p9_subject_shares}
