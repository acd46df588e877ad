"""Problem 1: the language of each document and of each stretch of it, with a confidence.

Bit-sliced Bloom filters: each slot of one table holds a bit per language, and the bits that are set in all slots of
an n-gram are the languages that contain it. The n-grams of a word (with its ends marked) are looked up, the bits
counted per language and corrected for false positives. A stretch of words in one language is the best path through
the words' scores, where changing the language costs more inside a clause than at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkraal.llm._flat import codes_of, gram_hashes, mix, segment_hashes
from textkraal.operators.records import bounded_sample
from textkraal.session import load

LANGS = ["xh", "en", "af", "zu", "st"]
#: Spellings of language labels (fixed values).
LABELS = {"xh": "xh", "xho": "xh", "isixhosa": "xh", "en": "en", "eng": "en", "af": "af", "afr": "af", "zu": "zu", "zul": "zu", "st": "st", "sot": "st"}
GRAMS = (2, 3, 4, 5, 6)
SLOTS, HASHES = 1 << 21, 2
MIN_RUN = 4
#: Labelled documents that may help the samples in building the filters: a bound on the training rows.
TRAIN_DOCS = 4000
#: Cost of a change of language between two words, and at the end of a clause.
SWITCH, SWITCH_CLAUSE = 5.0, 2.0
_CLAUSE_END = np.zeros(0x3000, dtype=bool)
for _c in ".!?:;()[]\n\r–—-":
    _CLAUSE_END[ord(_c)] = True


class Words:
    """The words of a batch of texts: runs of letters (with inner apostrophes and hyphens), lower case.

    Three or more letters standing alone in a row, a letter-spaced heading, are no words.
    """

    def __init__(self, texts: list[str]):
        joined = [t.lower() + "\n" for t in texts]
        self.flat, off = codes_of(joined)
        f = self.flat
        letter = _letters(f)
        # an apostrophe between letters or before a single letter belongs to the word, as in 'n
        apo = (f == 39) | (f == 0x2019)
        inner = np.zeros(len(f), dtype=bool)
        inner[:-1] = apo[:-1] & letter[1:]
        inner[1:-1] |= (f[1:-1] == 45) & letter[:-2] & letter[2:]
        solid = letter | inner
        edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        single = np.concatenate(([False, False], self.end - self.start == 1, [False, False]))
        three = single[:-2] & single[1:-1] & single[2:]
        word = ~(three[:-2] | three[1:-1] | three[2:])
        self.start, self.end = self.start[word], self.end[word]
        self.row = np.searchsorted(off, self.start, side="right") - 1
        self.n = len(texts)
        clause = np.concatenate(([0], np.cumsum(_CLAUSE_END[np.minimum(f, 0x2FFF)])))
        # whether a clause ends between the word before and this one
        self.new_clause = np.ones(len(self.start), dtype=bool)
        self.new_clause[1:] = clause[self.start[1:]] > clause[self.end[:-1]]
        self.offset = off
        self.hash = segment_hashes(f, self.start, self.end)


def _letters(f: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter; digits 5 and 6 inside words are old spelling and count too."""
    known = (f >= 97) & (f <= 122)
    other = np.flatnonzero((f >= 128) & (f != 0x2019))
    if len(other):
        u, inv = np.unique(f[other], return_inverse=True)
        known[other] = np.array([chr(c).isalpha() for c in u])[inv]
    digit = (f == 53) | (f == 54)
    if digit.any():
        beside = np.zeros(len(f), dtype=bool)
        beside[1:] |= known[:-1]
        beside[:-1] |= known[1:]
        known |= digit & beside
    return known


def _word_grams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hash, n) of the n-grams of the words `which`, ends marked, and of each whole word."""
    start, end = words.start[which], words.end[which]
    ln = end - start + 2
    total = int(ln.sum())
    first = np.cumsum(ln) - ln
    owner = np.repeat(np.arange(len(which)), ln)
    pos = np.arange(total) - first[owner]
    src = np.clip(start[owner] + pos - 1, 0, max(0, len(words.flat) - 1))
    f = np.where((pos == 0) | (pos == ln[owner] - 1), 94, words.flat[src]).astype(np.uint32)
    out = []
    for k in GRAMS:
        h = gram_hashes(f, k)
        ok = owner[: len(h)] == owner[k - 1 : k - 1 + len(h)] if len(h) else np.zeros(0, bool)
        out.append((owner[: len(h)][ok], h[ok] ^ np.uint64(k), np.full(int(ok.sum()), k, np.int8)))
    out.append((np.arange(len(which)), words.hash[which] ^ np.uint64(0xABCDEF), np.full(len(which), 7, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out))


#: Weight of an n-gram by n; 7 stands for the whole word.
WEIGHT = np.array([0, 0, 0.5, 1.0, 1.5, 2.0, 2.5, 4.0])


class LanguageFilters:
    """One table of language bits, built from labelled texts.

    A language's filter holds the n-grams at least `share` as frequent in it as in the language where they are the most
    frequent, so that letter sequences typical of one language alone stay out of the others.
    """

    def __init__(self, samples: list[tuple[str, str]], share: float = 0.15):
        if len(LANGS) > 8:
            raise ValueError("a slot has a byte, so the table takes eight languages")
        texts = [t for _, t in samples]
        words = Words(texts)
        lang = np.array([LANGS.index(x) for x, _ in samples] or [0])
        _, first, inv = np.unique(words.hash, return_index=True, return_inverse=True)
        counts = np.zeros((len(first), len(LANGS)))
        if len(first):
            np.add.at(counts, (inv, lang[words.row]), 1)
        owner, h, _ = _word_grams(words, first) if len(first) else (np.zeros(0, int), np.zeros(0, np.uint64), None)
        grams, ginv = np.unique(h, return_inverse=True)
        per = np.zeros((len(grams), len(LANGS)))
        for j in range(len(LANGS)):
            per[:, j] = np.bincount(ginv, weights=counts[owner, j], minlength=len(grams))
        size = np.maximum(1.0, counts.sum(axis=0))
        rate = per / size
        member = (per > 0) & (rate >= share * rate.max(axis=1, keepdims=True))
        self.table = np.zeros(SLOTS, dtype=np.uint8)
        bits = (member * (1 << np.arange(len(LANGS)))).sum(axis=1).astype(np.uint8)
        for s in self._slots(grams):
            np.bitwise_or.at(self.table, s, bits)
        filled = np.array([((self.table >> j) & 1).mean() for j in range(len(LANGS))])
        self.false = filled**HASHES

    @staticmethod
    def _slots(h: np.ndarray) -> list[np.ndarray]:
        out = []
        for _ in range(HASHES):
            h = mix(h + np.uint64(0x51ED270B))
            out.append((h % np.uint64(SLOTS)).astype(np.int64))
        return out

    def scores(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Per word and language the log of the share of its n-grams the language contains, weighted, false positives taken off."""
        owner, h, k = _word_grams(words, which)
        bits = np.full(len(h), 255, np.uint8)
        for s in self._slots(h):
            bits &= self.table[s]
        w = WEIGHT[k]
        total = np.bincount(owner, weights=w, minlength=len(which))
        out = np.zeros((len(which), len(LANGS)))
        for j in range(len(LANGS)):
            hit = np.bincount(owner, weights=w * ((bits >> j) & 1), minlength=len(which)) / total
            out[:, j] = np.clip((hit - self.false[j]) / (1 - self.false[j]), 0, 1)
        return np.log(out + 0.08)


def best_path(score: np.ndarray, row: np.ndarray, new_clause: np.ndarray, n: int) -> np.ndarray:
    """The best language of each word; all texts of the batch step together, the longest first."""
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    L = score.shape[1]
    back = np.zeros((len(row), L), dtype=np.int8)
    state = np.zeros((n, L))
    longest = int(count.max()) if n else 0
    alive = np.searchsorted(-count[order], -np.arange(longest), side="left")  # texts with more than t words
    for t in range(longest):
        who = order[: alive[t]]
        at = begin[who] + t
        if t:
            prev = state[who]
            top = prev.argmax(axis=1)
            moved = prev[np.arange(len(who)), top] - np.where(new_clause[at], SWITCH_CLAUSE, SWITCH)
            stay = prev >= moved[:, None]
            back[at] = np.where(stay, np.arange(L), top[:, None])
            state[who] = np.where(stay, prev, moved[:, None]) + score[at]
        else:
            state[who] = score[at]
    lang = np.zeros(len(row), dtype=np.int8)
    cur = state.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        who = order[: alive[t]]
        at = begin[who] + t
        lang[at] = cur[who]
        cur[who] = back[at, cur[who]]
    return lang


def detect_batch(texts: list[str | None], filters: LanguageFilters) -> tuple[list[list[str]], list[float], list[list[tuple[int, int, str, float]]]]:
    """Per text: its languages, the confidence, and its stretches (start, end, language, confidence)."""
    words = Words([t or "" for t in texts])
    uniq, first, inv = np.unique(words.hash, return_index=True, return_inverse=True)
    score = filters.scores(words, first)[inv] if len(uniq) else np.zeros((0, len(LANGS)))
    lang = best_path(score, words.row, words.new_clause, words.n)
    langs: list[list[str]] = [[] for _ in texts]
    spans: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    conf = [0.0] * len(texts)
    if len(lang):
        change = np.ones(len(lang), dtype=bool)
        change[1:] = (lang[1:] != lang[:-1]) | (words.row[1:] != words.row[:-1])
        s = np.flatnonzero(change)
        e = np.append(s[1:], len(lang))
        prob = np.exp(score)
        prob /= prob.sum(axis=1, keepdims=True)
        total = np.add.reduceat(score, s, axis=0)
        post = np.exp(total - total.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        runs = zip(words.row[s].tolist(), lang[s].tolist(), (e - s).tolist(), (words.start[s] - words.offset[words.row[s]]).tolist(), (words.end[e - 1] - words.offset[words.row[s]]).tolist(), post[np.arange(len(s)), lang[s]].tolist())
        best = [0] * len(texts)
        fallback: list[str | None] = [None] * len(texts)
        for r, g, n, a, b, p in runs:
            spans[r].append((a, b, LANGS[g], p))
            if n >= MIN_RUN and LANGS[g] not in langs[r]:
                langs[r].append(LANGS[g])
            if n > best[r]:
                best[r], fallback[r], conf[r] = n, LANGS[g], p
        short = np.bincount(words.row, minlength=len(texts)) < 3
        for r in range(len(texts)):
            if short[r]:
                langs[r], conf[r] = ["und"], 0.0
            elif not langs[r] and fallback[r]:
                langs[r] = [fallback[r]]
    for r in range(len(texts)):
        if not langs[r]:
            langs[r] = ["und"]
    return langs, conf, spans


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))


def detect_languages(records: DataFrame, filters: LanguageFilters, text: str = "text", spans: bool = False) -> DataFrame:
    """records with `languages` (array), `confidence` and, if asked for, `spans` added; the text column is kept.

    A text of fewer than three words (numbers don't count), null and empty ones included, has the one language `und`.
    """
    shared = records.sparkSession.sparkContext.broadcast(filters)
    extra = [T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())] + [T.StructField("spans", SPAN)] * spans
    schema = T.StructType([*records.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2500):
                b = big.slice(at, 2500)
                langs, conf, found = detect_batch(b.column(text).to_pylist(), shared.value)
                cols = [*b.columns, pa.array(langs, pa.list_(pa.string())), pa.array(conf, pa.float64())]
                names = [*b.schema.names, "languages", "confidence"]
                if spans:
                    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
                    cols.append(pa.array([[dict(zip(("start", "end", "lang", "confidence"), x)) for x in f] for f in found], pa.list_(kind)))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return records.mapInArrow(run, schema)


def train_filters(samples: list[tuple[str, str]], docs: list[tuple[str, str]]) -> LanguageFilters:
    """Filters from clean samples, then from those and the sentences of labelled documents that the first ones confirm."""
    filters = LanguageFilters(samples)
    more = []
    if docs:
        langs, conf, spans = detect_batch([t for _, t in docs], filters)
        for (label, text), found in zip(docs, spans):
            for s, e, g, p in found:
                if g == label and p > 0.99 and e - s >= 60:
                    more.append((g, text[s:e]))
    return LanguageFilters(samples + more) if more else filters


def filters_for(spark: SparkSession, sf_dir: str, docs: int = TRAIN_DOCS) -> LanguageFilters:
    """Filters from language_samples (360 rows) and at most `docs` labelled documents, chosen by hash."""
    s = load(spark, sf_dir, "language_samples").select("lang", "text").dropna().collect()
    samples = [(LABELS[r[0].strip().lower()], r[1]) for r in s if r[0].strip().lower() in LABELS]
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "text").dropna(subset=["lang", "text"])
    d = bounded_sample(d.where(F.lower(F.trim("lang")).isin(*LABELS)), ["doc_id", "text"], docs).collect() if docs else []
    return train_filters(samples, [(LABELS[r.lang.strip().lower()], r.text) for r in d])


CLASSES = ["TARGET_LANGUAGE", "MIXED_LANGUAGE", "FOREIGN_LANGUAGE", "UNCERTAIN"]


def right_label(langs):
    """The language class that the languages of a text call for, as a Column."""
    has_xh = F.array_contains(langs, "xh")
    return (
        F.when(F.array_contains(langs, "und"), "UNCERTAIN")
        .when(has_xh & (F.size(langs) == 1), "TARGET_LANGUAGE")
        .when(has_xh, "MIXED_LANGUAGE").otherwise("FOREIGN_LANGUAGE")
    )


def detected(spark: SparkSession, sf_dir: str, spans: bool = False) -> DataFrame:
    """Every row of corpus_records that has a record_id, with its languages and the label they call for."""
    r = load(spark, sf_dir, "corpus_records").where("record_id is not null").select("record_id", "text", "language_class")
    d = detect_languages(r, filters_for(spark, sf_dir), spans=spans)
    return d.withColumn("right_label", right_label(F.col("languages")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per language of each record whose label is missing or wrong."""
    d = detected(spark, sf_dir).where(~F.col("language_class").eqNullSafe(F.col("right_label")))
    return d.select("record_id", F.explode("languages").alias("lang")).distinct()


def p1_record_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its languages, the confidence of the longest stretch and the right label."""
    d = detected(spark, sf_dir)
    return d.select("record_id", F.array_join(F.array_sort("languages"), "+").alias("languages"), F.round("confidence", 4).alias("confidence"), "right_label").dropDuplicates(["record_id"])


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language in every record: start and end as offsets in the text, language, confidence."""
    d = detected(spark, sf_dir, spans=True).dropDuplicates(["record_id"])
    s = d.select("record_id", F.explode("spans").alias("s"))
    return s.select("record_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.lang").alias("lang"), F.round("s.confidence", 4).alias("confidence"))


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_record_languages": p1_record_languages, "p1_segments": p1_segments}
