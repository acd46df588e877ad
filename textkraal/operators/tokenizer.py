"""A byte-pair tokenizer: pieces, word table, training on the compact table, encoding of distinct words, decoding."""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkraal.functions.language import found
from textkraal.session import materialize

WORD_CHARS = r"[\p{L}\p{Nl}\p{No}\p{Nd}_]"
SPECIAL = ["<pad>", "<unk>", "<bos>", "<eos>"]


def pre_tokens(text: Column) -> Column:
    """Words, runs of punctuation and runs of white space; joined they are the text again."""
    return found(text, rf"(?s){WORD_CHARS}+|[^\p{{L}}\p{{Nl}}\p{{No}}\p{{Nd}}_\s]+|\s+")


def word_table(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each pre-token occurs, white space left out."""
    w = texts.select(F.explode(pre_tokens(F.col(text))).alias("word")).where(~F.col("word").rlike(r"^\s+$"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


def train(spark: SparkSession, words: DataFrame, merges: int = 200, min_frequency: int = 2, driver_words: int = 500_000) -> DataFrame:
    """(rank, left, right): merge rules from all words. The pair of highest count is merged first, of equals the smallest.

    Up to `driver_words` distinct words the inherently sequential loop runs on the word table on the driver, touching
    only words that hold the pair; above, each merge counts the pairs of all words and replaces the pair in a pass over
    the word table in the cluster. Either way gives the same rules, and no word is left out.
    """
    words = materialize(words.select("word", "n"), "words")
    if words.limit(driver_words + 1).count() > driver_words:
        return spark.createDataFrame(_train_by_passes(words, merges, min_frequency), "rank int, left string, right string")
    rows = words.collect()
    parts = [list(r.word) for r in rows]
    count = [r.n for r in rows]
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, p in enumerate(parts):
        for ab in zip(p, p[1:]):
            pairs[ab] += count[i]
            where[ab].add(i)
    out = []
    for rank in range(merges):
        if not pairs:
            break
        best = min(pairs, key=lambda k: (-pairs[k], k))
        if pairs[best] < min_frequency:
            break
        out.append((rank, *best))
        for i in list(where[best]):
            p = parts[i]
            for ab in zip(p, p[1:]):
                pairs[ab] -= count[i]
                where[ab].discard(i)
                if pairs[ab] <= 0:
                    del pairs[ab]
            merged, j = [], 0
            while j < len(p):
                if j + 1 < len(p) and (p[j], p[j + 1]) == best:
                    merged.append(p[j] + p[j + 1])
                    j += 2
                else:
                    merged.append(p[j])
                    j += 1
            parts[i] = merged
            for ab in zip(merged, merged[1:]):
                pairs[ab] += count[i]
                where[ab].add(i)
    return spark.createDataFrame(out, "rank int, left string, right string")


#: What parts the tokens of a word while it is merged by passes: no character of a word.
_GAP = "\x1f"


def _train_by_passes(words: DataFrame, merges: int, min_frequency: int, every: int = 16) -> list[tuple[int, str, str]]:
    w = words.select(F.array_join(F.filter(F.split("word", ""), lambda c: c != ""), _GAP).alias("t"), "n")
    out: list[tuple[int, str, str]] = []
    for rank in range(merges):
        t = F.split("t", _GAP)
        pair = F.explode(F.arrays_zip(F.slice(t, 1, F.size(t) - 1).alias("a"), F.slice(t, 2, F.size(t)).alias("b")))
        g = w.where(F.contains("t", F.lit(_GAP))).select("n", pair.alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))
        best = g.where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "a", "b").first()
        if best is None:
            break
        out.append((rank, best.a, best.b))
        # from left to right; a gap before and after each token, so that only whole tokens are replaced
        open_, pair_ = F.replace(F.col("t"), F.lit(_GAP), F.lit(_GAP * 2)), f"{_GAP}{best.a}{_GAP * 2}{best.b}{_GAP}"
        new = F.replace(F.concat(F.lit(_GAP), open_, F.lit(_GAP)), F.lit(pair_), F.lit(f"{_GAP}{best.a}{best.b}{_GAP}"))
        w = w.select(F.replace(F.substr(new, F.lit(2), F.length(new) - 2), F.lit(_GAP * 2), F.lit(_GAP)).alias("t"), "n")
        if rank % every == every - 1:
            w = materialize(w, "merging")
    return out


def split_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The lowest rank is merged first, one place at a time, the leftmost of equals."""
    t = list(word)
    while len(t) > 1:
        r, i = min((ranks.get(ab, 1 << 60), i) for i, ab in enumerate(zip(t, t[1:])))
        if r == 1 << 60:
            break
        t[i : i + 2] = [t[i] + t[i + 1]]
    return t


def encode_words(words: DataFrame, merges: DataFrame) -> DataFrame:
    """(word, tokens) of distinct words; the merge list is bounded by the vocabulary's size and is broadcast."""
    ranks = {(r[1], r[2]): r[0] for r in merges.select("rank", "left", "right").collect()}
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for b in batches:
            w = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([split_word(x, shared.value) for x in w], pa.list_(pa.string()))], names=["word", "tokens"])

    return words.select("word").distinct().mapInArrow(run, "word string, tokens array<string>")


def encode(texts: DataFrame, merges: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tokens): each distinct word is encoded once and joined back; white space runs are tokens by themselves."""
    w = texts.select(key, F.posexplode(pre_tokens(F.col(text))).alias("pos", "word"))
    enc = encode_words(w.where(~F.col("word").rlike(r"^\s+$")), merges)
    j = w.join(enc, "word", "left").withColumn("tokens", F.coalesce("tokens", F.array("word")))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("t"))  # the words of one text
    return g.select(key, F.flatten(F.transform("t", lambda x: x["tokens"])).alias("tokens"))


#: A vocabulary that is broadcast: about 100 bytes a token.
MOST_TOKENS = 2_000_000


def with_ids(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """encoded with a column ids: those of its tokens in vocabulary(token, id); unknown tokens have that of <unk>."""
    rows = vocabulary.limit(MOST_TOKENS + 1).collect()
    if len(rows) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens")
    ids = {r.token: r.id for r in rows}
    shared = encoded.sparkSession.sparkContext.broadcast(ids)
    schema = T.StructType([*encoded.schema.fields, T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches):
        unknown = shared.value[SPECIAL[1]]
        for b in batches:
            of = [None if t is None else [shared.value.get(x, unknown) for x in t] for t in b.column("tokens").to_pylist()]
            out = pa.array(of, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "ids"])

    return encoded.mapInArrow(run, schema)


def decode(encoded: DataFrame, key: str) -> DataFrame:
    """(key, text): tokens joined, special ones left out."""
    return encoded.select(key, F.array_join(F.filter("tokens", lambda t: ~t.isin(SPECIAL)), "").alias("text"))


def padded(tokens: Column, length: int) -> tuple[Column, Column]:
    """(tokens, mask) between <bos> and <eos>, cut to a length that keeps <eos>, and padded."""
    t = F.concat(F.array(F.lit("<bos>")), F.slice(tokens, 1, length - 2), F.array(F.lit("<eos>")))
    pad = F.array_repeat(F.lit("<pad>"), F.lit(length) - F.size(t))
    return F.concat(t, pad), F.concat(F.array_repeat(F.lit(1), F.size(t)), F.array_repeat(F.lit(0), F.lit(length) - F.size(t)))
