"""Problem 5: tokens per document and slice under an existing merge list.

A merge list isn't a longest-match vocabulary, so plain longest match over the trie would miscount. The trie with
failure links and precomputed emissions is kept, and made exact: at each character the emitted tokens are tried
from the longest down, and the first that may stand after the last token of what is before it is the last token
of the prefix. Two tokens may stand together if merging their joined characters gives just these two. So one
pass over a word, without merging, counts its tokens.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkraal.functions.normalize import clean_key
from textkraal.session import load

#: Words, runs of punctuation and runs of white space, as the tokenizer cuts a text.
PIECE = re.compile(r"((\w+)|[^\w\s]+|\s+)")
#: Distinct words a task remembers the count of before it starts anew.
REMEMBERED = 200_000


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens of a word by definition: the lowest rank first, the leftmost of equals."""
    t = list(word)
    while len(t) > 1:
        best = min(range(len(t) - 1), key=lambda i: (ranks.get((t[i], t[i + 1]), 1 << 60), i))
        if (t[best], t[best + 1]) not in ranks:
            break
        t[best : best + 2] = [t[best] + t[best + 1]]
    return t


class TokenTrie:
    """A trie with failure links over the tokens of a merge list; count() is linear in the length of the word."""

    def __init__(self, merges: list[tuple[int, str, str]]):
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, a, b in sorted(merges):
            self.ranks.setdefault((a, b), rank)
        self.tokens = [t for t in dict.fromkeys(a + b for a, b in self.ranks) if merge_word(t, self.ranks) == [t]]
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.emit = [0], [[]]
        for t in self.tokens:
            at = 0
            for ch in t:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.emit.append([])
                at = self.next[at][ch]
            self.emit[at] = [t]
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            self.emit[at] = self.emit[at] + self.emit[self.fail[at]]  # the longest first
            for ch, to in self.next[at].items():
                f = self.fail[at]
                while f and ch not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(ch, 0)
                queue.append(to)
        self.fits: dict[tuple[str, str], bool] = {}
        self.seen: dict[str, int] = {}

    def together(self, a: str, b: str) -> bool:
        """Whether the tokens a and b stay apart side by side."""
        k = (a, b)
        if k not in self.fits:
            self.fits[k] = merge_word(a + b, self.ranks) == [a, b]
        return self.fits[k]

    def split(self, word: str) -> list[str]:
        """The tokens of a word."""
        last: list[str] = []  # the last token of each prefix
        at = 0
        for i, ch in enumerate(word):
            while at and ch not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(ch, 0)
            for t in (*self.emit[at], ch):
                before = i - len(t)
                if before < 0 or self.together(last[before], t):
                    last.append(t)
                    break
        out, i = [], len(word) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, pieces) of a text: the tokens of its words, and one for each run of punctuation or white space.

        The tokens of white space part the pieces: each stretch of other tokens between them is one.
        """
        n, pieces, apart, seen = 0, 0, True, self.seen
        for run, w in PIECE.findall(text):
            if run.isspace():
                n += 1
                apart = True
                continue
            if apart:
                pieces += 1
                apart = False
            if not w:
                n += 1
            else:
                c = seen.get(w)
                if c is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    c = seen[w] = len(self.split(w))
                n += c
        return n, pieces


def read_merges(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, str]]:
    """The merge list of the existing tokenizer: 600 rows, a table of fixed size."""
    rows = load(spark, sf_dir, "bpe_merges").select("merge_rank", "left_piece", "right_piece").dropna().collect()
    return [(r[0], r[1], r[2]) for r in rows]


def token_counts(records: DataFrame, merges: list[tuple[int, str, str]], text: str = "text", out: str = "tokens", pieces: str = "pieces") -> DataFrame:
    """records with the numbers of tokens of text, and of its pieces between tokens of white space, added.

    Null text counts as no token and no piece; all columns are kept, so out and pieces must be new names.
    """
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(merges)
    schema = T.StructType([*records.schema.fields, T.StructField(pieces, T.IntegerType()), T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(shared.value)
        for b in batches:
            n = [trie.count(t) if t else (0, 0) for t in b.column(text).to_pylist()]
            cols = [pa.array([x[i] for x in n], pa.int32()) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, pieces, out])

    return records.mapInArrow(run, schema)


def counted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that has a record_id, with its pieces between white space and its tokens."""
    r = load(spark, sf_dir, "corpus_records").where("record_id is not null")
    r = r.select("record_id", "text", "token_count", "source", "language_class", "orthography", "source_type")
    return token_counts(r, read_merges(spark, sf_dir)).drop("text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose stored token_count is null or isn't the number of pieces of the text."""
    c = counted_records(spark, sf_dir)
    return c.where("token_count is null or token_count <> pieces").select("record_id").distinct()


def _once(c: DataFrame) -> DataFrame:
    """One row per record: the rows of an id agree, so the least of each column stands for it."""
    return c.groupBy("record_id").agg(*[F.min(x).alias(x) for x in c.columns if x != "record_id"])


def p5_record_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and tokens of every record."""
    c = counted_records(spark, sf_dir).select("record_id", "pieces", "tokens")
    return c.groupBy("record_id").agg(F.min("pieces").alias("pieces"), F.min("tokens").alias("tokens"))


def p5_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language, orthography and domain, one slice a row; '(none)' where a record has no value.

    The language is that of the text: see problem 1; here the languages found are joined with '+'.
    """
    from textkraal.llm.p1_language import detect_languages, filters_for

    r = load(spark, sf_dir, "corpus_records").where("record_id is not null").select("record_id", "text", "source", "orthography", "source_type")
    found = detect_languages(token_counts(r, read_merges(spark, sf_dir)), filters_for(spark, sf_dir))
    flat = found.select(
        "record_id", "pieces", "tokens", F.array_join(F.array_sort("languages"), "+").alias("language"),
        clean_key(F.col("source")).alias("source"), clean_key(F.col("orthography")).alias("orthography"), clean_key(F.col("source_type")).alias("domain"),
    )
    once = _once(flat)
    slices = F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), F.coalesce(F.col(k), F.lit("(none)")).alias("value")) for k in ("source", "language", "orthography", "domain")]))
    return (
        once.select("pieces", "tokens", slices.alias("s")).groupBy("s.slice", "s.value")
        .agg(F.count("*").alias("records"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    )


SQL = {
    "p5_found": r"""SELECT DISTINCT record_id FROM corpus_records WHERE record_id IS NOT NULL AND (token_count IS NULL OR token_count <>
      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0d\x1c-\x1f\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')))""",
}
QUERIES = {"p5_found": p5_found, "p5_record_tokens": p5_record_tokens, "p5_token_budget": p5_token_budget}
