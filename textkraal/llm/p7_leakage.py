"""Problem 7: evaluation texts leaking into training text.

A generalised suffix automaton of the normalised test items; the characters of a document are streamed through it
while the length of the longest match is tracked. A stretch counts where it covers a passage of `words` consecutive
words of an item, or a whole shorter item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textkraal.functions.normalize import letters_digits
from textkraal.llm._flat import codes_of, gram_hashes
from textkraal.session import load

WORDS = 10
#: Characters of items in one automaton, which is broadcast (some 500 bytes a character). More items go in blocks, each
#: of which is one pass over the documents.
BLOCK_CHARS = 400_000
#: Old spelling and the letters it stands for (fixed values).
OLD_SPELLING = {"6": "bh", "5": "hl"}
_OTHER = re.compile(r"[\W_]+")


def bare(text: str) -> str:
    """Letters and digits, lower case, old spelling replaced."""
    t = _OTHER.sub("", text.lower())
    for a, b in OLD_SPELLING.items():
        t = t.replace(a, b)
    return t


def passages(text: str, words: int = WORDS) -> list[str]:
    """The normalised passages of an item: each run of `words` words, or the whole item if it has fewer."""
    w = [bare(x) for x in text.split()]
    n = max(1, len(w) - words + 1)
    return [p for i in range(n) if (p := "".join(w[i : i + words]))]


class SuffixAutomaton:
    """Generalised suffix automaton of all items, with the passages that end in each state."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, text in items:
            last = 0
            for ch in bare(text):
                last = self._extend(last, ch)
        found: dict[str, set[int]] = {}
        for item, text in items:
            for p in passages(text, words):
                found.setdefault(p, set()).add(item)
        self.ends: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for p, who in found.items():
            at = 0
            for ch in p:
                at = self.next[at][ch]
            self.ends.setdefault(at, []).append((len(p), tuple(sorted(who))))
        # the nearest state up the suffix links, itself included, in which a passage ends
        self.above = [-1] * len(self.len)
        for v in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.above[v] = v if v in self.ends else (self.above[self.link[v]] if v else -1)
        self.passages = sorted(found)

    def _extend(self, last: int, ch: str) -> int:
        nxt, link, ln = self.next, self.link, self.len
        if ch in nxt[last]:
            q = nxt[last][ch]
            return q if ln[q] == ln[last] + 1 else self._clone(last, q, ch)
        cur = len(ln)
        ln.append(ln[last] + 1)
        nxt.append({})
        link.append(0)
        p = last
        while p != -1 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][ch]
            link[cur] = q if ln[q] == ln[p] + 1 else self._clone(p, q, ch)
        return cur

    def _clone(self, p: int, q: int, ch: str) -> int:
        c = len(self.len)
        self.len.append(self.len[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = c
        while p != -1 and self.next[p].get(ch) == q:
            self.next[p][ch] = c
            p = self.link[p]
        return c

    def matches(self, text: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, end, items) of every passage in a normalised text, from the longest match at each character."""
        nxt, link, ln, above, ends = self.next, self.link, self.len, self.above, self.ends
        at = length = 0
        for i, ch in enumerate(text):
            while at and ch not in nxt[at]:
                at = link[at]
                length = ln[at]
            if ch in nxt[at]:
                at = nxt[at][ch]
                length += 1
                v = above[at]
                while v > 0:
                    for m, who in ends[v]:
                        if m <= length:
                            yield i + 1 - m, i + 1, who
                    v = above[link[v]]


class Screen:
    """Rules out texts without the first characters of any passage, by hash; it never rules out a match.

    Passages are screened by their first 16 characters, shorter ones apart by their first 8, 4, 2 or 1, so that a short
    item does not let every text through for the others.
    """

    BITS = 1 << 20

    def __init__(self, passages: list[str]):
        self.by: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k in (16, 8, 4, 2, 1):
            heads = sorted({p[:k] for p in passages if k <= len(p) and (k == 16 or len(p) < 2 * k)})
            if heads:
                known = np.unique(gram_hashes(codes_of(heads)[0], k)[::k])
                on = np.zeros(self.BITS, dtype=bool)
                on[(known % np.uint64(self.BITS)).astype(np.int64)] = True
                self.by.append((k, on, known))

    def passed(self, texts: list[str]) -> np.ndarray:
        """Indices of the texts that may hold a passage."""
        flat, off = codes_of(texts)
        out = [np.zeros(0, np.int64)]
        for k, on, known in self.by:
            h = gram_hashes(flat, k)
            hit = np.flatnonzero(on[(h % np.uint64(self.BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
            hit = hit[known[at] == h[hit]]  # the map alone lets one position in a hundred through
            out.append(np.searchsorted(off, hit, side="right") - 1)
        return np.unique(np.concatenate(out))


def blocks(items: list[tuple[int, str]], most: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """The items in order, in blocks of at most `most` characters; a longer item is a block of its own. One block at least."""
    out: list[list[tuple[int, str]]] = [[]]
    size = 0
    for item in items:
        if out[-1] and size + len(item[1]) > most:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item[1])
    return out


def read_items(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """The test items: 300 rows, a table of fixed size. Items without a letter or digit can't leak."""
    rows = load(spark, sf_dir, "eval_items").select("item_id", "text").dropna().dropDuplicates().collect()
    return [(r[0], r[1]) for r in rows if bare(r[1])]


def _norm(text: str) -> Column:
    """bare() of a column; null as an empty text."""
    norm = letters_digits(F.col(text))
    for a, b in OLD_SPELLING.items():
        norm = F.replace(norm, F.lit(a), F.lit(b))
    return F.coalesce(norm, F.lit(""))


def leaked(docs: DataFrame, items: list[tuple[int, str]], key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, item_id) of every document that holds a passage of an item.

    More than BLOCK_CHARS characters of items are taken in blocks, so what is broadcast is bounded. Null and empty texts hold none; repeated documents give repeated rows; without items there are no rows.
    """
    if len(parts := blocks(items)) > 1:
        return reduce(DataFrame.union, [leaked(docs, part, key, text, words) for part in parts])
    auto = SuffixAutomaton(items, words)
    shared = docs.sparkSession.sparkContext.broadcast((auto, Screen(auto.passages)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, screen = shared.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            at, who = [], []
            for i in screen.passed(texts).tolist():
                found = {x for _, _, items in auto.matches(texts[i]) for x in items}
                at += [i] * len(found)
                who += sorted(found)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(who, pa.int64())], names=[key, "item_id"])

    d = docs.select(F.col(key), _norm(text).alias("norm"))
    return d.mapInArrow(run, f"`{key}` {kind}, item_id bigint")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return leaked(load(spark, sf_dir, "documents").where("doc_id is not null"), read_items(spark, sf_dir)).distinct()


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents it leaked into."""
    n = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    items = load(spark, sf_dir, "eval_items").select("item_id", "suite").distinct()
    return items.join(n, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))


def positions(text: str) -> tuple[str, list[int]]:
    """The normalised text and, for each of its characters, where it stands in the text."""
    out, at = [], []
    for i, ch in enumerate(text):
        s = bare(ch)
        out.append(s)
        at += [i] * len(s)
    return "".join(out), at


def cleaned(docs: DataFrame, items: list[tuple[int, str]], key: str = "doc_id", text: str = "text", words: int = WORDS, coverage: float = 0.5) -> DataFrame:
    """(key, clean_text, removed_chars): the matched stretches cut out; null if they cover more than `coverage` of the text.

    Only documents with a leak are rewritten; the others keep their text and have 0 removed characters.
    """
    of_block = []
    for part in blocks(items):
        auto = SuffixAutomaton(part, words)
        of_block.append(docs.sparkSession.sparkContext.broadcast((auto, Screen(auto.passages))))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, norm = b.column(1).to_pylist(), b.column(2).to_pylist()
            cut, gone = [0] * len(texts), {}
            for part in of_block:
                auto, screen = part.value
                for i in screen.passed(norm).tolist():
                    own, at = positions(texts[i])
                    for s, e, _ in auto.matches(own):
                        gone.setdefault(i, np.zeros(len(texts[i]), dtype=bool))[at[s] : at[e - 1] + 1] = True
            for i, g in gone.items():
                cut[i] = int(g.sum())
                texts[i] = None if cut[i] > coverage * len(g) else "".join(c for c, x in zip(texts[i], g) if not x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(cut, pa.int64())], names=[key, "clean_text", "removed_chars"])

    return docs.select(key, text, _norm(text).alias("_norm")).mapInArrow(run, f"`{key}` {kind}, clean_text string, removed_chars bigint")


def p7_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with leaked stretches cut out, or dropped (null) where those are more than half of the text."""
    return cleaned(load(spark, sf_dir, "documents").where("doc_id is not null"), read_items(spark, sf_dir))


_BARE = "replace(replace(regexp_replace(lower({}), '[^\\pL\\pN]', '', 'g'), '6', 'bh'), '5', 'hl')"
SQL = {
    "p7_found": f"""WITH w AS (
      SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL
    ), p AS (
      SELECT DISTINCT item_id, {_BARE.format("array_to_string(list_slice(w, i, i + 9), '')")} AS p
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM w)
    ), d AS (SELECT doc_id, {_BARE.format("text")} AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
    SELECT DISTINCT doc_id, item_id FROM d JOIN p ON p <> '' AND contains(t, p)""",
}
SQL["p7_leaked_items"] = f"SELECT DISTINCT e.item_id, e.suite, coalesce(n, 0) AS documents FROM eval_items e LEFT JOIN (SELECT item_id, count(*) AS n FROM ({SQL['p7_found']}) GROUP BY 1) USING (item_id)"
QUERIES = {"p7_found": p7_found, "p7_leaked_items": p7_leaked_items, "p7_clean_documents": p7_clean_documents}
