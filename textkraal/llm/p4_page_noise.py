"""Problem 4: noise in text from scanned pages.

Words parted at line ends, headers and page numbers are read off the page itself. Misrecognised letters inside words
need the corpus: a frequency lexicon of all texts, a symmetric-delete index over it (rare and lexicon words meet where
their shapes, with or without one letter, are equal; a shape has confusable letters made equal), and a weighted edit
distance in which pairs that scanners confuse are cheap. Of several candidates the one of least cost that follows the
word before more often is taken.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkraal.llm._flat import codes_of, mix, segment_hashes
from textkraal.llm.p3_linked_splits import NOTE, work_key
from textkraal.session import load, materialize

#: What a scanner reads and what was printed (fixed values), with the cost of taking one for the other.
CONFUSED = {"c": "e", "b": "h", "n": "u", "i": "l", "!": "i", "rn": "m", "ri": "n", "cl": "d", "vv": "w", "lc": "k", "v": "y"}
SIGNS = {"0": "o", "1": "l", "2": "z", "9": "g", "!": "i", "@": "a", "¢": "e", "$": "s", "†": "t"}
STRAY = "`~^¦°·"
COST = {"c": 0.4, "b": 0.5, "n": 0.5, "i": 0.5, "!": 0.1, "rn": 0.3, "ri": 0.3, "cl": 0.3, "vv": 0.1, "lc": 0.3, "v": 0.5}
#: Cost of any other edit, and the most that a misreading may cost: four cheap confusions, or one edit and one of them.
OTHER, MOST_COST = 1.2, 1.7
#: Letters of the shortest words, and of the shapes, that are looked up by symmetric deletes.
SHORTEST, LONG = 3, 7
#: A lexicon word must be this often in the corpus, and so many times as often as the suspect.
KNOWN, TIMES, TIMES_ON_NOISY_PAGES, TIMES_ANY_EDIT = 4, 60, 6, 600
#: Slots of the sketches of word pairs and of suspects: fixed, whatever the input.
PAIR_SLOTS, SUSPECT_BITS = 1 << 20, 1 << 24

L = r"[^\W\d_]"
HYPHEN = re.compile(
    rf"(?<={L})(?:\s?[-‐¬\xad] ?\n\s*|[‐¬\xad] +)(?={L})|(?<=[^\W\d_A-Z])(?:- +| - )(?=[a-z])"
)
MISREAD = re.compile(
    rf"(?<={L})[@¢$†{STRAY}]|[@¢$†{STRAY}](?={L})|(?<={L})[0129](?={L})|(?<={L}{L})[0129](?![\w-])|(?<!\S)[0129](?={L}{{3}})"
    rf"|(?<={L})!(?=[a-z])|(?<!\S)!(?={L})|(?<=[a-z][a-z])I(?=[a-z])"
)
WORD = re.compile(rf"{L}(?:{L}|[56]|(?<={L})[-'’](?={L}))+(?:!(?=\s[a-z]))?")
#: Texts that don't match these have nothing for the longer patterns to find.
_HYPHEN_AT = re.compile(r"[‐¬\xad-] ?[\n ]")
_SIGN_AT = re.compile(rf"[@¢$†{STRAY}]|[0129!](?=[^\W\d_])|(?<=[^\W\d_])[0129]|(?<=[a-z])I")
_NUMBER_AT = re.compile(r"\d|(?<= )[ivxlIVXL]{2,}(?= |$)")
_ROMAN = r"(?:x{0,3}(?:ix|iv|v?i{1,3}|v)|x{1,3}|x{0,2}l?x{0,3}(?:ix|iv|v?i{0,3})?)"
_NUMBER = rf"(?:\d{{1,3}}|{_ROMAN})"
PAGE_LINE = re.compile(rf"[^\w\n]*(?:(?:iphepha|page|p)\b[.\s]*\d{{1,3}}|{_NUMBER})[^\w\n]*", re.I)
PAGE_INLINE = re.compile(
    rf"\b(?:iphepha|page|p\.)\s*\d{{1,3}}\b|(?<!\S)\[\d{{1,3}}\](?!\S)|(?<!\S)\(\s*\d{{1,3}}\s*\)(?!\S)|(?<!\S)[—-]\s*\d{{1,3}}\s*[—-](?!\S)"
    rf"|(?<!\S)\d{{1,3}}\.?(?!\S)(?:\s\|)?|(?<!\S)(?=[ivxl]{{2}}){_ROMAN}(?!\S)", re.I
)
HEAD_NUMBER = re.compile(rf"^\s*(?:\W?\s*\d{{1,3}}\s*\W?\s{{2,}})|\s{{2,}}\W?\s*\d{{1,3}}\s*\W?\s*$|(?:—|-)\s*\[\d{{1,3}}\]\s*$|^\s*\[\d{{1,3}}\]\s*|\s*\[\d{{1,3}}\]\s*$")
_NOTE = re.compile(NOTE.replace(r"\p{P}", r"!-/:-@\[-`{-~—–‐”“").replace(r"\p{L}", r"^\W\d_").replace("[^\\W\\d_]*", "\\w*"))
_FOLD = str.maketrans({**{chr(c): None for c in range(128) if not chr(c).isalpha()}, **SIGNS, **{c: None for c in STRAY}})
_SAME = str.maketrans({"b": "h", "c": "e", "u": "n", "i": "l"})
_TWO = sorted((p, q) for p, q in CONFUSED.items() if len(p) == 2)
_ONE = str.maketrans({p: q for p, q in CONFUSED.items() if len(p) == 1 and p != "!"} | {"!": CONFUSED["i"]})
_PAIRS = [(x, y, COST[p]) for p, q in CONFUSED.items() for x, y in ((p, q), (q, p))]


def fold(s: str) -> str:
    """Letters of a heading, confusable ones made equal."""
    return _fold_letters(s.lower().translate(_FOLD))


def _fold_letters(s: str) -> str:
    if s and not s.isalpha():
        s = re.sub(r"[\W\d_]+", "", s)
    return s.replace("rn", "m").replace("ri", "n").replace("vv", "w").replace("cl", "d").translate(_SAME)


@lru_cache(maxsize=20_000)
def title_starts(title: str | None) -> list[str]:
    """The folded beginnings, of at least two words, of a title without its closing note."""
    if not title:
        return []
    w = [fold(x) for x in _NOTE.sub("", title).split()]
    out, at = [], ""
    for k, x in enumerate(w):
        at += x
        if k and len(at) >= 8:
            out.append(at)
    return out


_DIGIT = re.compile(r"\d")


def _alike(f: str, s: str) -> bool:
    """Whether two folded headings are nearly the same."""
    if abs(len(f) - len(s)) > 2 or len(s) < 13:
        return False
    # each letter that is in one of them only breaks one block of four letters at most
    whole = sum(s[i : i + 4] in f for i in range(0, len(s) - 3, 4))
    if whole < len(s) // 4 - 0.07 * (len(f) + len(s)):
        return False
    return difflib.SequenceMatcher(None, f, s).ratio() > 0.93


#: The letters that a folded first letter may have been.
_HEADS = {"h": "bh", "e": "ce", "n": "unr", "l": "il", "m": "mr", "w": "wv", "d": "dc"}


class Page:
    """What a text shows of page noise by itself; spans are half-open offsets."""

    def __init__(self, text: str, title: str | None):
        self.text = text
        self.hyphens = [m.span() for m in HYPHEN.finditer(text)] if _HYPHEN_AT.search(text) else []
        self.headers: list[tuple[int, int]] = []
        self.numbers: list[tuple[int, int]] = []
        self.lines: list[tuple[str, int, int]] = []  # lines that may be the heading of another title
        starts = title_starts(title)
        many = "\n" in text
        if many:
            at = 0
            for line in text.split("\n"):
                self._line(line, at, starts)
                at += len(line) + 1
        else:
            if text.count(" ") > 2 and _NUMBER_AT.search(text):
                self.numbers = [m.span() for m in PAGE_INLINE.finditer(text)]
            if starts:
                self._inline(starts, title[0].islower())
        self.headers, self.numbers = sorted(set(self.headers)), sorted(set(self.numbers))
        self.misread = [m.span() for m in (MISREAD.finditer(text) if _SIGN_AT.search(text) else ()) if not any(s <= m.start() < e for s, e in self.headers)]

    def _line(self, line: str, at: int, starts: list[str]) -> None:
        if PAGE_LINE.fullmatch(line) and line.strip() and re.search(r"\w", line):
            self.numbers.append((at, at + len(line)))
            return
        rest = HEAD_NUMBER.sub(" ", line) if _DIGIT.search(line) else line
        t = rest.lower().translate(_FOLD)
        if starts and rest is line and not len(starts[0]) - 3 < len(t) < len(starts[-1]) + 3 + t.count("r") + t.count("v") + t.count("c"):
            return  # too short or too long for the title, however many pairs of letters become one
        f = _fold_letters(t)
        n = len(rest.split())
        if f and starts and any(f == s or _alike(f, s) for s in starts):
            self.headers.append((at, at + len(line)))
            if rest != line and re.search(r"\d", line):
                self.numbers.append((at, at + len(line)))
        elif rest != line and 1 < n <= 8 and re.search(r"\d", line) and len(f) >= 8:
            self.headers.append((at, at + len(line)))
            self.numbers.append((at, at + len(line)))
        elif n > 1 and 8 <= len(f) <= 80:
            self.lines.append((f, at, at + len(line)))

    def _inline(self, starts: list[str], lower: bool) -> None:
        tokens = [m.span() for m in re.finditer(r"\S+", self.text)]
        whole, ends = starts[-1], set(starts)
        heads = _HEADS.get(whole[0], whole[0])
        for i, (a, b) in enumerate(tokens):
            c = self.text[a]
            if c.islower() and not lower or c.isalpha() and c.lower() not in heads or not (f := fold(self.text[a:b])) or not whole.startswith(f):
                continue
            got, best = f, None
            for x, y in tokens[i + 1 : i + 60]:
                got += fold(self.text[x:y])
                if not whole.startswith(got):
                    break
                if got in ends:
                    best = y
            if best:
                self.headers.append((a, best))

    def openings(self) -> list[str]:
        """Folded runs of two to seven tokens from each capital on, in a text of one line."""
        if "\n" in self.text:
            return []
        t = self.text.split()
        f = [fold(x) for x in t]
        return ["".join(f[i : i + k]) for i, x in enumerate(t) if x[:1].isupper() for k in range(2, 8) if i + k <= len(t)]

    def kinds(self) -> set[str]:
        return {k for k, v in (("hyphenation", self.hyphens), ("header", self.headers), ("page_number", self.numbers), ("misread", self.misread)) if v}

    def word_set(self) -> set[str]:
        """The lower-case words outside headers, parted words joined."""
        if self.headers or self.numbers:
            return {w for w, _, _ in self.words()}
        return set(map(str.lower, WORD.findall(HYPHEN.sub("", self.text) if self.hyphens else self.text)))

    def words(self) -> list[tuple[str, int, int]]:
        """Lower-case words outside headers, parted words joined: (word, start, end)."""
        keep, at = [], []
        skip = sorted(self.hyphens + self.headers + self.numbers)
        pos = 0
        hy = set(self.hyphens)
        for s, e in skip:
            if s < pos:
                continue
            keep.append(self.text[pos:s])
            at.extend(range(pos, s))
            if (s, e) not in hy:
                keep.append("\n")
                at.append(s)
            pos = e
        keep.append(self.text[pos:])
        at.extend(range(pos, len(self.text) + 1))
        t = "".join(keep)
        return [(m[0].lower(), at[m.start()], at[m.end() - 1] + 1) for m in WORD.finditer(t)]


def _hash(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    flat, off = codes_of(words)
    return segment_hashes(flat, off[:-1], off[1:])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, noisy): words of a task, and how many of them stand in texts with parted words or signs inside words."""
    n, noisy = Counter(), Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            parted = bool(_HYPHEN_AT.search(text) and HYPHEN.search(text))
            w = list(map(str.lower, WORD.findall(HYPHEN.sub("", text) if parted else text)))
            n.update(w)
            if parted or _SIGN_AT.search(text) and MISREAD.search(text):
                noisy.update(w)
        if len(n) > 300_000:
            yield _rows(n, noisy)
            n, noisy = Counter(), Counter()
    yield _rows(n, noisy)


def _rows(n: Counter, noisy: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([noisy[w] for w in n], pa.int64())], names=["word", "n", "noisy"])


def shapes(word: str) -> tuple[str, ...]:
    """A word with all that scanners confuse made equal: the single letters, and before them the segments of two.

    Words that differ in nothing else agree in one of the two.
    """
    single = word.translate(_ONE)
    for two, one in _TWO:
        word = word.replace(two, one)
    word = word.translate(_ONE)
    return (single,) if word == single else (single, word)


def distance(a: str, b: str) -> float:
    """Weighted edit distance: confusable segments cost COST, in either direction, any other edit costs OTHER."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    i = max(0, i - 1)  # a segment of two letters may begin with an equal one
    a, b = a[i:], b[i:]
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
        k += 1
    k = max(0, k - 1)
    a, b = a[: len(a) - k], b[: len(b) - k]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) + 1):
        for y in range(len(b) + 1):
            if not x and not y:
                continue
            d = [best[x - 1][y] + OTHER] if x else []
            if y:
                d.append(best[x][y - 1] + OTHER)
            if x and y:
                d.append(best[x - 1][y - 1] + (0 if a[x - 1] == b[y - 1] else OTHER))
            for p, q, c in _PAIRS:
                if a.endswith(p, 0, x) and b.endswith(q, 0, y):
                    d.append(best[x - len(p)][y - len(q)] + c)
            best[x][y] = min(d)
    return best[-1][-1]


def _deletes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symmetric-delete keys of words: each shape, and if it is long enough the shape without each of its letters."""
    for b in batches:
        keys, of, whole = [], [], []
        for i, w in enumerate(b.column("word").to_pylist()):
            for f in shapes(w):
                own = {f, *(f[:j] + f[j + 1 :] for j in range(len(f)))} if len(f) >= LONG else {f}
                keys += own
                of += [i] * len(own)
                whole += [f] * len(own)
        take = pa.array(of, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(_hash(keys).view(np.int64)), pa.array(whole, pa.string()), *[c.take(take) for c in b.columns]], names=["key", "shape", *b.schema.names])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cost = [distance(x, y) for x, y in zip(b.column("word").to_pylist(), b.column("right").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("right"), pa.array(cost, pa.float64()), b.column("n")], names=["word", "right", "cost", "n"])


def corrections(texts: DataFrame) -> DataFrame:
    """(word, right, cost, n): lexicon words that a rare word may be a misreading of. texts: (text).

    Words whose shapes are equal differ by confusable segments only, any number of them, read either way. Shapes one edit
    apart meet at a common delete; that is taken for a misreading only in a long word that stands on noisy pages alone.
    """
    schema = "word string, n long, noisy long"
    words = texts.mapInArrow(_count, schema).groupBy("word").agg(F.sum("n").alias("n"), F.sum("noisy").alias("noisy"))
    words = materialize(words.where(F.length("word") >= SHORTEST), "p4words")
    keyed = materialize(words.mapInArrow(_deletes, f"key long, shape string, {schema}"), "p4keys")
    lex = keyed.where((F.col("n") >= KNOWN) & ~F.col("word").endswith("!")).select("key", F.col("shape").alias("printed"), F.col("word").alias("right"), F.col("n").alias("often"))
    met = keyed.join(lex, "key").where("word <> right")
    on_noisy = F.col("noisy") >= 0.8 * F.col("n")
    same = F.col("shape") == F.col("printed")
    # in a short word one letter is a large part, and shapes meet by chance
    times = F.when(on_noisy & (F.length("shape") >= 4), TIMES_ON_NOISY_PAGES).otherwise(TIMES)
    edit = on_noisy & (F.col("n") <= 2) & (F.length("shape") >= LONG) & (F.col("often") >= TIMES_ANY_EDIT * F.col("n")) & (F.levenshtein("shape", "printed") <= 1)
    edit = edit & ~F.contains("right", "word") & ~F.contains("word", "right")  # a word cut off at an end of the text
    met = met.where((same & (F.col("often") >= times * F.col("n"))) | (~same & edit))
    met = met.groupBy("word", "right").agg(F.max("often").alias("n")).mapInArrow(_measured, "word string, right string, cost double, n long")
    return met.where(F.col("cost") <= MOST_COST)


def _sketch(df: DataFrame, bits: int) -> np.ndarray:
    """A fixed-size map of the hashes in column h."""
    words = df.select(F.shiftrightunsigned("h", 64 - bits.bit_length() + 1).alias("at")).select(
        F.shiftright("at", 6).alias("slot"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")
    ).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["slot"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _with_hash(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_hash(b.column(0).to_pylist()).view(np.int64))], names=["word", "h"])

    return words.select("word").mapInArrow(run, "word string, h long")


def noise(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(kinds, fixes, heads, misread): (record_id, noise_kind); (word, right, cost, n) of misread words; the headings
    and the misread words (record_id, value) of each record.

    Null texts and ids are left out; empty texts have no noise; repeated rows count once.
    """
    spark = records.sparkSession
    r = records.where("record_id is not null and text is not null").select("record_id", "text", "source_title")
    fixes = materialize(corrections(r.select("text")), "p4fixes")
    suspects = _with_hash(fixes.select("word").distinct())
    known = work_key(F.col("source_title"))
    bits = _sketch(suspects, SUSPECT_BITS)

    def prefixes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([s for t in b.column(0).to_pylist() for s in title_starts(t)], pa.string())], names=["word"])

    titles = materialize(r.where(known.isNotNull()).select("source_title").distinct().mapInArrow(prefixes, "word string").distinct(), "p4titles")
    shared = spark.sparkContext.broadcast((bits, _sketch(_with_hash(titles), SUSPECT_BITS)))

    def met(words: list[str], which: int) -> list[int]:
        at = _hash(words) >> np.uint64(64 - SUSPECT_BITS.bit_length() + 1)
        return np.flatnonzero((shared.value[which][(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).tolist()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str, str | None]] = []
            words, owner, heads, of = [], [], [], []
            for rid, text, title, named in zip(*(b.column(k).to_pylist() for k in range(4))):
                p = Page(text, title if named else None)
                out += [(rid, k, None) for k in p.kinds()]
                if not named:
                    h = [f for f, _, _ in p.lines] if len(p.lines) > 1 else p.openings()
                    heads += h
                    of += [rid] * len(h)
                w = {x for x in p.word_set() if len(x) >= 4}
                words += w
                owner += [rid] * len(w)
            out += [(owner[i], "word", words[i]) for i in met(words, 0)]
            out += [(of[i], "line", heads[i]) for i in met(heads, 1)]
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["record_id", "what", "value"])

    seen = materialize(r.select("record_id", "text", "source_title", known.isNotNull().alias("named")).mapInArrow(scan, "record_id string, what string, value string"), "p4seen")
    misread = seen.where("what = 'word'").join(fixes.select(F.col("word").alias("value")).distinct(), "value", "left_semi")

    heads = seen.where("what = 'line'").join(titles.withColumnRenamed("word", "value"), "value", "left_semi")
    kinds = seen.where("what not in ('word', 'line')").select("record_id", F.col("what").alias("noise_kind"))
    kinds = kinds.union(misread.select("record_id", F.lit("misread"))).union(heads.select("record_id", F.lit("header")))
    return kinds.distinct(), fixes, heads.select("record_id", "value"), misread.select("record_id", "value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and kind of page noise in its text."""
    return noise(load(spark, sf_dir, "corpus_records"))[0]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring words by slot, of one task."""
    n = np.zeros(PAIR_SLOTS, dtype=np.int64)
    for b in batches:
        w: list[str] = []
        for text in b.column(0).to_pylist():
            w += [*(m.lower() for m in WORD.findall(HYPHEN.sub("", text))), "\n"]
        n += np.bincount(_pair_slots(w), minlength=PAIR_SLOTS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])


def _pair_slots(words: list[str]) -> np.ndarray:
    h = _hash(words)
    with np.errstate(over="ignore"):
        return (mix(h[:-1] * np.uint64(31) + h[1:]) % np.uint64(PAIR_SLOTS)).astype(np.int64)


def repair(text: str, title: str | None, heads: set[str], right: dict[str, list[tuple[str, float, int]]], pairs: np.ndarray) -> str:
    """A text as continuous paragraphs: headers and page numbers out, parted words joined, misread words put right.

    Verse, lines that nearly all start with a capital while none parts a word, keeps its lines. Of the lexicon words a
    misread word may stand for, the one with the least cost less the logarithms of its count and of its count after
    the word before is taken.
    """
    p = Page(text, title)
    gone = sorted(set(p.headers + p.numbers + [(a, b) for f, a, b in p.lines if f in heads]))
    body, at = [], 0
    for a, b in gone:
        if a >= at:
            body.append(text[at:a] if not text[:a].rstrip(" \n")[-1:] in "-‐¬\xad" else text[at:a].rstrip("\n") + "\n")
            at = b
    t = "".join([*body, text[at:]]) if gone else text
    t = re.sub(r" {2,}", " ", re.sub(r"\n\s*\n", "\n", t.strip("\n"))) if gone else t
    hyphens = list(HYPHEN.finditer(t))
    t = HYPHEN.sub("", t)
    t = re.sub(rf"(?<={L})[{STRAY}]|[{STRAY}](?={L})", "", t)

    def sign(m: re.Match) -> str:
        s = m[0]
        return s.translate(str.maketrans({**SIGNS, "I": "l" if m.start() else "I"}))

    t = MISREAD.sub(sign, t)
    before = [""]

    def word(m: re.Match) -> str:
        w = m[0].lower()
        options = right.get(w)
        if options:
            if len(options) > 1:
                near = pairs[_pair_slots([x for o in options for x in (before[0] or "\n", o[0])])[::2]]
                best = min(zip(options, near), key=lambda o: (o[0][1] - 0.2 * np.log(o[0][2]) - 0.6 * np.log1p(o[1]), o[0][0]))[0][0]
            else:
                best = options[0][0]
            out = best[0].upper() + best[1:] if m[0][0].isupper() else best
            same = next((k for k, (x, y) in enumerate(zip(out.lower(), m[0].lower())) if x != y), min(len(out), len(m[0])))
            out = m[0][:same] + out[same:]
        else:
            best, out = w, m[0]
        before[0] = best
        return out

    t = WORD.sub(word, t)
    lines = [x.strip() for x in t.split("\n") if x.strip()]
    verse = len(lines) > 2 and not hyphens and sum(x[:1].isupper() for x in lines) >= 0.8 * len(lines)
    return t if verse else re.sub(r"[ \t]*\n[ \t]*", " ", re.sub(r"\n\s*\n+", "\x00", t)).replace("\x00", "\n\n").strip()


def repaired(records: DataFrame) -> DataFrame:
    """(record_id, noise_kinds, repaired_text, original_noise_kinds, repaired_original) of every record.

    The last two are those of original_text, the raw page, where the column is given. A page that differs from the text
    counts in the lexicon like a text; one that is a copy is repaired as the text is. What has no noise is left as it is.
    Repeated rows count once; null texts and pages stay null.
    """
    spark = records.sparkSession
    raw = F.col("original_text") if "original_text" in records.columns else F.lit(None).cast("string")
    r = records.where("record_id is not null").select("record_id", "text", raw.alias("original"), "source_title")
    other = (F.coalesce(F.trim("original"), F.lit("")) != "") & ~F.col("original").eqNullSafe(F.col("text"))
    pages = r.select(F.concat(F.lit("t"), "record_id").alias("record_id"), "text", "source_title").union(
        r.where(other).select(F.concat(F.lit("o"), "record_id"), "original", "source_title")
    )
    kinds, fixes, heads, misread = noise(pages)
    small = pages.dropDuplicates(["record_id"]).where("text is not null").select("text").mapInArrow(_pairs, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(PAIR_SLOTS)
    pairs[small["slot"].to_numpy()] = small["n"].to_numpy()  # at most PAIR_SLOTS rows
    shared = spark.sparkContext.broadcast(pairs)
    per = misread.distinct().join(fixes.withColumnRenamed("word", "value"), "value")
    per = per.groupBy("record_id").agg(F.collect_list(F.struct("value", "right", "cost", "n")).alias("right"))  # the words of one text
    per_head = heads.groupBy("record_id").agg(F.collect_set("value").alias("heads"))
    per_kind = kinds.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("noise_kind")), "+").alias("noise_kinds"))
    named = work_key(F.col("source_title")).isNotNull().alias("named")
    x = r.dropDuplicates(["record_id"])
    of = []
    for field in ("t", "o"):
        for d, c in ((per_kind, "noise_kinds"), (per, "right"), (per_head, "heads")):
            own = d.where(F.col("record_id").startswith(field)).select(F.expr("substring(record_id, 2)").alias("record_id"), F.col(c).alias(f"{field}_{c}"))
            x = x.join(own, "record_id", "left")
            of.append(f"{field}_{c}")

    def one(text, title, kinds, right, heads):
        if kinds is None or text is None:
            return text
        by: dict[str, list[tuple[str, float, int]]] = {}
        for o in right or ():
            by.setdefault(o["value"], []).append((o["right"], o["cost"], o["n"]))
        return repair(text, title, set(heads or ()), by, shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, originals, original_kinds = [], [], []
            for text, original, title, named, *found in zip(*(b.column(k).to_pylist() for k in range(1, 11))):
                title = title if named else None
                texts.append(one(text, title, *found[:3]))
                copy = original is not None and original == text
                originals.append(texts[-1] if copy else one(original, title, *found[3:]))
                original_kinds.append(found[0] if copy else found[3])
            cols = [b.column(0), b.column(5), pa.array(texts, pa.string()), pa.array(original_kinds, pa.string()), pa.array(originals, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["record_id", "noise_kinds", "repaired_text", "original_noise_kinds", "repaired_original"])

    x = x.select("record_id", "text", "original", "source_title", named, *of)
    return x.mapInArrow(run, "record_id string, noise_kinds string, repaired_text string, original_noise_kinds string, repaired_original string")


def p4_repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's text and original_text, repaired."""
    return repaired(load(spark, sf_dir, "corpus_records"))


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found, "p4_repaired_texts": p4_repaired_texts}
