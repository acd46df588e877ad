"""Near-equal texts by their character pieces: candidates through inverted lists of minwise terms, then the exact share.

The terms of a text are conjunctions of `width` pieces: those of least value under `width` hash functions, `bands` times.
Whether two texts share one depends on their similarity J alone: they share none with probability (1 - J**width)**bands.
So common phrases make no long lists, and a family of near copies is found like two texts are. Within a list, pairs are
pruned by bounds that follow from the similarity: the sizes n and m of the sets differ by the threshold at most, and no
more than (1 - t) / (1 + t) * (n + m) pieces, so no more parities of hashed pieces, differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkraal.session import materialize

#: A term whose list gives more pairs than this is split by a salt.
HOT = 4_000_000
MULT, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1_000_003)
Batches = Iterator[pa.RecordBatch]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the n + 1 offsets."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return flat, off


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * MULT
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from each position on; the last k - 1 positions are left out."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * BASE + flat[i : n + i].astype(np.uint64) + np.uint64(1)
    return mix(h)


def pieces_of(texts: list[str], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, piece): the distinct pieces of each of at most 65,536 texts, as 48-bit hashes, by row."""
    flat, off = codes_of(texts)
    h = gram_hashes(flat, gram)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(off))[: len(h)]
    whole = np.arange(len(h)) + gram <= off[row.astype(np.int64) + 1]
    key = np.sort((row[whole] << np.uint64(48)) | (h[whole] >> np.uint64(16)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def describing(gram: int, bands: int, width: int) -> Callable[[Batches], Batches]:
    """For mapInArrow: adds to rows with a column norm, each of `gram` characters or more, the number of pieces n, their
    parities p0 to p3 (256 bits) and the terms."""
    seed = np.arange(1, bands * width + 1, dtype=np.uint64)
    odd = (mix(seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (mix(seed + np.uint64(1000)) >> np.uint64(32)).astype(np.uint32)

    def run(batches: Batches) -> Batches:
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                rows, piece = pieces_of(b.column("norm").to_pylist(), gram)
                n = np.bincount(rows, minlength=b.num_rows)
                begin = np.cumsum(n) - n
                bit = piece & np.uint64(255)
                parity = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == q, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), begin) for q in range(4)]
                low = (mix(piece) >> np.uint64(32)).astype(np.uint32)
                terms = np.zeros((b.num_rows, bands), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(bands):
                        h = np.full(b.num_rows, k + 1, np.uint64)
                        for f in range(k * width, (k + 1) * width):
                            v = low * odd[f]
                            v ^= v >> np.uint32(15)
                            v += add[f]
                            v *= odd[f - 1]
                            h = mix(h * MULT + np.minimum.reduceat(v, begin))
                        terms[:, k] = h
                lists = pa.FixedSizeListArray.from_arrays(pa.array(terms.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64()))
                cols = [*b.columns, pa.array(n.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in parity], lists]
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "n", "p0", "p1", "p2", "p3", "terms"])

    return run


DESCRIBED = "n int, p0 long, p1 long, p2 long, p3 long, terms array<long>"


def _grams(s: str, gram: int) -> set[str]:
    return {s[i : i + gram] for i in range(len(s) - gram + 1)}


def exact(gram: int, threshold: float, keys: list[str], left: str, right: str, strict: bool = False) -> Callable[[Batches], Batches]:
    """For mapInArrow: the rows whose texts left and right have a share of pieces in common of `threshold` (over it, if
    strict), with the columns keys, cosine and jaccard: the dot product of the pieces over sizes and over the union."""

    def run(batches: Batches) -> Batches:
        for big in batches:
            for at in range(0, big.num_rows, 4000):
                b = big.slice(at, 4000)
                texts, hashed, sizes = [b.column(c).to_pylist() for c in (left, right)], [], []
                for side in texts:
                    row, piece = pieces_of(side, gram)
                    sizes.append(np.bincount(row, minlength=b.num_rows))
                    hashed.append((row.astype(np.uint64) << np.uint64(48)) | piece)
                key = np.sort(np.concatenate(hashed))
                both = key[1:][key[1:] == key[:-1]]
                dot = np.bincount((both >> np.uint64(48)).astype(np.int64), minlength=b.num_rows)
                union = sizes[0] + sizes[1] - dot
                for i in np.flatnonzero(np.abs(dot - threshold * union) <= 9):  # hashes may meet: near the limit the pieces themselves are compared
                    x, y = _grams(texts[0][i], gram), _grams(texts[1][i], gram)
                    sizes[0][i], sizes[1][i], dot[i] = len(x), len(y), len(x & y)
                    union[i] = len(x) + len(y) - dot[i]
                share = dot / np.maximum(union, 1)
                ok = np.flatnonzero(share > threshold if strict else share >= threshold - 1e-12)
                cols = [*[b.column(c).take(pa.array(ok)) for c in keys], pa.array(dot[ok] / np.sqrt(sizes[0][ok] * sizes[1][ok])), pa.array(share[ok])]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "cosine", "jaccard"])

    return run


def candidates(postings: DataFrame, threshold: float, cross: str | None = None) -> DataFrame:
    """(a, b): pairs of texts of postings(term, k, n, p0..p3) that share a term and pass the bounds; repeated ones too.

    cross names a boolean column: a is of those where it is false, b of those where it is true; else a < b.
    """
    p = postings
    left, right = (~F.col(cross), F.col(cross)) if cross else (F.lit(True), F.lit(True))
    both = p.groupBy("term").agg(F.count_if(left).alias("e"), F.count_if(right).alias("t")).where("e > 0 and t > 0")
    hot = both.select("term", F.ceil(F.col("e") * F.col("t") / HOT).cast("int").alias("parts")).where("parts > 1")
    few = hot.limit(10_001).count()
    one, other = p.where(left), p.where(right)
    if few:
        hot = F.broadcast(hot) if few <= 10_000 else hot
        parts = F.coalesce("parts", F.lit(1))
        one = one.join(hot, "term", "left").withColumn("salt", F.pmod("k", parts).cast("int")).drop("parts")
        other = other.join(hot, "term", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    else:
        one, other = one.withColumn("salt", F.lit(0)), other.withColumn("salt", F.lit(0))
    e, t = (x.select("term", "salt", *[F.col(c).alias(s + c) for c in ("k", "n", "p0", "p1", "p2", "p3")]) for s, x in (("e", one), ("t", other)))
    total = F.col("en").cast("long") + F.col("tn")
    differ = sum((F.bit_count(F.col(f"ep{q}").bitwiseXOR(F.col(f"tp{q}"))) for q in range(1, 4)), F.bit_count(F.col("ep0").bitwiseXOR(F.col("tp0"))))
    ok = (F.least("en", "tn") >= threshold * F.greatest("en", "tn") - 1e-9) & (differ <= (1 - threshold) / (1 + threshold) * total + 1e-9)
    if not cross:
        ok = ok & (F.col("ek") < F.col("tk"))
    return e.join(t, ["term", "salt"]).where(ok).select(F.col("ek").alias("a"), F.col("tk").alias("b"))


def near_pairs(texts: DataFrame, threshold: float, cross: str | None = None, gram: int = 5, bands: int = 16, width: int = 6, strict: bool = True) -> DataFrame:
    """(a, b, cosine, jaccard) of texts(k long, norm string): pairs of near texts. k must be unique among the rows.

    The defaults miss a pair of similarity 0.9 with probability 5e-6. Null texts and texts under `gram` characters take no
    part; equal texts under two keys are a pair; an empty table gives no rows. cross is as in candidates(), a column of texts.
    """
    keep = ["k", *([cross] if cross else []), "norm"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)
    d = materialize(texts.select(*keep).where(F.length("norm") >= gram).mapInArrow(describing(gram, bands, width), f"{kinds}, {DESCRIBED}"), "described")
    p = d.select(F.explode("terms").alias("term"), *keep[:-1], "n", "p0", "p1", "p2", "p3")
    near = materialize(candidates(p, threshold, cross).distinct(), "near")
    a, b = (d.select(F.col("k").alias(x), F.col("norm").alias(f"{x}_norm")) for x in "ab")
    pairs = near.join(a, "a").join(b, "b").select("a", "b", "a_norm", "b_norm")
    return pairs.mapInArrow(exact(gram, threshold, ["a", "b"], "a_norm", "b_norm", strict), "a long, b long, cosine double, jaccard double")
