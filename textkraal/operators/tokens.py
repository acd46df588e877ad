"""The word tokens of a corpus and what is observed of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textkraal import lexicons as lx
from textkraal.functions.language import WORD, first_prefix, found


def word_tokens(records: DataFrame, key: str = "record_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, word, low, next): one row per word with the word after it, without any shuffle.

    Null and empty texts have no rows.
    """
    z = records.select(key, *keep, found(F.col(text), WORD).alias("w"))
    z = z.select(key, *keep, F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", 2, 1 << 30).alias("next"))).alias("pos", "t"))
    return z.select(key, *keep, "pos", F.col("t.word").alias("word"), F.lower("t.word").alias("low"), F.lower("t.next").alias("next"))


LETTER = r"^[\p{L}\p{Nl}\p{No}]"
#: Words and the stretches between them, in turn.
PARTS = rf"(?s){WORD}|[^\p{{L}}\p{{Nl}}\p{{No}}]+"


def offset_tokens(records: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """(key, n, surface, start, end, is_word): words and the stretches between them; joined they are the text again."""
    z = records.select(key, F.posexplode(found(F.col(text), PARTS)).alias("n", "surface"))
    end = F.sum(F.length("surface")).over(Window.partitionBy(key).orderBy("n"))  # the parts of one text, linear in its length
    z = z.withColumn("end", end).withColumn("start", F.col("end") - F.length("surface"))
    return z.select(key, "n", "surface", "start", "end", F.col("surface").rlike(LETTER).alias("is_word"))


def first_k(rows: DataFrame, key: str, order: list[str], k: int, salts: int = 16) -> DataFrame:
    """The first k rows of each key in the given order.

    Ranked within salted parts of a key first, so that a key with a third of all rows is spread over `salts` tasks
    and only salts * k of its rows meet.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    part = Window.partitionBy(key, "_salt").orderBy(*order)
    cut = rows.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= k)
    whole = Window.partitionBy(key).orderBy(*order)
    return cut.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).drop("_salt", "_rn")


def _first(low: Column, options, test) -> Column:
    out = None
    for o in options:
        out = F.when(test(o), o) if out is None else out.when(test(o), o)
    return out


def _starts(low: Column, options: list[str]) -> Column:
    return _first(low, options, lambda p: low.startswith(p) & (F.length(low) > len(p) + 1))


def _label(value: Column, labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[value]


def observation_keys() -> dict[str, list[Column]]:
    """Per family the patterns that a token (low, next) shows; null where it shows none."""
    low, nxt, n = F.col("low"), F.col("next"), F.length("low")
    concord, poss = first_prefix(low, list(lx.SUBJECT_CONCORDS)), first_prefix(low, list(lx.POSSESSIVE_CONCORDS))
    stem = F.substr(low, F.length(concord) + 1)
    long = n > F.length(concord) + 2
    ext = _first(stem, lx.EXTENSIONS, lambda e: stem.endswith(e) & (F.length(stem) > len(e) + 1))
    tam_stem = _starts(stem, list(lx.TAM_MARKERS))
    tam, neg, cop = _starts(low, list(lx.TAM_MARKERS)), _starts(low, lx.NEGATIONS), _starts(low, lx.COPULAS)
    word_ext = _first(low, lx.EXTENSIONS, lambda e: low.endswith(e) & (n > len(e) + 2))
    starts_any = low.startswith("ba") | low.startswith("u") | low.startswith("w") | low.startswith("a")
    c = F.concat
    return {
        "agreement": [
            F.when((F.length(stem) >= 2) & ~F.substring(stem, 1, 1).isin(*"aeiou"), c(F.lit("subj_concord_"), _label(concord, lx.SUBJECT_CONCORDS), F.lit("_"), concord)),
            c(F.lit("poss_concord_"), _label(poss, lx.POSSESSIVE_CONCORDS), F.lit("_"), poss),
        ],
        "verb": [
            F.when(long, c(F.lit("verb_ext_"), _label(ext, lx.EXTENSIONS), F.lit("_"), ext)),
            F.when(long, c(F.lit("verb_tam_"), _label(tam_stem, lx.TAM_MARKERS), F.lit("_"), tam_stem)),
            F.when(long, c(F.lit("verb_subj_"), _label(concord, lx.SUBJECT_CONCORDS), F.lit("_"), concord)),
            F.when(low.startswith("ukuthi"), "complementizer_ukuthi"),
        ],
        "tam": [c(F.lit("tam_"), _label(tam, lx.TAM_MARKERS), F.lit("_"), tam), c(F.lit("neg_"), neg), c(F.lit("copula_"), cop)],
        "function_word": [F.when(low.isin(lx.FUNCTION_WORDS), low)],
        "modifier": [
            F.when(low.startswith("om") & (n > 3) & first_prefix(nxt, lx.PREFIXES).isNotNull(), "adjective_agreement"),
            F.when(starts_any & low.endswith("o") & ~low.endswith("lo"), "relative_marker_candidate"),
        ],
        "syntax": [
            c(F.lit("SV_pattern_"), first_prefix(low, lx.PREFIXES), F.lit("_"), first_prefix(nxt, list(lx.SUBJECT_CONCORDS))),
            *[F.when(low.startswith(x), c(F.lit(f"copula_{x}_noun_"), first_prefix(nxt, lx.PREFIXES))) for x in lx.COPULAS],
        ],
        "word_formation": [
            c(F.lit("derivation_"), _label(word_ext, lx.EXTENSIONS), F.lit("_"), word_ext),
            F.when(low.contains("-") | low.contains("'"), "compounding_hyphenated"),
        ],
        "negation": [c(F.lit("neg_prefix_"), _starts(low, lx.NEGATION_SCAN))],
    }


def observations(tokens: DataFrame, family: str) -> DataFrame:
    """tokens with a row per pattern of the family that they show, as column pattern."""
    keys = F.array_compact(F.array(*observation_keys()[family]))
    return tokens.select("*", F.explode(keys).alias("pattern"))


def all_observations(tokens: DataFrame) -> DataFrame:
    """tokens with a row per family and pattern that they show: every family in one pass."""
    k = [F.when(c.isNotNull(), F.struct(F.lit(f).alias("family"), c.alias("pattern"))) for f, cs in observation_keys().items() for c in cs]
    return tokens.select("*", F.explode(F.array_compact(F.array(*k))).alias("o")).select(*tokens.columns, "o.family", "o.pattern")


def analysis(word: Column) -> Column:
    """(type, prefix, stem, entry): the longest noun prefix, else a hyphenated subject concord, else the first listed verb
    form that the word starts with (stem: its segments), else nulls (unknown)."""
    low = F.lower(word)
    noun = _first(low, sorted(lx.NOUN_CLASS, key=lambda p: -len(p)), lambda p: low.startswith(p) & (F.length(low) > len(p) + 1))
    verb = _first(low, ["u-", "ba-"], lambda p: low.startswith(p) & (F.length(low) > len(p) + 1))
    entry = F.when(noun.isNotNull(), _label(noun, lx.NOUN_CLASS)).otherwise(_label(verb, {"u-": "AGR_SUBJ_NC1", "ba-": "AGR_SUBJ_NC2"}))
    prefix = F.coalesce(noun, verb)
    form = _first(low, lx.VERB_PATTERNS, lambda p: low.startswith(p.replace("-", "")))
    return F.struct(
        F.when(noun.isNotNull(), "noun").when(verb.isNotNull(), "verb").when(form.isNotNull(), "verb_pattern").otherwise("unknown").alias("type"),
        F.coalesce(prefix, F.replace(form, F.lit("-"), F.lit(""))).alias("prefix"),
        F.coalesce(F.substr(low, F.length(prefix) + 1), form).alias("stem"), entry.alias("entry"),
    )
