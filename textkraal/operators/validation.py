"""Validation and correction of candidates against a reference vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textkraal import lexicons as lx
from textkraal.functions.language import language_v1, modern_spelling, old_letters
from textkraal.functions.normalize import WS, let, pieces


def reference_vocabulary(reference: DataFrame, text: str = "text") -> DataFrame:
    """(word): the lower-case pieces of the reference texts, and the words that are known without them."""
    own = reference.select(F.explode(pieces(F.lower(text))).alias("word"))
    known = reference.sparkSession.createDataFrame([(w,) for w in lx.KNOWN_WORDS], "word string")
    return own.union(known).distinct()


def coverage(candidates: DataFrame, vocabulary: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """(key, covered, total, uncovered): pieces of each text that are in the vocabulary, repeated pieces counted as often,
    and the first five that are not, as they are written.

    A text without pieces has no row. Pieces are counted per text before they meet the vocabulary.
    """
    w = candidates.select(key, F.posexplode(pieces(F.col(text))).alias("pos", "piece")).groupBy(key, F.lower("piece").alias("word"))
    w = w.agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct("pos", "piece"))), 1, 5).alias("first"))  # the pieces of one text
    j = w.join(vocabulary.withColumn("known", F.lit(True)), "word", "left")
    g = j.groupBy(key).agg(
        F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("covered"), F.sum("n").alias("total"), F.flatten(F.collect_list(F.when(F.col("known").isNull(), F.col("first")))).alias("u")
    )
    return g.select(key, "covered", "total", F.transform(F.slice(F.sort_array("u"), 1, 5), lambda x: x["piece"]).alias("uncovered"))


def target_part(text: Column) -> Column:
    """The isiXhosa part of a mixed text: what follows 'term: gloss -', else the parts between , and ; that are isiXhosa."""
    glossed = F.regexp_extract(text, rf"^(.+?):{WS}*(.+?){WS}*-{WS}*(.+)$", 3)
    parts = F.split(text, rf"{WS}*,{WS}*|{WS}*;{WS}*")
    kept = F.transform(
        parts,
        lambda p: let(
            language_v1(p),
            lambda g: F.when(g == "TARGET_LANGUAGE", p).when(g == "MIXED_LANGUAGE", F.array_join(F.filter(pieces(p), lambda w: ~F.lower(w).isin(lx.ENGLISH_V1)), " ")),
        ),
    )
    joined = F.array_join(F.filter(kept, lambda x: x.isNotNull() & (x != "")), " ")
    return F.when(glossed != "", F.trim(glossed)).when(joined != "", joined)


def english_words(text: Column, lexicon: list[str] | None = None) -> Column:
    """Lower-case pieces of a text that are listed English words."""
    return F.filter(pieces(F.lower(text)), lambda w: w.isin(lexicon or lx.ENGLISH_V1))


#: The outcomes of the decision tree, in the order in which they are tried: status, confidence, and the source of the decision.
OUTCOMES = {
    "foreign": ("rejected", "high", "language_detection_engine"), "unsure": ("uncertain", "low", "language_detection_engine"),
    "kept": ("validated", "medium", "masikhanyise_pedagogical_pattern"), "dropped": ("rejected", "high", "language_detection_engine"),
    "respelt": ("validated", "medium", "mqhayi_orthography"), "unproved": ("uncertain", "low", ""),
    "full": ("validated", "high", "reference_vocabulary"), "half": ("validated", "medium", "reference_vocabulary"),
    "some": ("uncertain", "medium", "reference_vocabulary"), "few": ("rejected", "medium", "reference_vocabulary"), "rest": ("uncertain", "low", ""),
}


def validate(candidates: DataFrame, vocabulary: DataFrame, old_spelling_source: str = "ingqokelela_yembongi") -> DataFrame:
    """The validation result of each of candidates(record_id, text, source, orthography): record_id, original_text,
    corrected_text, language_class, validation_status, reason, reference_source, confidence, corrections, orthography.

    The decision tree: foreign texts are rejected, uncertain ones stay uncertain; of a mixed text with English words the
    isiXhosa part is kept if it is over half of the text, else it is rejected; a text with a 5 or 6 is put into modern
    spelling if it comes from the named source or holds 'bhala' or 'bhalwe', else it is uncertain; the others go by the
    share of pieces in the vocabulary: 0.7, 0.5 and 0.3. Null texts are uncertain; repeated rows count once. corrections is
    an array of (original, corrected, reason), empty where nothing was changed.
    """
    c = candidates.select("record_id", "text", "source", "orthography").distinct()
    x = c.join(coverage(c, vocabulary), "record_id", "left").withColumn("lang", language_v1(F.col("text")))
    x = x.withColumn("share", F.coalesce("covered", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)))
    x = x.withColumn("english", F.filter(pieces(F.col("text")), lambda w: F.lower(w).isin(lx.ENGLISH_V1)))
    x = x.withColumn("part", F.when(F.col("lang") == "MIXED_LANGUAGE", target_part(F.col("text")))).withColumn("modern", modern_spelling(F.col("text")))
    keep = F.coalesce(F.length("part") > F.length("text") * 0.5, F.lit(False))
    old = F.coalesce(old_letters(F.col("text")) > 0, F.lit(False))
    known = (F.coalesce(F.col("source"), F.lit("")) == old_spelling_source) | F.lower("modern").contains("bhala") | F.lower("modern").contains("bhalwe")
    mixed, target = (F.col("lang") == "MIXED_LANGUAGE") & (F.size("english") > 0), F.col("lang") == "TARGET_LANGUAGE"
    tests = [
        F.col("lang") == "FOREIGN_LANGUAGE", F.col("lang") == "UNCERTAIN", mixed & keep, mixed, old & known, old,
        target & (F.col("share") >= 0.7), target & (F.col("share") >= 0.5), target & (F.col("share") >= 0.3), target, F.lit(True),
    ]
    outcome = None
    for name, test in zip(OUTCOMES, tests):
        outcome = F.when(test, name) if outcome is None else outcome.when(test, name)
    x = x.withColumn("outcome", outcome)
    text = F.when(F.col("outcome") == "kept", F.col("part")).when(F.col("outcome") == "respelt", F.col("modern")).otherwise(F.col("text"))
    changes = F.create_map(F.lit("kept"), F.lit("Removed English translation overlay from pedagogical content"), F.lit("respelt"), F.lit("Traditional orthography normalization"))
    change = F.struct(F.col("text").alias("original"), text.alias("corrected"), changes[F.col("outcome")].alias("reason"))
    table = F.create_map(*[y for k, v in OUTCOMES.items() for y in (F.lit(k), F.struct(*[F.lit(z).alias(n) for n, z in zip(("status", "level", "by"), v)]))])[F.col("outcome")]
    return x.select(
        "record_id", F.col("text").alias("original_text"), text.alias("corrected_text"), F.col("lang").alias("language_class"), table["status"].alias("validation_status"),
        _reason().alias("reason"), table["by"].alias("reference_source"), table["level"].alias("confidence"),
        F.filter(F.array(change), lambda c: c["reason"].isNotNull()).alias("corrections"), F.coalesce("orthography", F.lit("unknown")).alias("orthography"),
    )


def _reason() -> Column:
    """The reason of each outcome, in words (fixed values)."""
    say = lambda pattern, *c: F.format_string(pattern, *c)
    percent = F.bround(F.col("share") * 100, 0).cast("int")
    few = F.when(F.size("uncovered") > 0, F.concat(F.lit("['"), F.array_join("uncovered", "', '"), F.lit("']"))).otherwise("[]")
    of = {
        "foreign": say("Text is classified as foreign language (English). Contains %d words with %d English indicators.", F.size(pieces(F.col("text"))), F.size("english")),
        "unsure": F.lit("Insufficient evidence to classify language. No clear Xhosa or English indicators found."),
        "kept": say("Mixed-language record (pedagogical overlay). Extracted Xhosa portion (%d chars from %d).", F.length("part"), F.length("text")),
        "dropped": say("Mixed-language content with %d English words: %s...", F.size("english"), F.array_join(F.slice("english", 1, 5), ", ")),
        "respelt": F.lit("Traditional orthography normalized (6→bh, 5→hl). Old orthography is authentic to Mqhayi's era."),
        "unproved": F.lit("Contains traditional orthography characters that cannot be verified."),
        "full": say("Target language text with %d%% reference vocabulary coverage (%d/%d words).", percent, F.col("covered"), F.col("total")),
        "some": say("Moderate reference coverage (%d%%). Needs manual review.", percent),
        "few": say("Low reference coverage (%d%%). Uncovered words: %s", percent, few),
        "rest": F.lit("No authoritative evidence to validate or correct. Leaving as UNCERTAIN."),
    }
    of["half"] = of["full"]
    out = F.lit(None).cast("string")
    for name, text in of.items():
        out = F.when(F.col("outcome") == name, text).otherwise(out)
    return out


def is_english_word(word: Column) -> Column:
    """A listed word, or letters only with an English ending and none of the isiXhosa marks."""
    low = F.regexp_replace(F.lower(word), r"^['\"\-.,;:!?]+|['\"\-.,;:!?]+$", "")
    marks = word.rlike(r"[65'\-]")
    shape = low.rlike(r"^[uaio][befhiklmnoprstvwxyz]|\b(ng|cw|hl|kh|ph|th|xh)\w+")
    ending = low.rlike(r"(tion|ity|ous|ing|ed|ly|er|al|ion|ness|ship|ment)$")
    return (low != "") & (low.isin(lx.ENGLISH_OVERLAY) | (~marks & ~low.isin(lx.XHOSA_OVERLAY) & low.rlike("^[a-z]+$") & (F.length(low) > 3) & ~shape & ending))


def is_target_word(word: Column) -> Column:
    """A word with an apostrophe, a 5 or 6, a class prefix or a listed beginning."""
    low = F.regexp_replace(F.lower(word), r"^['\"\-.,;:!?]+|['\"\-.,;:!?]+$", "")
    shape = low.rlike(r"^([uaieo][mbnkgchtfdsjqxz]|ng|kw|swa|(ya|ye|yo)[mnkgchtfdsjqxzblrvw])")
    return (low != "") & (word.rlike("['65]") | shape | low.isin(lx.XHOSA_OVERLAY))


def strip_overlay(line: Column) -> Column:
    """(kept, removed): a line without its English overlay.

    'term: gloss - rest' keeps the rest, or the gloss where only the rest has listed English words; 'term: rest' keeps
    the term and the rest's other words if they are the longer part; else words are sorted by kind, a word of no kind
    going with the isiXhosa once one has been seen; the line stays whole unless the kept part is the longer.
    """
    t = F.regexp_replace(line, f"^{WS}+|{WS}+$", "")
    pattern = rf"^(.+?):{WS}*(.+?){WS}*-{WS}*(.+)$"
    term, gloss, rest = (F.trim(F.regexp_extract(t, pattern, i)) for i in (1, 2, 3))
    hits = lambda c: F.size(english_words(c, lx.ENGLISH_OVERLAY)) > 0
    a = F.struct(rest.alias("kept"), F.when(~hits(gloss) & hits(rest), gloss).otherwise(F.concat(term, F.lit(": "), gloss)).alias("removed"))
    pair = rf"^(.+?):{WS}*(.+)$"
    term2, w2 = F.trim(F.regexp_extract(t, pair, 1)), pieces(F.regexp_extract(t, pair, 2))
    eng, oth = F.array_join(F.filter(w2, is_english_word), " "), F.array_join(F.filter(w2, lambda w: ~is_english_word(w)), " ")
    b = F.struct(F.concat(term2, F.lit(" "), oth).alias("kept"), eng.alias("removed"))
    start = F.struct(F.lit(False).alias("seen"), F.array().cast("array<string>").alias("x"), F.array().cast("array<string>").alias("e"))

    def step(s: Column, w: Column) -> Column:
        x = is_target_word(w) | (s["seen"] & ~is_english_word(w))
        return F.struct(
            (s["seen"] | is_target_word(w)).alias("seen"), F.when(x, F.array_append(s["x"], w)).otherwise(s["x"]).alias("x"), F.when(x, s["e"]).otherwise(F.array_append(s["e"], w)).alias("e")
        )

    scan = F.aggregate(pieces(line), start, step, lambda s: F.struct(F.array_join(s["x"], " ").alias("kept"), F.array_join(s["e"], " ").alias("removed")))
    c = let(scan, lambda s: F.when(F.length(s["kept"]) > F.length(s["removed"]), s).otherwise(F.struct(t.alias("kept"), F.lit("").alias("removed"))))
    return F.when(t.rlike(pattern), a).when(t.rlike(pair) & (oth != "") & (F.length(oth) > F.length(eng)), b).otherwise(c)
