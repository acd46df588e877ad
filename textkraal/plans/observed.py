"""Queries over word tokens: frequencies, observations, evidence, the word analyzer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textkraal import lexicons as lx
from textkraal.functions.language import confidence_band, first_prefix, found
from textkraal.functions.normalize import pieces
from textkraal.operators import tokens as tk
from textkraal.operators.records import with_positions
from textkraal.plans.scalars import PIECES, WORDS
from textkraal.session import load


def target(spark, sf_dir):
    """The distinct records that are analysed: those labelled TARGET_LANGUAGE."""
    r = load(spark, sf_dir, "corpus_records").where("language_class = 'TARGET_LANGUAGE' and text is not null")
    return r.select("record_id", "text", "orthography").distinct()


def target_tokens(spark, sf_dir):
    return tk.word_tokens(target(spark, sf_dir), keep=("orthography",))


#: Per family: what its observation ids start with, and its type (fixed values).
FAMILIES = {
    "agreement": ("AGR", "agreement"), "verb": ("VM", "verb_morphology"), "tam": ("TAM", "tense_aspect_mood"), "function_word": ("FW", "function_word"),
    "modifier": ("MOD", "modifier"), "syntax": ("SYN", "syntax"), "word_formation": ("WF", "word_formation"), "negation": ("NEG", "negation"),
}
EVIDENCE = ["record_id", "source_work", "source_title", "orthography", "surface_form", "start", "end", "context"]


def places(spark, sf_dir, tokens, key, k, both=False, around=80):
    """The first k places of each key among tokens(key, record_id, pos), in order of record and position, as evidence: the
    record, its work, the form, its span and `around` characters on either side. both: the form is the word and the next.

    The keys must be of a fixed list, for their places are broadcast to the texts.
    """
    p = tk.first_k(tokens.select(key, "record_id", "pos"), key, ["record_id", "pos"], k)
    r = load(spark, sf_dir, "corpus_records").where("language_class = 'TARGET_LANGUAGE' and text is not null").select("record_id", "text", "orthography", "source", "source_title")
    x = r.join(F.broadcast(p), "record_id").withColumn("parts", found(F.col("text"), tk.PARTS))
    at = 2 * F.col("pos") + F.when(F.get("parts", F.lit(0)).rlike(tk.LETTER), 0).otherwise(1)
    x = x.withColumn("at", at).withColumn("start", F.length(F.array_join(F.slice("parts", 1, F.col("at")), "")))
    part = lambda i: F.get("parts", F.col("at") + i)
    form, length = (F.concat_ws(" ", part(0), part(2)), F.length(part(0)) + F.length(part(1)) + F.length(part(2))) if both else (part(0), F.length(part(0)))
    x = x.withColumn("surface_form", form).withColumn("end", F.col("start") + length).withColumn("from", F.greatest(F.col("start") - around, F.lit(0)))
    context = F.substring(F.col("text"), F.col("from") + 1, F.col("end") + around - F.col("from"))
    fields = [F.col("record_id"), *[F.coalesce(c, F.lit(e)).alias(n) for c, n, e in (("source", "source_work", ""), ("source_title", "source_title", ""), ("orthography", "orthography", "uncertain"))]]
    return x.select(key, "rank", *fields, "surface_form", "start", "end", context.alias("context")).distinct()


def gathered(p, key):
    """(key, evidence): the places of each key as an array in their order; at most k of them."""
    g = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", *EVIDENCE))).alias("e"))
    return g.select(key, F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in EVIDENCE])).alias("evidence"))


def observations(spark, sf_dir, family, k=10):
    """(observation_id, pattern_type, pattern, token_frequency, analysis_status, confidence, evidence) of a family."""
    o = tk.observations(target_tokens(spark, sf_dir), family)
    g = o.groupBy("pattern").agg(F.count("*").alias("token_frequency"))
    e = gathered(places(spark, sf_dir, o, "pattern", k, both=family == "syntax"), "pattern")
    start, kind = FAMILIES[family]
    kind = F.when(F.col("pattern").startswith("copula") & F.lit(family == "tam"), "copula").when(F.col("pattern").startswith("neg") & F.lit(family == "tam"), "negation").otherwise(kind)
    return g.join(e, "pattern").select(
        F.concat(F.lit(start + "_"), F.upper("pattern")).alias("observation_id"), kind.alias("pattern_type"), "pattern", "token_frequency",
        F.lit("OBSERVED").alias("analysis_status"), confidence_band(F.col("token_frequency")).alias("confidence"), "evidence",
    )


def _counts(family):
    """A query of observations(), the evidence as JSON."""

    def q(spark, sf_dir):
        return observations(spark, sf_dir, family).withColumn("evidence", F.to_json("evidence"))

    return q


def evidence(spark, sf_dir, k=10):
    """The first k places of each pattern of every family, in order of record and position, in one pass."""
    o = tk.all_observations(target_tokens(spark, sf_dir)).withColumn("key", F.concat_ws(":", "family", "pattern"))
    return tk.first_k(o.select("key", "record_id", "pos", "word"), "key", ["record_id", "pos"], k)


def review_tasks(spark, sf_dir):
    """Patterns seen at least five times become review tasks; those of modifiers always do."""
    g = tk.all_observations(target_tokens(spark, sf_dir)).groupBy("family", "pattern").agg(F.count("*").alias("token_frequency"))
    g = g.where((F.col("family") == "modifier") | (F.col("token_frequency") >= 5))
    return g.withColumn("proposed_analysis", F.lit(None).cast("string"))


def lexicon(spark, sf_dir):
    """Each form with its id in order, tokens, ways of writing, confidence and the first three places, as record@position."""
    t = target_tokens(spark, sf_dir)
    g = t.groupBy("low").agg(F.count("*").alias("frequency"), F.array_join(F.sort_array(F.collect_set("word")), "|").alias("forms"))  # ways of writing one word
    p = tk.first_k(t.select("low", "record_id", "pos"), "low", ["record_id", "pos"], 3)
    p = p.groupBy("low").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("@", "record_id", "pos").alias("p")))).alias("p"))
    ids = lexicon_ids(spark, sf_dir).withColumnRenamed("form", "low")
    g = g.join(p, "low").join(ids, "low")
    return g.select("id", F.col("low").alias("form"), "frequency", "forms", confidence_band(F.col("frequency")).alias("confidence"), F.array_join(F.transform("p", lambda x: x["p"]), "|").alias("places"))


def lexicon_ids(spark, sf_dir):
    """Sequential ids of the sorted lexicon, without sorting it in one task."""
    g = with_positions(target_tokens(spark, sf_dir).select(F.col("low").alias("form")).distinct(), ["form"])
    return g.select("form", F.concat(F.lit("LEX_OBS_"), F.lpad((F.col("at") + 1).cast("string"), 6, "0")).alias("id"))


def prefix_observations(spark, sf_dir, forms):
    """Per prefix its tokens, forms (the first `forms` in order), spelling and confidence."""
    t = target_tokens(spark, sf_dir).withColumn("prefix", first_prefix(F.col("low"), lx.PREFIXES)).where("prefix is not null")
    modern, old = F.count_if(F.col("orthography") == "modern"), F.count_if(F.col("orthography").isin("traditional", "mixed"))
    g = t.groupBy("prefix", "low").agg(F.count("*").alias("n"), modern.alias("modern"), old.alias("old"))
    first = tk.first_k(g.select("prefix", "low"), "prefix", ["low"], forms).groupBy("prefix").agg(F.array_join(F.sort_array(F.collect_list("low")), "|").alias("observed_forms"))
    g = g.groupBy("prefix").agg(F.sum("n").alias("token_frequency"), F.count("*").alias("distinct_forms"), F.sum("modern").alias("modern"), F.sum("old").alias("historical"))
    status = F.when((F.col("historical") > 0) & (F.col("modern") > 0), "variant").when(F.col("historical") > 0, "historical").otherwise("modern")
    return g.join(first, "prefix").withColumn("historical_status", status).withColumn("confidence", confidence_band(F.col("token_frequency")))


def prefix_inventory(spark, sf_dir):
    return prefix_observations(spark, sf_dir, 100)


def noun_classes(spark, sf_dir):
    """Observations of noun-class prefixes: as prefix_observations(), with the ten prefixes that most records share with
    each, and the first ten places as JSON."""
    t = target_tokens(spark, sf_dir).withColumn("prefix", first_prefix(F.col("low"), lx.PREFIXES)).where("prefix is not null")
    e = gathered(places(spark, sf_dir, t, "prefix", 10), "prefix").withColumn("evidence", F.to_json("evidence"))
    w = Window.partitionBy("prefix_a").orderBy(F.desc("n"), "prefix_b")  # at most twelve partners
    c = shared_records(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 10")
    c = c.groupBy(F.col("prefix_a").alias("prefix")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws("-", "prefix_a", "prefix_b").alias("p"), "n"))), lambda x: F.concat_ws(":", x["p"], x["n"].cast("string"))), "|").alias("cooccurring"))
    g = prefix_observations(spark, sf_dir, 200).join(e, "prefix").join(c, "prefix", "left")
    return g.withColumn("observation_id", F.concat(F.lit("NC_PREFIX_"), F.upper("prefix"))).withColumn("cooccurring", F.coalesce("cooccurring", F.lit("")))


def shared_records(spark, sf_dir):
    """(prefix_a, prefix_b, n): in how many records two prefixes stand; a record has at most 13, so its pairs are bounded."""
    t = target_tokens(spark, sf_dir).select("record_id", first_prefix(F.col("low"), lx.PREFIXES).alias("p")).where("p is not null")
    t = t.groupBy("record_id").agg(F.sort_array(F.collect_set("p")).alias("ps"))  # pairs within the row, without a join
    t = t.select(F.explode("ps").alias("prefix_a"), "ps").select("prefix_a", F.explode("ps").alias("prefix_b")).where("prefix_a < prefix_b")
    return t.groupBy("prefix_a", "prefix_b").agg(F.count("*").alias("n"))


def cooccurrence(spark, sf_dir):
    """The five prefixes that most records share with each prefix, three records at least."""
    w = Window.partitionBy("prefix_a").orderBy(F.desc("n"), "prefix_b")
    return shared_records(spark, sf_dir).where("n >= 3").withColumn("rank", F.row_number().over(w)).where("rank <= 5")


def verb_entries(spark, sf_dir):
    """Forms seen at least five times with concord, stem and extension."""
    t = target_tokens(spark, sf_dir).groupBy("low").agg(F.count("*").alias("frequency")).where("frequency >= 5")
    c = first_prefix(F.col("low"), list(lx.SUBJECT_CONCORDS))
    t = t.withColumn("concord", c).where("concord is not null").withColumn("stem", F.substr("low", F.length("concord") + 1))
    ext = None
    for e in lx.EXTENSIONS:
        hit = F.col("stem").endswith(e) & (F.length("stem") > len(e) + 1)
        ext = F.when(hit, e) if ext is None else ext.when(hit, e)
    return t.select("low", "frequency", "concord", "stem", ext.alias("extension"))


def derivations(spark, sf_dir):
    """Per suffix with at least five forms: forms, tokens."""
    t = target_tokens(spark, sf_dir)
    e = None
    for x in lx.EXTENSIONS:
        hit = F.col("low").endswith(x) & (F.length("low") > len(x) + 2)
        e = F.when(hit, x) if e is None else e.when(hit, x)
    return t.withColumn("suffix", e).where("suffix is not null").groupBy("suffix").agg(F.countDistinct("low").alias("forms"), F.count("*").alias("tokens")).where("forms >= 5")


def review_queue(spark, sf_dir):
    """The 250 most frequent forms of three letters or more, three kinds of task each."""
    g = target_tokens(spark, sf_dir).where("length(low) >= 3").groupBy(F.col("low").alias("lemma")).agg(F.count("*").alias("frequency"))
    top = g.orderBy(F.desc("frequency"), "lemma").limit(250)
    return top.select("lemma", "frequency", F.explode(F.array(*map(F.lit, ("LEXICAL_LEMMA", "MORPHOLOGY_SEGMENTATION", "NOUN_CLASS_OR_AGREEMENT")))).alias("task_type"))


def char_frequency(spark, sf_dir):
    r = target(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return r.groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch").limit(30)


def digraphs(spark, sf_dir):
    """Words that hold each letter pair, once per word."""
    t = target_tokens(spark, sf_dir).select(F.explode(F.filter(F.array(*map(F.lit, lx.LETTER_PAIRS)), lambda p: F.col("low").contains(p))).alias("pair"))
    return t.groupBy("pair").agg(F.count("*").alias("words"))


def analyzed(spark, sf_dir):
    a = target_tokens(spark, sf_dir).select("low").distinct().withColumn("a", tk.analysis(F.col("low")))
    return a.select("low", "a.type", "a.prefix", "a.stem", "a.entry")


def analyzed_texts(spark, sf_dir):
    """Per record how many of its words each kind of analysis covers."""
    t = target_tokens(spark, sf_dir).select("record_id", tk.analysis(F.col("low"))["type"].alias("type"))
    return t.groupBy("record_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in ("noun", "verb", "verb_pattern", "unknown")])


def offsets(spark, sf_dir):
    return tk.offset_tokens(target(spark, sf_dir))


def referential(spark, sf_dir):
    """Evidence items whose record doesn't exist."""
    e = load(spark, sf_dir, "evidence_items").select("record_id", "surface_form")
    return e.join(load(spark, sf_dir, "corpus_records").select("record_id"), "record_id", "left_anti")


def distinct_words(spark, sf_dir):
    """Three definitions of a distinct word, in one pass."""
    t = F.lower("text")
    kinds = [("white_space", pieces(t)), ("ascii", found(t, "[a-z]+")), ("letters", found(t, tk.WORD))]

    def of(kind, words):
        return F.transform(F.array_distinct(words), lambda x: F.struct(F.lit(kind).alias("definition"), x.alias("w")))

    each = F.flatten(F.array(*[of(k, w) for k, w in kinds]))
    r = target(spark, sf_dir).select(F.explode(each).alias("x")).select("x.definition", "x.w").distinct()
    return r.groupBy("definition").agg(F.count("*").alias("words"))


def ambiguity(spark, sf_dir):
    """Records of the first fifty words that start with a and are longer than three letters, in corpus order."""
    t = target_tokens(spark, sf_dir).where("low like 'a%' and length(low) > 3")
    return t.orderBy("record_id", "pos").limit(50).select("record_id").distinct()


QUERIES = {
    "a1_word_analysis": analyzed, "a3_text_analysis": analyzed_texts, "t17_offset_tokens": offsets,
    "t25_prefix_of_words": lambda s, d: target_tokens(s, d).select("low").distinct().select("low", first_prefix(F.col("low"), lx.PREFIXES).alias("prefix")),
    "t26_concord_of_words": lambda s, d: target_tokens(s, d).select("low").distinct().select("low", first_prefix(F.col("low"), list(lx.SUBJECT_CONCORDS)).alias("concord"), first_prefix(F.col("low"), list(lx.POSSESSIVE_CONCORDS)).alias("possessive")),
    "g4_distinct_words": distinct_words,
    "g5_word_frequency": lambda s, d: target_tokens(s, d).groupBy("low").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "low").limit(50),
    "g6_char_frequency": char_frequency,
    "g7_punctuation": lambda s, d: target(s, d).select(F.explode(found(F.col("text"), r"[^\p{L}\p{N}\p{M}_\s]")).alias("mark")).groupBy("mark").agg(F.count("*").alias("n")),
    "g7_letter_pairs": digraphs, "g10_lexicon": lexicon, "g11_prefix_inventory": prefix_inventory, "g12_noun_class_forms": noun_classes, "g13_cooccurrence": cooccurrence,
    "g14_agreement": _counts("agreement"), "g15_verb_morphology": _counts("verb"), "g16_tam": _counts("tam"), "g17_function_words": _counts("function_word"),
    "g18_modifiers": _counts("modifier"), "g19_syntax": _counts("syntax"), "g20_word_formation": _counts("word_formation"), "g21_negation": _counts("negation"),
    "g22_verb_entries": verb_entries, "g23_derivations": derivations, "g25_prefix_ambiguity": ambiguity, "w1_first_evidence": evidence, "w2_lexicon_ids": lexicon_ids,
    "w3_review_queue": review_queue, "q6_review_tasks": review_tasks, "j8_neighbours": lambda s, d: target_tokens(s, d).where("next is not null").groupBy("low", "next").agg(F.count("*").alias("n")).where("n >= 3"),
    "j10_missing_records": referential,
}


def _starts(col: str, options, extra: int = 1) -> str:
    return "CASE " + " ".join(f"WHEN {col} LIKE '{p}%' AND length({col}) > {len(p) + extra} THEN '{p}'" for p in options) + " END"


def _ends(col: str, extra: int) -> str:
    return "CASE " + " ".join(f"WHEN {col} LIKE '%{p}' AND length({col}) > {len(p) + extra} THEN '{p}'" for p in lx.EXTENSIONS) + " END"


def _lab(col: str, labels: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


TARGET = "(SELECT DISTINCT record_id, text, orthography FROM corpus_records WHERE language_class = 'TARGET_LANGUAGE' AND text IS NOT NULL)"
TOK = f"""WITH w AS (SELECT record_id, orthography, {WORDS} AS w FROM {TARGET}),
 i AS (SELECT record_id, orthography, w, unnest(generate_series(1, len(w))) AS i FROM w),
 t AS (SELECT record_id, orthography, i - 1 AS pos, w[i] AS word, lower(w[i]) AS low, lower(w[i + 1]) AS nxt FROM i),
 s AS (SELECT *, {_starts("low", lx.SUBJECT_CONCORDS)} AS c, {_starts("low", lx.POSSESSIVE_CONCORDS)} AS pc, {_starts("low", lx.PREFIXES)} AS p, {_starts("nxt", lx.PREFIXES)} AS np,
   {_starts("nxt", lx.SUBJECT_CONCORDS)} AS nc FROM t),
 k AS (SELECT *, substr(low, length(c) + 1) AS stem FROM s)"""
_KEYS = {
    "agreement": [f"CASE WHEN length(stem) >= 2 AND stem[1] NOT IN ('a', 'e', 'i', 'o', 'u') THEN 'subj_concord_' || {_lab('c', lx.SUBJECT_CONCORDS)} || '_' || c END", f"'poss_concord_' || {_lab('pc', lx.POSSESSIVE_CONCORDS)} || '_' || pc"],
    "verb": [f"CASE WHEN length(low) > length(c) + 2 THEN 'verb_ext_' || {_lab(_ends('stem', 1), lx.EXTENSIONS)} || '_' || {_ends('stem', 1)} END",
             f"CASE WHEN length(low) > length(c) + 2 THEN 'verb_tam_' || {_lab(_starts('stem', lx.TAM_MARKERS), lx.TAM_MARKERS)} || '_' || {_starts('stem', lx.TAM_MARKERS)} END",
             f"CASE WHEN length(low) > length(c) + 2 THEN 'verb_subj_' || {_lab('c', lx.SUBJECT_CONCORDS)} || '_' || c END", "CASE WHEN low LIKE 'ukuthi%' THEN 'complementizer_ukuthi' END"],
    "tam": [f"'tam_' || {_lab(_starts('low', lx.TAM_MARKERS), lx.TAM_MARKERS)} || '_' || {_starts('low', lx.TAM_MARKERS)}", f"'neg_' || {_starts('low', lx.NEGATIONS)}", f"'copula_' || {_starts('low', lx.COPULAS)}"],
    "function_word": ["CASE WHEN low IN (" + ", ".join(f"'{w}'" for w in lx.FUNCTION_WORDS) + ") THEN low END"],
    "modifier": ["CASE WHEN low LIKE 'om%' AND length(low) > 3 AND np IS NOT NULL THEN 'adjective_agreement' END", "CASE WHEN (low LIKE 'ba%' OR low LIKE 'u%' OR low LIKE 'w%' OR low LIKE 'a%') AND low LIKE '%o' AND low NOT LIKE '%lo' THEN 'relative_marker_candidate' END"],
    "syntax": ["'SV_pattern_' || p || '_' || nc", *[f"CASE WHEN low LIKE '{x}%' THEN 'copula_{x}_noun_' || np END" for x in lx.COPULAS]],
    "word_formation": [f"'derivation_' || {_lab(_ends('low', 2), lx.EXTENSIONS)} || '_' || {_ends('low', 2)}", "CASE WHEN contains(low, '-') OR contains(low, '''') THEN 'compounding_hyphenated' END"],
    "negation": [f"'neg_prefix_' || {_starts('low', lx.NEGATION_SCAN)}"],
}
_BAND = "CASE WHEN {n} >= 20 THEN 'HIGH_CONFIDENCE' WHEN {n} >= 5 THEN 'SUPPORTED' ELSE 'OBSERVED' END AS confidence"


def _seen(family: str) -> str:
    return f"(SELECT *, unnest(list_filter([{', '.join(_KEYS[family])}], lambda x: x IS NOT NULL)) AS pattern FROM k)"


def _placed(rows: str, key: str, k: int, both: bool = False) -> str:
    """CTE p: the first k places of each key of rows(key, record_id, pos), and CTE e: their evidence as JSON."""
    form = "parts[ix] || ' ' || parts[ix + 2]" if both else "parts[ix]"
    length = "length(parts[ix]) + length(parts[ix + 1]) + length(parts[ix + 2])" if both else "length(parts[ix])"
    return f"""p AS (SELECT {key}, record_id, pos, row_number() OVER (PARTITION BY {key} ORDER BY record_id, pos) AS rank FROM {rows} QUALIFY rank <= {k}),
      q AS (SELECT DISTINCT {key}, rank, r.record_id, coalesce(source, '') AS source_work, coalesce(source_title, '') AS source_title, coalesce(orthography, 'uncertain') AS orthography, text, parts, 2 * pos + CASE WHEN regexp_matches(parts[1], '^[\\p{{L}}\\p{{Nl}}\\p{{No}}]') THEN 1 ELSE 2 END AS ix
        FROM p JOIN (SELECT *, regexp_extract_all(text, '(?s)[\\p{{L}}\\p{{Nl}}\\p{{No}}]+(?:[-''][\\p{{L}}\\p{{Nl}}\\p{{No}}]+)*|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS parts FROM corpus_records WHERE language_class = 'TARGET_LANGUAGE' AND text IS NOT NULL) r USING (record_id)),
      z AS (SELECT *, {form} AS surface_form, length(array_to_string(parts[1:ix - 1], '')) AS s, s + {length} AS f FROM q),
      e AS (SELECT {key}, to_json(list(struct_pack(record_id := record_id, source_work := source_work, source_title := source_title, orthography := orthography, surface_form := surface_form, "start" := s, "end" := f,
        context := substring(text, greatest(s - 80, 0) + 1, f + 80 - greatest(s - 80, 0))) ORDER BY rank))::VARCHAR AS evidence FROM z GROUP BY {key})"""


def _counted(family: str) -> str:
    start, kind = FAMILIES[family]
    kind = f"CASE WHEN pattern LIKE 'copula%' THEN 'copula' WHEN pattern LIKE 'neg%' THEN 'negation' ELSE '{kind}' END" if family == "tam" else f"'{kind}'"
    return f"""{TOK}, o AS (SELECT * FROM {_seen(family)}), {_placed('o', 'pattern', 10, family == 'syntax')}, g AS (SELECT pattern, count(*) AS token_frequency FROM o GROUP BY 1)
      SELECT '{start}_' || upper(pattern) AS observation_id, {kind} AS pattern_type, pattern, token_frequency, 'OBSERVED' AS analysis_status, {_BAND.format(n='token_frequency')}, evidence FROM g JOIN e USING (pattern)"""


def _inventory(forms: int) -> str:
    return f"""SELECT p AS prefix, count(*) AS token_frequency, count(DISTINCT low) AS distinct_forms, count(*) FILTER (orthography = 'modern') AS modern,
  count(*) FILTER (orthography IN ('traditional', 'mixed')) AS historical, CASE WHEN historical > 0 AND modern > 0 THEN 'variant' WHEN historical > 0 THEN 'historical' ELSE 'modern' END AS historical_status,
  array_to_string(list_sort(list(DISTINCT low))[1:{forms}], '|') AS observed_forms, {_BAND.format(n='count(*)')} FROM k WHERE p IS NOT NULL GROUP BY p"""


_INV = f"{TOK} {_inventory(100)}"
_NOUNS = f"""{TOK}, inv AS ({_inventory(200)}), pre AS (SELECT p AS prefix, record_id, pos FROM k WHERE p IS NOT NULL), {_placed('pre', 'prefix', 10)},
  d AS (SELECT DISTINCT record_id, p FROM k WHERE p IS NOT NULL), c AS (SELECT a.p AS prefix, b.p AS other, count(*) AS n FROM d a JOIN d b USING (record_id) WHERE a.p < b.p GROUP BY 1, 2),
  top AS (SELECT prefix, string_agg(prefix || '-' || other || ':' || n, '|' ORDER BY n DESC, other) AS cooccurring FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, other) <= 10) GROUP BY prefix)
  SELECT inv.*, evidence, coalesce(cooccurring, '') AS cooccurring, 'NC_PREFIX_' || upper(prefix) AS observation_id FROM inv JOIN e USING (prefix) LEFT JOIN top USING (prefix)"""
_LONGEST = sorted(lx.NOUN_CLASS, key=lambda p: -len(p))
_FORM = "CASE " + " ".join(f"WHEN low LIKE '{p.replace('-', '')}%' THEN '{p}'" for p in lx.VERB_PATTERNS) + " END"
_ANALYSIS = f"""(SELECT *, coalesce(n, v, replace(f, '-', '')) AS prefix, coalesce(substr(low, length(coalesce(n, v)) + 1), f) AS astem,
  CASE WHEN n IS NOT NULL THEN 'noun' WHEN v IS NOT NULL THEN 'verb' WHEN f IS NOT NULL THEN 'verb_pattern' ELSE 'unknown' END AS type,
  coalesce({_lab('n', lx.NOUN_CLASS)}, CASE v WHEN 'u-' THEN 'AGR_SUBJ_NC1' WHEN 'ba-' THEN 'AGR_SUBJ_NC2' END) AS entry FROM
  (SELECT *, {_starts('low', _LONGEST)} AS n, {_starts('low', ['u-', 'ba-'])} AS v, {_FORM} AS f FROM k))"""
_DIGRAPHS = str(lx.LETTER_PAIRS)

SQL = {
    "a1_word_analysis": f"{TOK} SELECT DISTINCT low, type, prefix, astem AS stem, entry FROM {_ANALYSIS}",
    "a3_text_analysis": f"{TOK} SELECT record_id, count(*) FILTER (type = 'noun') AS noun, count(*) FILTER (type = 'verb') AS verb, count(*) FILTER (type = 'verb_pattern') AS verb_pattern, count(*) FILTER (type = 'unknown') AS unknown FROM {_ANALYSIS} GROUP BY record_id",
    "t17_offset_tokens": rf"""WITH w AS (SELECT record_id, regexp_extract_all(text, '(?s)[\p{{L}}\p{{Nl}}\p{{No}}]+(?:[-''][\p{{L}}\p{{Nl}}\p{{No}}]+)*|[^\p{{L}}\p{{Nl}}\p{{No}}]+') AS w FROM {TARGET}),
      i AS (SELECT record_id, unnest(w) AS surface, generate_subscripts(w, 1) - 1 AS n FROM w)
      SELECT record_id, n, surface, (sum(length(surface)) OVER (PARTITION BY record_id ORDER BY n))::BIGINT AS "end", "end" - length(surface) AS start, regexp_matches(surface, '^[\p{{L}}\p{{Nl}}\p{{No}}]') AS is_word FROM i""",
    "t25_prefix_of_words": f"{TOK} SELECT DISTINCT low, p AS prefix FROM k",
    "t26_concord_of_words": f"{TOK} SELECT DISTINCT low, c AS concord, pc AS possessive FROM k",
    "g4_distinct_words": f"""SELECT 'white_space' AS definition, count(DISTINCT w) AS words FROM (SELECT unnest({PIECES.replace('text', 'lower(text)')}) AS w FROM {TARGET})
      UNION ALL SELECT 'ascii', count(DISTINCT w) FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {TARGET})
      UNION ALL SELECT 'letters', count(DISTINCT w) FROM (SELECT unnest({WORDS.replace('(text', '(lower(text)')}) AS w FROM {TARGET})""",
    "g5_word_frequency": f"{TOK} SELECT low, count(*) AS n FROM k GROUP BY low ORDER BY n DESC, low LIMIT 50",
    "g6_char_frequency": f"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM {TARGET}) WHERE ch <> '' GROUP BY ch ORDER BY n DESC, ch LIMIT 30",
    "g7_punctuation": rf"SELECT mark, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\p{{M}}_\s]')) AS mark FROM {TARGET}) GROUP BY mark",
    "g7_letter_pairs": f"{TOK} SELECT pair, count(*) AS words FROM (SELECT unnest(list_filter({_DIGRAPHS}, lambda x: contains(low, x))) AS pair FROM k) GROUP BY pair",
    "g10_lexicon": f"""{TOK}, g AS (SELECT low, count(*) AS frequency, array_to_string(list_sort(list(DISTINCT word)), '|') AS forms FROM k GROUP BY low),
      h AS (SELECT low, string_agg(record_id || '@' || pos, '|' ORDER BY record_id, pos) AS places FROM (SELECT low, record_id, pos FROM k QUALIFY row_number() OVER (PARTITION BY low ORDER BY record_id, pos) <= 3) GROUP BY low)
      SELECT 'LEX_OBS_' || lpad((row_number() OVER (ORDER BY low))::VARCHAR, 6, '0') AS id, low AS form, frequency, forms, {_BAND.format(n='frequency')}, places FROM g JOIN h USING (low)""",
    "g11_prefix_inventory": _INV, "g12_noun_class_forms": _NOUNS,
    "g13_cooccurrence": f"""{TOK}, d AS (SELECT DISTINCT record_id, p FROM k WHERE p IS NOT NULL),
      g AS (SELECT a.p AS prefix_a, b.p AS prefix_b, count(*) AS n FROM d a JOIN d b USING (record_id) WHERE a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 3)
      SELECT *, row_number() OVER (PARTITION BY prefix_a ORDER BY n DESC, prefix_b) AS rank FROM g QUALIFY rank <= 5""",
    **{q: _counted(f) for q, f in (("g14_agreement", "agreement"), ("g15_verb_morphology", "verb"), ("g16_tam", "tam"), ("g17_function_words", "function_word"), ("g18_modifiers", "modifier"), ("g19_syntax", "syntax"), ("g20_word_formation", "word_formation"), ("g21_negation", "negation"))},
    "g22_verb_entries": f"{TOK}, f AS (SELECT low, c AS concord, stem, count(*) AS frequency FROM k GROUP BY ALL HAVING count(*) >= 5) SELECT low, frequency, concord, stem, {_ends('stem', 1)} AS extension FROM f WHERE concord IS NOT NULL",
    "g23_derivations": f"{TOK} SELECT {_ends('low', 2)} AS suffix, count(DISTINCT low) AS forms, count(*) AS tokens FROM k WHERE suffix IS NOT NULL GROUP BY 1 HAVING count(DISTINCT low) >= 5",
    "g25_prefix_ambiguity": f"{TOK} SELECT DISTINCT record_id FROM (SELECT record_id FROM k WHERE low LIKE 'a%' AND length(low) > 3 ORDER BY record_id, pos LIMIT 50)",
    "w1_first_evidence": TOK + ", o AS (" + " UNION ALL ".join(f"SELECT '{f}:' || pattern AS key, record_id, pos, word FROM {_seen(f)}" for f in _KEYS) + ") SELECT key, record_id, pos, word, row_number() OVER (PARTITION BY key ORDER BY record_id, pos) AS rank FROM o QUALIFY rank <= 10",
    "w2_lexicon_ids": f"{TOK} SELECT form, 'LEX_OBS_' || lpad((row_number() OVER (ORDER BY form))::VARCHAR, 6, '0') AS id FROM (SELECT DISTINCT low AS form FROM k)",
    "w3_review_queue": f"{TOK}, q AS (SELECT low AS lemma, count(*) AS frequency FROM k WHERE length(low) >= 3 GROUP BY low ORDER BY 2 DESC, 1 LIMIT 250) SELECT lemma, frequency, unnest(['LEXICAL_LEMMA', 'MORPHOLOGY_SEGMENTATION', 'NOUN_CLASS_OR_AGREEMENT']) AS task_type FROM q",
    "q6_review_tasks": TOK + " " + " UNION ALL ".join(f"SELECT '{f}' AS family, pattern, count(*) AS token_frequency, NULL::VARCHAR AS proposed_analysis FROM {_seen(f)} GROUP BY pattern" + ("" if f == "modifier" else " HAVING count(*) >= 5") for f in _KEYS),
    "j8_neighbours": f"{TOK} SELECT low, nxt AS next, count(*) AS n FROM k WHERE nxt IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
    "j10_missing_records": "SELECT record_id, surface_form FROM evidence_items e WHERE NOT EXISTS (SELECT 1 FROM corpus_records c WHERE c.record_id = e.record_id)",
}
