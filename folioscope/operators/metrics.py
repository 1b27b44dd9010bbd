"""Style and diversity measures of documents, and the risk score.

Every measure is a map over rows: paragraphs, sentences and words are arrays of their document, so nothing is exploded and nothing is shuffled. Each function takes a table with doc_id and text and returns a row for each of its rows; a document for which a measure says nothing has null in its place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import lexicons as L
from folioscope.functions import text as X


#: Columns that a measure hands on.
KEEP = ("doc_id",)


def _sd(values: Column) -> Column:
    """Sample standard deviation of an array of numbers; 0 for one value or none."""
    n = F.size(values)
    mean = _mean(values)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(F.lit(0.0))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))


def _cv(values: Column) -> Column:
    mean = _mean(values)
    return F.when(mean > 0, _sd(values) / mean).otherwise(F.lit(0.0))


def parts(docs: DataFrame, more_than: int = 30) -> DataFrame:
    """docs with paras and sents: arrays of paragraphs and of their sentences, where it hasn't them already."""
    if {"paras", "sents"} <= set(docs.columns):
        return docs
    return docs.withColumn("paras", X.paragraphs(F.col("text"), more_than)).withColumn("sents", X.sentences(F.col("paras")))


def _with_plain(docs: DataFrame) -> DataFrame:
    """docs with __plain: the folded text with single blanks."""
    return docs if "__plain" in docs.columns else docs.withColumn("__plain", F.regexp_replace(X.fold(X.null_empty(F.col("text"))), X.SPACE, " "))


def prepared(docs: DataFrame) -> DataFrame:
    """docs with what several measures read: __words, paras, sents and __plain, each made once."""
    return _with_plain(parts(docs.withColumn("__words", _words(docs))))


def _words(docs: DataFrame) -> Column:
    """Number of words of the text."""
    return F.col("__words") if "__words" in docs.columns else F.size(X.tokens(F.col("text"))).cast("long")


def burstiness(docs: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """Variation of paragraph lengths (characters) and sentence lengths (words); null verdict without paragraphs."""
    df = parts(docs).select(*keep, F.transform("paras", lambda p: F.length(p).cast("double")).alias("p"), F.transform("sents", lambda s: F.size(X.tokens(s)).cast("double")).alias("s"))
    df = df.select(*keep, F.size("p").cast("long").alias("paragraph_count"), F.size("s").cast("long").alias("sentence_count"), _cv(F.col("p")).alias("p"), _cv(F.col("s")).alias("s"))
    verdict = F.when(F.col("paragraph_count") == 0, F.lit(None)).when((F.col("p") < 0.25) | (F.col("s") < 0.30), "too uniform").when((F.col("p") < 0.35) | (F.col("s") < 0.40), "suspicious").otherwise("human-like")
    return df.select(*keep, "paragraph_count", "sentence_count", F.round("p", 6).alias("paragraph_cv"), F.round("s", 6).alias("sentence_cv"), verdict.alias("verdict"))


def phrase_hits(docs: DataFrame, phrases: Sequence[str], text: Column | None = None) -> Column:
    """An array of (phrase, n) for the phrases that a document holds, in the order of the list."""
    plain = F.col("__plain") if text is None else text
    each = [F.struct(F.lit(p).alias("phrase"), X.count_bounded(plain, _norm(p)).cast("long").alias("n")) for p in phrases]
    return F.filter(F.array(*each), lambda h: h["n"] > 0) if each else F.array().cast("array<struct<phrase:string,n:bigint>>")


def _norm(phrase: str) -> str:
    return " ".join(phrase.strip("\"'«»“”").lower().replace("ё", "е").split())


def _total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + h["n"])


def top_hits(hits: Column, k: int = 5) -> Column:
    """The k most frequent of an array of (phrase, n); equal ones in the order of the list."""
    return F.slice(F.array_sort(hits, lambda a, b: (b["n"] - a["n"]).cast("int")), 1, k)


def phrase_density(docs: DataFrame, strong: Sequence[str] = L.STRONG, medium: Sequence[str] = L.MEDIUM, allowed: Sequence[str] = (), keep: Sequence[str] = KEEP) -> DataFrame:
    """How many phrases of two tiers stand in a document for each thousand words, whatever is allowed left out."""
    skip = {_norm(a) for a in allowed}
    df = _with_plain(docs)
    df = df.select(*keep, _words(df).alias("words"), phrase_hits(df, [p for p in strong if _norm(p) not in skip]).alias("s"), phrase_hits(df, [p for p in medium if _norm(p) not in skip]).alias("m"))
    rate = lambda c: F.when(F.col("words") > 0, _total(F.col(c)) / F.col("words") * 1000).otherwise(F.lit(0.0))
    verdict = F.when(rate("s") > 0.5, "too many strong").when((rate("s") > 0.2) | (rate("m") > 3.0), "suspicious").otherwise("acceptable")
    return df.select(*keep, "words", _total(F.col("s")).alias("n_strong"), _total(F.col("m")).alias("n_medium"), F.round(rate("s"), 6).alias("strong_per_1k"), F.round(rate("m"), 6).alias("medium_per_1k"), F.array_join(F.transform(top_hits(F.col("s")), lambda h: F.concat_ws("=", h["phrase"], h["n"].cast("string"))), ";").alias("top_strong"), verdict.alias("verdict"))


def plain_phrase_counts(docs: DataFrame, phrases: Sequence[str], keep: Sequence[str] = KEEP) -> DataFrame:
    """The other phrase measure: substrings without bounds, overlapping entries counted each, and a verdict on the sum (0, to 3, to 8, more)."""
    low = F.lower(X.null_empty(F.col("text")))
    total = F.lit(0)
    for p in phrases:
        total = total + X.count_plain(low, F.lit(p.lower()))
    df = docs.select(*keep, total.cast("long").alias("n"))
    return df.select(*keep, "n", F.when(F.col("n") == 0, "none").when(F.col("n") <= 3, "few").when(F.col("n") <= 8, "many").otherwise("too many").alias("verdict"))


def mtld(words: Column, threshold: float = 0.72) -> Column:
    """Words over the factors that an ordered walk closes whenever the share of different words falls below the threshold; the rest counts in part.

    The walk keeps a set that grows and empties, which no built-in fold holds without copying it at each word: this one is an Arrow function.
    """

    @F.pandas_udf("double")
    def walk(lists: pd.Series) -> pd.Series:
        out = []
        for one in lists:
            types, n, factors = set(), 0, 0.0
            for w in one if one is not None else ():
                types.add(w)
                n += 1
                if len(types) / n < threshold:
                    factors, types, n = factors + 1, set(), 0
            if n:
                factors += (1 - len(types) / n) / (1 - threshold)
            size = 0 if one is None else len(one)
            out.append(size / factors if factors > 0 else float(size))
        return pd.Series(out, dtype="float64")

    return walk(words)


def lexical_diversity(docs: DataFrame, overused: Sequence[str] = L.OVERUSED, least: int = 100, with_mtld: bool = True, keep: Sequence[str] = KEEP) -> DataFrame:
    """Share of different words, the ordered measure and words used too much; nulls below least words."""
    df = docs.select(*keep, X.letter_words(F.col("text")).alias("w"))
    n = F.size("w")
    df = df.select(*keep, n.cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"), F.size(F.filter("w", lambda w: w.isin(*overused))).cast("long").alias("over"), (F.when(n >= least, mtld(F.col("w"))) if with_mtld else F.lit(None).cast("double")).alias("mtld"))
    enough = F.col("words") >= least
    ttr, over = F.col("distinct_words") / F.col("words"), F.col("over") / F.col("words") * 1000
    verdict = F.when((ttr < 0.18) | (F.coalesce("mtld", F.lit(99.0)) < 45), "poor").when((ttr < 0.25) | (F.coalesce("mtld", F.lit(99.0)) < 60), "slightly poor").otherwise("diverse")
    return df.select(*keep, "words", "distinct_words", F.round(F.when(enough, ttr), 6).alias("ttr"), F.round("mtld", 4).alias("mtld"), F.round(F.when(enough, over), 6).alias("overused_per_1k"), F.when(enough, F.concat(verdict, F.when(over > 12, "; overused words").otherwise(""))).alias("verdict"))


def author_anchors(docs: DataFrame, personal: Sequence[str] = (), builtin: Sequence[str] = L.ANCHORS, keep: Sequence[str] = KEEP) -> DataFrame:
    """Phrases of an author's stance, personal ones first and each once, for each thousand words."""
    seen = {_norm(p): p for p in reversed((*personal, *builtin)) if _norm(p)}
    df = _with_plain(docs)
    df = df.select(*keep, _words(df).alias("words"), phrase_hits(df, list(seen.values())).alias("h"))
    rate = F.when(F.col("words") > 0, _total(F.col("h")) / F.col("words") * 1000).otherwise(F.lit(0.0))
    verdict = F.when(rate > 1.5, "too many").when((rate < 0.2) & (F.col("words") > 3000), "no author voice").otherwise("balanced")
    return df.select(*keep, "words", _total(F.col("h")).alias("anchors"), F.size("h").cast("long").alias("distinct_anchors"), F.round(rate, 6).alias("per_1k"), verdict.alias("verdict"))


def _matches(form: str) -> Callable[[Column], Column]:
    return lambda word: word.rlike(f"^(?:{form})$")


def pronouns(docs: DataFrame, forms: Sequence[tuple[str, str]] = L.PRONOUNS, keep: Sequence[str] = KEEP) -> DataFrame:
    """Personal pronouns by label, once initials are taken out."""
    clean = F.regexp_replace(X.null_empty(F.col("text")), rf"(?<!{X.W})[А-ЯЁA-Z]\.\s?[А-ЯЁA-Z]\.(?:\s?[А-ЯЁA-Z]\.)?", " ")
    clean = F.lower(F.regexp_replace(clean, rf"(?<!{X.W})[А-ЯЁA-Z]\.", " "))
    words = F.regexp_extract_all(clean, F.lit(rf"(?<!{X.W})(?:{'|'.join(form for _, form in forms)})(?!{X.W})"), F.lit(0)) if forms else F.array().cast("array<string>")
    found = docs.select(*keep, words.alias("__found"))  # one pass over the text for all forms
    df = found.select(*keep, F.array(*[F.struct(F.lit(label).alias("phrase"), F.size(F.filter("__found", _matches(form))).cast("long").alias("n")) for label, form in forms]).alias("h"))
    df = df.select(*keep, F.filter("h", lambda h: h["n"] > 0).alias("h"))
    return df.select(*keep, _total(F.col("h")).alias("total"), F.array_join(F.transform("h", lambda h: F.concat_ws("=", h["phrase"], h["n"].cast("string"))), ";").alias("found"), F.when(F.size("h") == 0, "clean").otherwise("present").alias("verdict"))


def longest_run(same: Column) -> Column:
    """Of an array of booleans (is an element like the one before it), the length of the longest run of like elements."""
    end = F.aggregate(same, F.struct(F.lit(1).alias("now"), F.lit(1).alias("most")), lambda a, s: F.struct((n := F.when(s, a["now"] + 1).otherwise(1)).alias("now"), F.greatest(a["most"], n).alias("most")))
    return end["most"]


def paragraph_rhythm(docs: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """The longest run of paragraphs each of which differs from the one before it by less than a fifth of that one; null below five paragraphs."""
    df = parts(docs).select(*keep, F.transform("paras", lambda p: F.length(p)).alias("n"))
    same = F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.abs(F.get("n", i) - F.get("n", i - 1)) / F.get("n", i - 1) < 0.20)
    df = df.select(*keep, F.size("n").cast("long").alias("paragraph_count"), F.when(F.size("n") >= 5, longest_run(same)).cast("long").alias("longest"))
    return df.select(*keep, "paragraph_count", "longest", F.when(F.col("longest") >= 5, "long run").when(F.col("longest") >= 4, "slightly monotonous").when(F.col("longest").isNotNull(), "good").alias("verdict"))


def rhythm_cv(docs: DataFrame, more_than: int = 50, least: int = 10, keep: Sequence[str] = KEEP) -> DataFrame:
    """The other rhythm measure: variation of paragraph lengths; null below least paragraphs."""
    df = docs.select(*keep, F.transform(X.paragraphs(F.col("text"), more_than), lambda p: F.length(p).cast("double")).alias("n"))
    df = df.select(*keep, F.size("n").cast("long").alias("paragraph_count"), F.when(F.size("n") >= least, _cv(F.col("n"))).alias("cv"))
    return df.select(*keep, "paragraph_count", F.round("cv", 6).alias("cv"), F.when(F.col("cv") < 0.25, "warning").when(F.col("cv") < 0.35, "info").when(F.col("cv").isNotNull(), "ok").alias("level"))


def same_starts(docs: DataFrame, more_than: int = 50, keep: Sequence[str] = KEEP) -> DataFrame:
    """The longest run of paragraphs that begin with the same two words; three or more are a warning."""
    df = docs.select(*keep, F.transform(X.paragraphs(F.col("text"), more_than), lambda p: F.lower(F.array_join(F.slice(X.tokens(p), 1, 2), " "))).alias("s"))
    same = F.when(F.size("s") > 1, F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i) == F.get("s", i - 1))).otherwise(F.array().cast("array<boolean>"))
    df = df.select(*keep, F.size("s").cast("long").alias("paragraph_count"), F.when(F.size("s") > 0, longest_run(same)).otherwise(0).cast("long").alias("longest"))
    return df.select(*keep, "paragraph_count", "longest", (F.col("longest") >= 3).alias("warning"))


def starter_variety(docs: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """Share of different beginnings (two words, no punctuation) of sentences; null below ten sentences."""
    starts = F.filter(F.transform("sents", lambda s: F.regexp_replace(F.lower(F.array_join(F.slice(X.tokens(s), 1, 2), " ")), r"[^\p{L}\p{N}_\s]", "")), lambda s: F.length(s) > 0)
    df = parts(docs).select(*keep, F.size("sents").alias("n"), starts.alias("s"))
    df = df.withColumn("d", F.array_distinct("s"))
    repeated = F.filter(F.transform("d", lambda x: F.struct(F.size(F.filter("s", lambda y: y == x)).cast("long").alias("n"), x.alias("phrase"))), lambda r: r["n"] >= 3)
    df = df.select(*keep, F.when(F.col("n") >= 10, F.size("s")).cast("long").alias("sentences"), F.when(F.col("n") >= 10, F.size("d")).cast("long").alias("distinct_starts"), F.when(F.col("n") >= 10, F.size(repeated)).cast("long").alias("repeated"))
    ratio = F.when(F.col("sentences") > 0, F.col("distinct_starts") / F.col("sentences")).when(F.col("sentences") == 0, 0.0)
    return df.select(*keep, "sentences", "distinct_starts", "repeated", F.round(ratio, 6).alias("variety"), F.when(ratio < 0.50, "monotonous").when(ratio < 0.65, "slightly monotonous").when(ratio.isNotNull(), "diverse").alias("verdict"))


def passive_pattern(auxiliaries: Sequence[str] = ("был", "была", "было", "были", "будет", "будут", "бывает", "бывают"), endings: str = "ан|ян|ен|ыт|ит|ят|ут", tail: str = "[аоы]?", stems: Sequence[str] = L.PASSIVE_STEMS) -> str:
    """An auxiliary and a short participle, or a participle of a known stem."""
    out = rf"(?<!{X.W})(?:{'|'.join(auxiliaries)})\s+{X.W}+?(?:{endings}){tail}(?!{X.W})"
    return out + (rf"|(?<!{X.W})(?:{'|'.join(stems)}){tail}(?!{X.W})" if stems else "")


def passive_ratio(docs: DataFrame, pattern: str | None = None, keep: Sequence[str] = KEEP) -> DataFrame:
    """Passive marks for each sentence of the whole text; null without sentences."""
    low = F.replace(F.lower(X.null_empty(F.col("text"))), F.lit("ё"), F.lit("е"))
    df = docs.select(*keep, F.regexp_count(low, F.lit(pattern or passive_pattern())).cast("long").alias("marks"), F.size(X.split_sentences(X.null_empty(F.col("text")))).cast("long").alias("sentences"))
    ratio = F.when(F.col("sentences") > 0, F.col("marks") / F.col("sentences"))
    return df.select(*keep, "marks", "sentences", F.round(ratio, 6).alias("ratio"), F.when(ratio > 0.70, "excessive").when(ratio > 0.50, "slightly heavy").when(ratio < 0.15, "unusually low").when(ratio.isNotNull(), "balanced").alias("verdict"))


def readability(docs: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """Shares of short (under 8 words) and long (over 25) sentences and the mean length of words; null below ten sentences."""
    words = F.filter(F.flatten(F.transform("sents", X.letter_words)), lambda w: F.length(w) > 1)
    df = parts(docs).select(*keep, F.transform("sents", lambda s: F.size(X.tokens(s))).alias("n"), F.transform(words, lambda w: F.length(w).cast("double")).alias("w"))
    total, enough = F.size("n"), F.size("n") >= 10
    share = lambda c: F.when(enough, F.size(c) / total)
    df = df.select(*keep, total.cast("long").alias("sentences"), share(F.filter("n", lambda x: x < 8)).alias("a"), share(F.filter("n", lambda x: x > 25)).alias("b"), F.when(enough, _mean(F.col("w"))).alias("m"))
    return df.select(*keep, "sentences", F.round("a", 6).alias("short_share"), F.round("b", 6).alias("long_share"), F.round("m", 6).alias("mean_word_length"), F.when((F.col("a") < 0.05) & (F.col("b") < 0.10), "same length range").when(1 - F.col("a") - F.col("b") > 0.90, "slightly uniform").when(F.col("a").isNotNull(), "natural").alias("verdict"))


#: Weights of the measures by section, in the order of MEASURES, and the limits of the levels.
MEASURES = ("burstiness", "ngrams", "lexical", "rhythm", "starters", "passive", "readability", "anchors")
SECTIONS = {
    "full": ((1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (20, 40, 60)),
    "chapter2": ((1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (20, 40, 60)),
    "introduction": ((1.0, 1.3, 1.0, 1.0, 1.0, 1.3, 1.0, 0.7), (18, 36, 55)),
    "conclusion": ((0.8, 1.2, 0.8, 0.8, 0.8, 1.2, 0.8, 1.5), (18, 36, 55)),
    "chapter1": ((0.7, 1.0, 0.8, 0.7, 0.7, 1.0, 0.8, 0.8), (25, 48, 68)),
    "chapter3": ((1.2, 1.3, 1.2, 1.2, 1.2, 1.0, 1.0, 1.0), (22, 42, 62)),
}
#: Points of a measure by its verdict.
POINTS = {
    "burstiness": {"too uniform": 30, "suspicious": 15},
    "ngrams": {"too many strong": 30, "suspicious": 15},
    "lexical": {"poor": 20, "poor; overused words": 25, "slightly poor": 10, "slightly poor; overused words": 15, "diverse; overused words": 5},
    "rhythm": {"long run": 15},
    "starters": {"monotonous": 15, "slightly monotonous": 7},
    "passive": {"excessive": 10},
    "readability": {"same length range": 10},
    "anchors": {"too many": 10, "no author voice": 10},
}


def risk(docs: DataFrame, section: Column | None = None, strong: Sequence[str] = L.STRONG, medium: Sequence[str] = L.MEDIUM, anchors: Sequence[str] = L.ANCHORS, pronoun_forms: Sequence[tuple[str, str]] = L.PRONOUNS, passive: str | None = None, least_words: int = 300, with_mtld: bool = True, overused: Sequence[str] = L.OVERUSED) -> DataFrame:
    """The weighted sum of all measures' points, at most 100, its level and the measures that gave points; null below least_words words.

    section names the weights' row (unknown: full). Pronouns give five points, whatever the section.
    """
    known = F.lit("full") if section is None else F.when(section.isin(*SECTIONS), section).otherwise("full")
    df = prepared(docs.select("doc_id", "text", known.alias("__section")))
    steps = {
        "burstiness": burstiness,
        "ngrams": lambda d, keep: phrase_density(d, strong, medium, keep=keep),
        "lexical": lambda d, keep: lexical_diversity(d, overused, with_mtld=with_mtld, keep=keep),
        "rhythm": paragraph_rhythm,
        "starters": starter_variety,
        "passive": lambda d, keep: passive_ratio(d, passive, keep=keep),
        "readability": readability,
        "anchors": lambda d, keep: author_anchors(d, (), anchors, keep=keep),
    }
    keep = list(df.columns)
    for name, measure in steps.items():  # one map over the rows, without a join
        df = measure(df, keep=keep).select(*keep, F.col("verdict").alias(name))
        keep.append(name)
    df = pronouns(df, pronoun_forms, keep=keep).withColumnRenamed("total", "pronouns")
    return score(df.select("doc_id", F.col("__section").alias("section"), F.col("__words").alias("words"), *steps, "pronouns"), least_words)


def score(df: DataFrame, least_words: int = 300) -> DataFrame:
    """The risk of rows with doc_id, section, words, a verdict for each measure and the number of pronouns. A measure without verdict gives nothing."""
    total, flags = F.lit(0.0), []
    for i, name in enumerate(MEASURES):
        points = F.lit(0)
        for verdict, n in POINTS[name].items():
            points = F.when(F.col(name) == verdict, n).otherwise(points)
        weight = F.lit(1.0)
        for section, (weights, _) in SECTIONS.items():
            weight = F.when(F.col("section") == section, weights[i]).otherwise(weight)
        total = total + points * weight
        flags.append(F.when(points > 0, F.lit(name)))
    total = total + F.when(F.col("pronouns") > 0, 5.0).otherwise(0.0)
    flags.append(F.when(F.col("pronouns") > 0, F.lit("pronouns")))
    df = df.withColumn("score", F.least(F.round(total, 1), F.lit(100.0)))
    low = mid = high = F.lit(0)
    for section, (_, limits) in SECTIONS.items():
        own = F.col("section") == section
        low, mid, high = F.when(own, limits[0]).otherwise(low), F.when(own, limits[1]).otherwise(mid), F.when(own, limits[2]).otherwise(high)
    level = F.when(F.col("score") < low, "LOW").when(F.col("score") < mid, "MODERATE").when(F.col("score") < high, "HIGH").otherwise("CRITICAL")
    enough = F.col("words") >= least_words
    return df.select("doc_id", "section", "words", F.when(enough, F.col("score")).alias("score"), F.when(enough, level).otherwise("INSUFFICIENT").alias("level"), F.when(enough, F.array_join(F.array_compact(F.array(*flags)), ",")).alias("flags"))


def sufficiency(docs: DataFrame, by: str, least_words: int = 300, least_section: int = 120) -> DataFrame:
    """For each value of a column how many documents have too few words, and whether all, some or none of them do."""
    df = docs.select(by, F.size(X.tokens(F.col("text"))).alias("words"))
    short = F.col("words") < least_words
    status = F.when(F.bool_and(short), "insufficient").when(F.bool_or(short), "incomplete").otherwise("ok")
    return df.groupBy(by).agg(F.count("*").alias("documents"), F.count_if(short).alias("too_short"), F.count_if(F.col("words") < least_section).alias("too_short_section"), status.alias("status"))


def _chars(docs: DataFrame) -> Column:
    return F.aggregate(X.paragraphs(F.col("text")), F.lit(0).cast("long"), lambda a, p: a + F.length(p))


def chapter_pages(docs: DataFrame, page: int = 1800) -> DataFrame:
    """Length in pages of so many characters, and its band."""
    df = docs.select("doc_id", _chars(docs).alias("chars"))
    pages = F.col("chars") / page
    return df.select("doc_id", "chars", F.round(pages, 6).alias("pages"), F.when(pages < 5, "too short").when(pages < 8, "short").when(pages > 25, "long").otherwise("ok").alias("level"))


def work_pages(docs: DataFrame, by: Sequence[str], low: float, high: float, page: int = 1800, front: int = 6) -> DataFrame:
    """The whole work's length with front pages, against a range widened by a fifth."""
    df = docs.select(*by, _chars(docs).alias("chars")).groupBy(*by).agg((F.sum("chars") / page + front).alias("v"))
    return df.select(*by, F.round("v", 6).alias("pages"), F.when(F.col("v") < low * 0.8, "below").when(F.col("v") > high * 1.2, "above").otherwise("ok").alias("level"))
