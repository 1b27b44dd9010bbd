"""Style measures over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import metrics as M
from folioscope.operators.deal import dealt
from folioscope.queries.common import SQL_PARAS, Catalog, sql_bounded, sql_cv, table

catalog = Catalog()


def _documents(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents"))

#: Phrases that the synthetic corpus holds, in place of the standard lexicon.
STRONG = ("of the", "to be", "de la", "in der")
MEDIUM = ("is the", "and the", "en la", "et de", "und die")
ANCHORS = ("it is", "that the", "que la", "mit der")
OVERUSED = ("the", "de", "und", "que")
PRONOUNS = (("he", "he"), ("that", "that"), ("elle", "elles?"), ("ein", "ein(?:e|er|en)?"))
PASSIVE = M.passive_pattern(("is", "was", "be", "are"), "ed|er|on", "s?", ("edes", "anon"))

def section_of_source():
    return F.element_at(F.array(*[F.lit(s) for s in M.SECTIONS]), (F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("int"), F.lit(len(M.SECTIONS))) + 1).cast("int"))

_TOKENS = r"[t FOR t IN string_split_regex(x, '\s+') IF length(t) > 0]"


def _tokens(x: str) -> str:
    return rf"[t FOR t IN string_split_regex({x}, '\s+') IF length(t) > 0]"


def _plain(x: str) -> str:
    return rf"regexp_replace(replace(lower({x}), 'ё', 'е'), '\s+', ' ', 'g')"


BURSTINESS = f"""
WITH {SQL_PARAS},
m AS (SELECT doc_id, [length(x)::DOUBLE FOR x IN paras] AS p, [len({_tokens('x')})::DOUBLE FOR x IN sents] AS w FROM s),
c AS (SELECT doc_id, len(p) AS paragraph_count, len(w) AS sentence_count, {sql_cv('p')} AS a, {sql_cv('w')} AS b FROM m)
SELECT doc_id, paragraph_count, sentence_count, round(a, 6) AS paragraph_cv, round(b, 6) AS sentence_cv,
  CASE WHEN paragraph_count = 0 THEN NULL WHEN a < 0.25 OR b < 0.30 THEN 'too uniform' WHEN a < 0.35 OR b < 0.40 THEN 'suspicious' ELSE 'human-like' END AS verdict FROM c
"""


@catalog.add("burstiness", BURSTINESS)
def burstiness(spark, sf_dir):
    return M.burstiness(_documents(spark, sf_dir))


def _hits(phrases) -> str:
    return "[" + ", ".join(f"{{'phrase': '{p}', 'n': {sql_bounded('plain', p.replace(' ', '  '))}}}" for p in phrases) + "]"


PHRASES = f"""
WITH d AS (SELECT doc_id, len({_tokens("coalesce(text, '')")}) AS words, {_plain("coalesce(text, '')")} AS plain FROM documents),
h AS (SELECT doc_id, words, {_hits(STRONG)} AS s, {_hits(MEDIUM)} AS m FROM d),
c AS (SELECT doc_id, words, list_sum([x.n FOR x IN s])::BIGINT AS n_strong, list_sum([x.n FOR x IN m])::BIGINT AS n_medium FROM h),
t AS (SELECT doc_id, coalesce(string_agg(phrase || '=' || n, ';' ORDER BY n DESC, i), '') AS top_strong FROM
  (SELECT doc_id, unnest(s).phrase AS phrase, unnest(s).n AS n, unnest(range(len(s))) AS i FROM h) WHERE n > 0 GROUP BY doc_id),
r AS (SELECT *, CASE WHEN words > 0 THEN n_strong / words * 1000 ELSE 0 END AS a, CASE WHEN words > 0 THEN n_medium / words * 1000 ELSE 0 END AS b FROM c)
SELECT doc_id, words, n_strong, n_medium, round(a, 6) AS strong_per_1k, round(b, 6) AS medium_per_1k, coalesce(top_strong, '') AS top_strong,
  CASE WHEN a > 0.5 THEN 'too many strong' WHEN a > 0.2 OR b > 3.0 THEN 'suspicious' ELSE 'acceptable' END AS verdict FROM r LEFT JOIN t USING (doc_id)
"""


@catalog.add("phrase_density", PHRASES)
def phrase_density(spark, sf_dir):
    return M.phrase_density(_documents(spark, sf_dir), STRONG, MEDIUM)


PLAIN = (
    "WITH c AS (SELECT doc_id, ("
    + " + ".join(f"((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{p}', ''))) // {len(p)})" for p in (*STRONG, *MEDIUM))
    + ")::BIGINT AS n FROM documents) SELECT doc_id, n, CASE WHEN n = 0 THEN 'none' WHEN n <= 3 THEN 'few' WHEN n <= 8 THEN 'many' ELSE 'too many' END AS verdict FROM c"
)


@catalog.add("plain_phrase_counts", PLAIN)
def plain_phrase_counts(spark, sf_dir):
    return M.plain_phrase_counts(_documents(spark, sf_dir), (*STRONG, *MEDIUM))


_LETTERS = r"[w FOR w IN regexp_extract_all(lower(x), '[\p{L}\p{N}_]+') IF regexp_full_match(w, '\p{L}+')]"

TTR = f"""
WITH d AS (SELECT doc_id, {_LETTERS.replace('lower(x)', "lower(coalesce(text, ''))")} AS w FROM documents),
c AS (SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words, len([x FOR x IN w IF x IN ('the', 'de', 'und', 'que')]) AS over FROM d),
r AS (SELECT *, distinct_words / words AS ttr, over / words * 1000 AS o FROM c)
SELECT doc_id, words, distinct_words, CASE WHEN words >= 100 THEN round(ttr, 6) END AS ttr, CASE WHEN words >= 100 THEN round(o, 6) END AS overused_per_1k,
  CASE WHEN words >= 100 THEN (CASE WHEN ttr < 0.18 THEN 'poor' WHEN ttr < 0.25 THEN 'slightly poor' ELSE 'diverse' END) || (CASE WHEN o > 12 THEN '; overused words' ELSE '' END) END AS verdict FROM r
"""


@catalog.add("type_token_ratio", TTR)
def type_token_ratio(spark, sf_dir):
    return M.lexical_diversity(_documents(spark, sf_dir), OVERUSED, with_mtld=False).drop("mtld")


@catalog.add("mtld")
def mtld(spark, sf_dir):
    return M.lexical_diversity(_documents(spark, sf_dir), OVERUSED)


ANCHORS_SQL = f"""
WITH d AS (SELECT doc_id, len({_tokens("coalesce(text, '')")}) AS words, {_plain("coalesce(text, '')")} AS plain FROM documents),
h AS (SELECT doc_id, words, [x FOR x IN {_hits(ANCHORS)} IF x.n > 0] AS h FROM d),
c AS (SELECT doc_id, words, coalesce(list_sum([x.n FOR x IN h]), 0)::BIGINT AS anchors, len(h) AS distinct_anchors FROM h),
r AS (SELECT *, CASE WHEN words > 0 THEN anchors / words * 1000 ELSE 0 END AS a FROM c)
SELECT doc_id, words, anchors, distinct_anchors, round(a, 6) AS per_1k, CASE WHEN a > 1.5 THEN 'too many' WHEN a < 0.2 AND words > 3000 THEN 'no author voice' ELSE 'balanced' END AS verdict FROM r
"""


@catalog.add("author_anchors", ANCHORS_SQL)
def author_anchors(spark, sf_dir):
    return M.author_anchors(_documents(spark, sf_dir), (), ANCHORS)


PRONOUNS_SQL = rf"""
WITH c AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(' ' || coalesce(text, '') || ' ', '([^\p{{L}}\p{{N}}_])([А-ЯЁA-Z]\.\s?[А-ЯЁA-Z]\.([\s]?[А-ЯЁA-Z]\.)?)', '\1 ', 'g'), '([^\p{{L}}\p{{N}}_])[А-ЯЁA-Z]\.', '\1 ', 'g'), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')) AS t FROM documents),
n AS (SELECT doc_id, [{", ".join(f"{{'phrase': '{label}', 'n': len(regexp_extract_all(t, '[^{chr(92)}p{{L}}{chr(92)}p{{N}}_](?:{form})[^{chr(92)}p{{L}}{chr(92)}p{{N}}_]'))}}" for label, form in PRONOUNS)}] AS h FROM c)
SELECT doc_id, list_sum([x.n FOR x IN h])::BIGINT AS total, array_to_string([x.phrase || '=' || x.n FOR x IN h IF x.n > 0], ';') AS found,
  CASE WHEN list_sum([x.n FOR x IN h]) = 0 THEN 'clean' ELSE 'present' END AS verdict FROM n
"""


@catalog.add("pronouns", PRONOUNS_SQL)
def pronouns(spark, sf_dir):
    return M.pronouns(_documents(spark, sf_dir), PRONOUNS)


RHYTHM = f"""
WITH {SQL_PARAS},
u AS (SELECT doc_id, unnest([length(x) FOR x IN paras]) AS n, unnest(range(len(paras))) AS i FROM s),
l AS (SELECT doc_id, i, n, lag(n) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM u),
g AS (SELECT doc_id, i, sum(CASE WHEN b IS NOT NULL AND abs(n - b) / b < 0.20 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l),
r AS (SELECT doc_id, max(k) AS k FROM (SELECT doc_id, island, count(*) AS k FROM g GROUP BY ALL) GROUP BY doc_id),
c AS (SELECT doc_id, len(paras) AS paragraph_count, CASE WHEN len(paras) >= 5 THEN k END AS longest FROM s LEFT JOIN r USING (doc_id))
SELECT doc_id, paragraph_count, longest, CASE WHEN longest >= 5 THEN 'long run' WHEN longest >= 4 THEN 'slightly monotonous' WHEN longest IS NOT NULL THEN 'good' END AS verdict FROM c
"""


@catalog.add("rhythm_runs", RHYTHM)
def rhythm_runs(spark, sf_dir):
    return M.paragraph_rhythm(_documents(spark, sf_dir))


_OVER_50 = SQL_PARAS.replace("> 30", "> 50")

CV_RULE = f"""
WITH {_OVER_50},
m AS (SELECT doc_id, [length(x)::DOUBLE FOR x IN paras] AS p FROM s),
c AS (SELECT doc_id, len(p) AS paragraph_count, CASE WHEN len(p) >= 10 THEN {sql_cv('p')} END AS v FROM m)
SELECT doc_id, paragraph_count, round(v, 6) AS cv, CASE WHEN v < 0.25 THEN 'warning' WHEN v < 0.35 THEN 'info' WHEN v IS NOT NULL THEN 'ok' END AS level FROM c
"""


@catalog.add("cv_rule", CV_RULE)
def cv_rule(spark, sf_dir):
    return M.rhythm_cv(_documents(spark, sf_dir))


STARTS = f"""
WITH {_OVER_50},
u AS (SELECT doc_id, unnest([lower(array_to_string({_tokens('x')}[1:2], ' ')) FOR x IN paras]) AS k, unnest(range(len(paras))) AS i FROM s),
l AS (SELECT doc_id, i, k, lag(k) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM u),
g AS (SELECT doc_id, i, sum(CASE WHEN b = k THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l),
r AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, len(paras) AS paragraph_count, coalesce(n, 0) AS longest, coalesce(n, 0) >= 3 AS warning FROM s LEFT JOIN r USING (doc_id)
"""


@catalog.add("same_starts", STARTS)
def same_starts(spark, sf_dir):
    return M.same_starts(_documents(spark, sf_dir))


STARTERS = f"""
WITH {SQL_PARAS},
b AS (SELECT doc_id, len(sents) AS n, [y FOR y IN [regexp_replace(lower(array_to_string({_tokens('x')}[1:2], ' ')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') FOR x IN sents] IF length(y) > 0] AS k FROM s),
r AS (SELECT doc_id, count(*) AS repeated FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(k) AS x FROM b) GROUP BY ALL) WHERE c >= 3 GROUP BY doc_id),
c AS (SELECT doc_id, n, len(k) AS sentences, len(list_distinct(k)) AS distinct_starts, coalesce(repeated, 0) AS repeated, CASE WHEN n >= 10 THEN (CASE WHEN len(k) > 0 THEN len(list_distinct(k)) / len(k) ELSE 0 END) END AS v FROM b LEFT JOIN r USING (doc_id))
SELECT doc_id, CASE WHEN n >= 10 THEN sentences END AS sentences, CASE WHEN n >= 10 THEN distinct_starts END AS distinct_starts, CASE WHEN n >= 10 THEN repeated END AS repeated, round(v, 6) AS variety,
  CASE WHEN v < 0.50 THEN 'monotonous' WHEN v < 0.65 THEN 'slightly monotonous' WHEN v IS NOT NULL THEN 'diverse' END AS verdict FROM c
"""


@catalog.add("starter_variety", STARTERS)
def starter_variety(spark, sf_dir):
    return M.starter_variety(_documents(spark, sf_dir))


PASSIVE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(regexp_replace(' ' || replace(lower(text), 'ё', 'е') || ' ', '([^\p{L}\p{N}_])', '\1\1', 'g'), '[^\p{L}\p{N}_](?:(?:is|was|be|are)\s+[\p{L}\p{N}_]+?(?:ed|er|on)s?|(?:edes|anon)s?)[^\p{L}\p{N}_]')) AS marks,
  len([z FOR z IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) IF length(z) > 5 AND length(trim(z)) > 0]) AS sentences FROM d),
r AS (SELECT *, CASE WHEN sentences > 0 THEN marks / sentences END AS v FROM c)
SELECT doc_id, marks, sentences, round(v, 6) AS ratio, CASE WHEN v > 0.70 THEN 'excessive' WHEN v > 0.50 THEN 'slightly heavy' WHEN v < 0.15 THEN 'unusually low' WHEN v IS NOT NULL THEN 'balanced' END AS verdict FROM r
"""


@catalog.add("passive_ratio", PASSIVE_SQL)
def passive_ratio(spark, sf_dir):
    return M.passive_ratio(_documents(spark, sf_dir), PASSIVE)


READABILITY = f"""
WITH {SQL_PARAS},
m AS (SELECT doc_id, [len({_tokens('x')}) FOR x IN sents] AS n, [length(y)::DOUBLE FOR y IN flatten([{_LETTERS} FOR x IN sents]) IF length(y) > 1] AS w FROM s),
c AS (SELECT doc_id, len(n) AS sentences, CASE WHEN len(n) >= 10 THEN len([x FOR x IN n IF x < 8]) / len(n) END AS a, CASE WHEN len(n) >= 10 THEN len([x FOR x IN n IF x > 25]) / len(n) END AS b, CASE WHEN len(n) >= 10 THEN coalesce(list_avg(w), 0) END AS k FROM m)
SELECT doc_id, sentences, round(a, 6) AS short_share, round(b, 6) AS long_share, round(k, 6) AS mean_word_length,
  CASE WHEN a < 0.05 AND b < 0.10 THEN 'same length range' WHEN 1 - a - b > 0.90 THEN 'slightly uniform' WHEN a IS NOT NULL THEN 'natural' END AS verdict FROM c
"""


@catalog.add("readability", READABILITY)
def readability(spark, sf_dir):
    return M.readability(_documents(spark, sf_dir))


def _weights(i: int) -> str:
    return "CASE section " + " ".join(f"WHEN '{s}' THEN {w[i]}" for s, (w, _) in M.SECTIONS.items()) + " END"


def _points(name: str) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{v}' THEN {n}" for v, n in M.POINTS[name].items()) + " ELSE 0 END"


def _limit(k: int) -> str:
    return "CASE section " + " ".join(f"WHEN '{s}' THEN {t[k]}" for s, (_, t) in M.SECTIONS.items()) + " END"


_SUM = " + ".join(f"({_points(n)}) * ({_weights(i)})" for i, n in enumerate(M.MEASURES))
RISK = f"""
WITH q1 AS ({BURSTINESS}), q2 AS ({PHRASES}), q3 AS ({TTR}), q4 AS ({RHYTHM}), q5 AS ({STARTERS}), q6 AS ({PASSIVE_SQL}), q7 AS ({READABILITY}), q8 AS ({ANCHORS_SQL}), q9 AS ({PRONOUNS_SQL}),
b AS (SELECT doc_id, [{", ".join(f"'{s}'" for s in M.SECTIONS)}][regexp_extract(source, '(\\d+)$', 1)::INT % {len(M.SECTIONS)} + 1] AS section, q2.words AS words,
  q1.verdict AS burstiness, q2.verdict AS ngrams, q3.verdict AS lexical, q4.verdict AS rhythm, q5.verdict AS starters, q6.verdict AS passive, q7.verdict AS readability, q8.verdict AS anchors, q9.total AS pronouns
  FROM documents JOIN q1 USING (doc_id) JOIN q2 USING (doc_id) JOIN q3 USING (doc_id) JOIN q4 USING (doc_id) JOIN q5 USING (doc_id) JOIN q6 USING (doc_id) JOIN q7 USING (doc_id) JOIN q8 USING (doc_id) JOIN q9 USING (doc_id)),
c AS (SELECT *, least(round(({_SUM} + CASE WHEN pronouns > 0 THEN 5 ELSE 0 END)::DOUBLE, 1), 100.0) AS s,
  array_to_string([x FOR x IN [{", ".join(f"CASE WHEN ({_points(n)}) > 0 THEN '{n}' END" for n in M.MEASURES)}, CASE WHEN pronouns > 0 THEN 'pronouns' END] IF x IS NOT NULL], ',') AS f FROM b)
SELECT doc_id, section, words, CASE WHEN words >= 300 THEN s END AS score, CASE WHEN words < 300 THEN 'INSUFFICIENT' WHEN s < {_limit(0)} THEN 'LOW' WHEN s < {_limit(1)} THEN 'MODERATE' WHEN s < {_limit(2)} THEN 'HIGH' ELSE 'CRITICAL' END AS level, CASE WHEN words >= 300 THEN f END AS flags FROM c
"""


@catalog.add("risk_score", RISK)
def risk_score(spark, sf_dir):
    # the lexical verdict's words are the standard ones of the measure; the corpus's own stand in for them here
    docs = _documents(spark, sf_dir)
    return M.risk(docs, section_of_source(), STRONG, MEDIUM, ANCHORS, PRONOUNS, PASSIVE, with_mtld=False, overused=OVERUSED)


@catalog.add("risk_score_full")
def risk_score_full(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return M.risk(docs, section_of_source(), STRONG, MEDIUM, ANCHORS, PRONOUNS, PASSIVE, overused=OVERUSED)


@catalog.add(
    "insufficient_gate",
    f"WITH d AS (SELECT source, len({_tokens(chr(34) + 'text' + chr(34))}) AS words FROM documents) SELECT source, count(*) AS documents, count(*) FILTER (words < 300) AS too_short, count(*) FILTER (words < 120) AS too_short_section, CASE WHEN bool_and(words < 300) THEN 'insufficient' WHEN bool_or(words < 300) THEN 'incomplete' ELSE 'ok' END AS status FROM d GROUP BY source",
)
def insufficient_gate(spark, sf_dir):
    return M.sufficiency(_documents(spark, sf_dir), "source")


@catalog.add(
    "chapter_length",
    f"WITH {SQL_PARAS}, c AS (SELECT doc_id, coalesce(list_sum([length(x) FOR x IN paras]), 0)::BIGINT AS chars FROM s), r AS (SELECT *, chars / 1800 AS v FROM c) SELECT doc_id, chars, round(v, 6) AS pages, CASE WHEN v < 5 THEN 'too short' WHEN v < 8 THEN 'short' WHEN v > 25 THEN 'long' ELSE 'ok' END AS level FROM r",
)
def chapter_length(spark, sf_dir):
    return M.chapter_pages(_documents(spark, sf_dir))


@catalog.add(
    "work_length",
    f"WITH {SQL_PARAS}, c AS (SELECT source, lang, sum(coalesce(list_sum([length(x) FOR x IN paras]), 0)) / 1800 + 6 AS v FROM s JOIN documents USING (doc_id) GROUP BY ALL) SELECT source, lang, round(v, 6) AS pages, CASE WHEN v < 8 THEN 'below' WHEN v > 72 THEN 'above' ELSE 'ok' END AS level FROM c",
)
def work_length(spark, sf_dir):
    return M.work_pages(_documents(spark, sf_dir), ["source", "lang"], 10, 60)
