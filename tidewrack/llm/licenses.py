"""License scans: ordered signature rules over word sequences.

A text is A-Z lowered and cut into words of 0-9, a-z and anything beyond ASCII.
Texts that hold none of the rules' roots (one regex over the raw text) are done
with their word count. On the others, every rule whose keyword is there runs its
regex over the words; detections that lie within one of higher priority, or
within a longer one of the same, are suppressed. Base phrases are counted apart
and never suppressed. All of it is DataFrame code, row by row: nothing is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import rules

#: phrase and label of the base detections
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: One of these is in whatever a rule can match, in A-Z lowered text; a test holds all rules against it.
ROOTS = (
    "licen gpl copyright domain rights spdx granted permission redistribution endorse advertising provided exception attribution noncommercial noderiv sharealike "
    "commons cc0 wtfpl unencumbered evil apache bsd released openrail agreement proprietary confidential terms expat mulan polyform reproduced"
).split() + [f"cc{BREAK}by", f"mpl{BREAK}(?:version|2)", f"asl{BREAK}2"]


def gate_regex() -> str:
    """The roots as one regex, by first letter and behind a look at it, so that most places are left at once."""
    by: dict[str, list[str]] = {}
    for root in ROOTS:
        by.setdefault(root[0], []).append(root[1:])
    return f"(?=[{''.join(sorted(by))}])(?:{'|'.join(f'{a}(?:{chr(124).join(rest)})' for a, rest in sorted(by.items()))})"


def _spaced(regex: str) -> str:
    """A rule's regex for words that each have a space on either side."""
    return " " + regex.replace("(?:", "\0").replace(" ", "  ").replace("\0", "(?:") + " "


def _rules() -> list[tuple[int, str, int, str, str]]:
    return [(i, label, priority, keyword, _spaced(rx)) for i, (label, priority, keyword, rx) in enumerate(rules())]


def spaced_words(text: str) -> str:
    """SQL for the words of text, lower-case, each with a space on either side."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"concat(' ', trim(regexp_replace(translate({text}, '{upper}', '{lower}'), r'{BREAK}', '  ')), ' ')"


def word_places(words: str, regex: str) -> str:
    """SQL for the places where regex matches the spaced words: array of (s, e), in words.

    Sums run over chunks of 64 matches first, so that many matches stay cheap.
    """
    count = lambda x: f"cast((length({x}) - length(replace({x}, ' ', ''))) div 2 as int)"
    return f"""
    transform(array(struct(split({words}, {regex}, -1) AS g, regexp_extract_all({words}, {regex}, 0) AS m)), r -> if(size(r.m) = 0, cast(array() AS array<struct<s:int,e:int>>),
      transform(array(transform(sequence(1, size(r.m)), i -> struct({count("r.g[i - 1]")} AS g, {count("r.m[i - 1]")} AS m))), z ->
        transform(array(aggregate(
            sequence(0, (size(z) - 1) div 64), array(0),
            (acc, c) -> concat(acc, array(element_at(acc, -1) + aggregate(slice(z, c * 64 + 1, 64), 0, (t, x) -> t + x.g + x.m))))), p ->
          flatten(transform(sequence(0, (size(z) - 1) div 64), c -> aggregate(
            slice(z, c * 64 + 1, 64),
            struct(p[c] AS at, cast(array() AS array<struct<s:int,e:int>>) AS o),
            (acc, x) -> struct(acc.at + x.g + x.m AS at, concat(acc.o, array(struct(acc.at + x.g AS s, acc.at + x.g + x.m AS e))) AS o),
            acc -> acc.o))))[0])[0]))[0]"""


def scan(docs: DataFrame) -> DataFrame:
    """The licenses of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections holds (s, e, priority, rule, label) of what isn't suppressed, in
    words; score is the highest priority among them as tenths, 0 without any.
    Null and empty texts have no words and no labels. Rows that repeat stay;
    other columns are left out.
    """
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # lowering may turn a few letters beyond ASCII into ASCII ones; that only opens the gate to more
    gate = F.lower("text").rlike(gate_regex())
    seen = held.select(
        "doc_id",
        F.regexp_count("text", F.lit(WORDS)).cast("long").alias("n_words"),
        F.when(gate, F.expr(spaced_words("text"))).alias("words"),
    )
    base = F.array(
        *(
            F.struct(F.lit(label).alias("label"), F.expr(f"coalesce({word_places('words', chr(39) + ' ' + phrase.replace(' ', '  ') + ' ' + chr(39))}, {NO_PLACES})").alias("at"))
            for phrase, label in PHRASES
        )
    )
    quote = lambda s: "r'" + s.replace("'", "\\'") + "'"
    listed = ", ".join(f"struct({i} AS i, {quote(label)} AS label, {p} AS p, {quote(k)} AS k, {quote(rx)} AS rx)" for i, label, p, k, rx in _rules())
    hits = F.expr(f"""
      coalesce(array_sort(flatten(transform(filter(array({listed}), r -> contains(words, r.k)),
        r -> transform({word_places("words", "r.rx")}, x -> struct(x.s AS s, -x.e AS back, -r.p AS rank, r.i AS i, r.label AS label))))), {NO_HITS})""")
    # In this order a detection comes after all that hold it: it goes if one before it of its priority or more reaches its
    # end. far[p] is how far those of priority p or more reach. The fold runs over chunks of the root of their number, once
    # for what stands at the chunks' beginnings and once within each, so that many detections stay cheap.
    reach = "transform({far}, (f, j) -> if(j <= -x.rank, greatest(f, -x.back), f))"
    kept = F.expr(f"""
      transform(array(struct(hits AS h, cast(ceil(sqrt(size(hits))) AS int) AS b)), z -> if(size(z.h) = 0, {NO_DETECTIONS},
        transform(array(aggregate(
            sequence(0, (size(z.h) - 1) div z.b), array(array_repeat(-1, 10)),
            (acc, c) -> concat(acc, array(aggregate(slice(z.h, c * z.b + 1, z.b), element_at(acc, -1), (far, x) -> {reach.format(far="far")}))))), p ->
          flatten(transform(sequence(0, (size(z.h) - 1) div z.b), c -> aggregate(
            slice(z.h, c * z.b + 1, z.b),
            struct(p[c] AS far, {NO_DETECTIONS} AS out),
            (acc, x) -> struct({reach.format(far="acc.far")} AS far,
              if(acc.far[-x.rank] >= -x.back, acc.out, concat(acc.out, array(struct(x.s AS s, -x.back AS e, -x.rank AS priority, x.i AS rule, x.label AS label)))) AS out),
            acc -> acc.out))))[0]))[0]""")
    found = seen.withColumn("base", base).withColumn("hits", hits).withColumn("detections", kept)
    starts = F.flatten(F.transform("base", lambda b: F.transform(b["at"], lambda x: x["s"])))
    base_labels = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform("detections", lambda x: x["label"]))), ",").alias("labels"),
        (F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])), F.lit(0)) / 10).alias("score"),
        "detections",
    )


NO_PLACES = "cast(array() AS array<struct<s:int,e:int>>)"
NO_DETECTIONS = "cast(array() AS array<struct<s:int,e:int,priority:int,rule:int,label:string>>)"
NO_HITS = "cast(array() AS array<struct<s:int,back:int,rank:int,i:int,label:string>>)"


def oracle_sql() -> str:
    """The same in DuckDB SQL: every rule over every text, suppression by pairs."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    listed = ", ".join(f"({i}, {quote(label)}, {p}, {quote(k)}, {quote(rx)})" for i, label, p, k, rx in _rules())
    phrases = ", ".join(f"({quote(label)}, {quote(' ' + phrase.replace(' ', '  ') + ' ')})" for phrase, label in PHRASES)

    def placed(source: str, keep: str) -> str:
        return f"""
  SELECT {keep}, s, s + {count("m[i]")} AS e FROM (
    SELECT *, list_sum([{count("x")} for x in g[1:i]])::BIGINT + coalesce(list_sum([{count("x")} for x in m[1:i - 1]]), 0)::BIGINT AS s
    FROM {source}, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i))"""

    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT id, doc_id, len(regexp_extract_all(text, '{WORDS}')) AS n_words,
  ' ' || trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}', '  ', 'g'), ' ') || ' ' AS words FROM docs),
phrases(label, rx) AS (VALUES {phrases}),
rules(i_, label, p, k, rx) AS (VALUES {listed}),
base_m AS (SELECT id, label, regexp_split_to_array(words, rx) AS g, regexp_extract_all(words, rx) AS m FROM worded, phrases WHERE contains(words, rx)),
base AS ({placed("base_m", "id, label")}),
rule_m AS MATERIALIZED (SELECT id, i_, p, label, regexp_split_to_array(words, rx) AS g, regexp_extract_all(words, rx) AS m FROM worded, rules WHERE contains(words, k) AND regexp_matches(words, rx)),
hits AS MATERIALIZED ({placed("rule_m", "id, i_, p, label")}),
kept AS (SELECT * FROM hits h WHERE NOT EXISTS (
  SELECT 1 FROM hits o WHERE o.id = h.id AND o.s <= h.s AND o.e >= h.e
    AND (o.p > h.p OR o.p = h.p AND (o.s < h.s OR o.e > h.e OR o.i_ < h.i_)))),
bases AS (SELECT id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word FROM base GROUP BY id),
tops AS (SELECT id, max(p) AS p FROM kept GROUP BY id),
base_names AS (SELECT id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT id, label FROM base) GROUP BY id),
names AS (SELECT id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM base UNION SELECT id, label FROM kept) GROUP BY id)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(p, 0) / 10 AS score
FROM worded LEFT JOIN bases USING (id) LEFT JOIN tops USING (id) LEFT JOIN base_names USING (id) LEFT JOIN names USING (id)"""
