"""Secret scans through trigram postings.

From every rule's regex a Boolean query over trigrams is derived: what any text
that matches must contain. The trigrams of all queries form the index terms;
one pass over each text yields its postings, the queries are answered on them,
and only the rules that are left as candidates run their regex. A rule with no
mandatory trigram scans all texts. All of it is DataFrame code; the driver's
Python only reads the regexes.

The postings are kept beside each document (document-major), so that a text is
never shuffled; ``trigram_index`` gives the same postings by trigram, to be
written once and searched by ``search_index``.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

def either(word: str) -> str:
    """A regex for word, its letters in either case: spelled out, as engines fold other letters differently."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind, regex, group whose length counts, least length. The first three are the base; order is the order of kinds.
RULES: list[tuple[str, str, int, int]] = [
    (
        "assign",
        "(" + "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")]) + ")"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[opsu]_[A-Za-z0-9]{36,255}", 0, 0),
    ("gitlab", "glpat-[A-Za-z0-9_-]{20,}", 0, 0),
    ("slack", "xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("npm", "npm_[A-Za-z0-9]{36}", 0, 0),
    ("pypi", "pypi-[A-Za-z0-9_-]{16,}", 0, 0),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("key_block", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY[A-Z ]{0,8}-----", 0, 0),
]
BASE = 3


# ---- Boolean trigram queries -------------------------------------------------
# A query is True (nothing is mandatory), a trigram, or ("and" | "or", queries).

_EXACT = 24  # as many exact strings as are carried on at most


def _conj(*parts):
    flat: list = []
    for p in parts:
        for q in p[1] if isinstance(p, tuple) and p[0] == "and" else [p]:
            if q is not True and q not in flat:
                flat.append(q)
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _disj(parts):
    parts = list(parts)
    if not parts or any(p is True for p in parts):
        return True
    sets = [frozenset([p] if isinstance(p, str) else map(_frozen, p[1])) if not _is_or(p) else frozenset([_frozen(p)]) for p in parts]
    least = [p for i, p in enumerate(parts) if not any(t < sets[i] or t == sets[i] and j < i for j, t in enumerate(sets))]
    if len(least) == 1:
        return least[0]
    # what all alternatives ask for is asked for once
    split = [p[1] if isinstance(p, tuple) and p[0] == "and" else [p] for p in least]
    common = [q for q in split[0] if all(q in x for x in split[1:])]
    rest = [_conj(*(q for q in x if q not in common)) for x in split]
    return _conj(*common, True if any(x is True for x in rest) else ("or", rest))


def _is_or(p) -> bool:
    return isinstance(p, tuple) and p[0] == "or"


def _frozen(p):
    return p if isinstance(p, str) else (p[0], frozenset(map(_frozen, p[1])))


def _of_string(s: str):
    return _conj(*(s[i : i + 3] for i in range(len(s) - 2)))


def _close(exact: set[str] | None, query):
    """The query once the strings can't be carried on."""
    return query if exact is None else _conj(query, _disj(_of_string(s) for s in sorted(exact)))


def _join(a, b):
    """Of two neighbours (exact strings or None, query)."""
    if a[0] is not None and b[0] is not None and len(a[0]) * len(b[0]) <= _EXACT:
        return {x + y for x, y in product(a[0], b[0])}, _conj(a[1], b[1])
    return (None if b[0] is None else b[0]), _conj(_close(*a), b[1] if b[0] is not None else _close(*b))


def _read(items) -> tuple[set[str] | None, object]:
    """(the strings the last stretch can be, or None; what else is mandatory)."""
    done: tuple = ({""}, True)
    for op, arg in items:
        if op is sre.LITERAL:
            one = ({chr(arg).lower()}, True)
        elif op is sre.IN:
            found: set[str] | None = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    found.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 6:
                    found |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
                else:
                    found = None
                    break
            one = (found if found and len(found) <= _EXACT else None, True)
        elif op is sre.SUBPATTERN:
            one = _read(arg[-1])
        elif op is sre.BRANCH:
            read = [_read(x) for x in arg[1]]
            if all(e is not None and q is True for e, q in read) and sum(len(e) for e, _ in read) <= _EXACT:
                one = (set().union(*(e for e, _ in read)), True)
            else:
                one = (None, _disj(_close(*x) for x in read))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            e, q = _read(inner)
            if (least, most) == (0, 1) and e is not None and q is True and len(e) < _EXACT:
                one = (e | {""}, True)
            elif least == 0:
                one = (None, True)
            else:
                one = (e, q) if (least, most) == (1, 1) else (None, _close(e, q))
        elif op is sre.AT:
            continue
        else:
            one = (None, True)
        if one[0] is None:
            done = (None, _conj(_close(*done), one[1]))
        elif done[0] is None:
            done = (one[0], _conj(done[1], one[1]))
        else:
            done = _join(done, one)
    return done


def trigram_query(regex: str):
    """The Boolean trigram query of a regex, over the text with A-Z lowered: True if nothing is mandatory."""
    return _close(*_read(sre_parser.parse(regex)))


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def answer(query, has):
    """A Column (or bool) for the query, has giving that of one trigram."""
    if isinstance(query, str):
        return has(query)
    parts = [answer(q, has) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


# ---- the scan ----------------------------------------------------------------


def _terms_regex(terms: list[str]) -> str:
    """A look-ahead that captures any of the terms at each place, branching by the first character."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(t[1:])
    return "(?=(" + "|".join(f"{re.escape(a)}(?:{'|'.join(map(re.escape, rest))})" for a, rest in sorted(by.items())) + "))"


def postings(text: Column, terms: list[str]) -> Column:
    """The terms that a text holds, each once. Lowering may turn a few letters beyond ASCII into ASCII ones; that only adds candidates."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_terms_regex(terms)), F.lit(1)))


def matches(text: str, regex: str, group: int) -> str:
    """SQL for the matches of regex in the column text: array of (s, e, n), in code points, n the length of the group.

    Places come from the lengths of matches and of the gaps between them, summed
    over chunks of 64 first, so that texts with very many matches stay cheap.
    """
    rx = "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"""
    transform(array(struct(split({text}, {rx}, -1) AS g, regexp_extract_all({text}, {rx}, 0) AS m, regexp_extract_all({text}, {rx}, {group}) AS b)), r ->
      transform(array(transform(sequence(1, size(r.m)), i -> struct(length(r.g[i - 1]) AS g, length(r.m[i - 1]) AS m, length(r.b[i - 1]) AS n))), z ->
        transform(array(aggregate(
            sequence(0, (size(z) - 1) div 64), array(0),
            (acc, c) -> concat(acc, array(element_at(acc, -1) + aggregate(slice(z, c * 64 + 1, 64), 0, (t, x) -> t + x.g + x.m))))), p ->
          flatten(transform(sequence(0, (size(z) - 1) div 64), c -> aggregate(
            slice(z, c * 64 + 1, 64),
            struct(p[c] AS at, cast(array() AS array<struct<s:int,e:int,n:int>>) AS o),
            (acc, x) -> struct(acc.at + x.g + x.m AS at, concat(acc.o, array(struct(acc.at + x.g AS s, acc.at + x.g + x.m AS e, x.n AS n))) AS o),
            acc -> acc.o))))[0])[0])[0]"""


NONE = "cast(array() AS array<struct<s:int,e:int,n:int>>)"


def _kept(found: Column, k: int, least: int) -> Column:
    kept = F.filter(found, lambda x: x["n"] >= least) if least else found
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def find(docs: DataFrame, rules: list[tuple[str, str, int, int]] = RULES) -> DataFrame:
    """The secrets of docs (doc_id, text): doc_id and found, an array of (s, k, e) in order, k the rule's number.

    Null and empty texts have none. Every row is scanned on its own, so rows
    that repeat give rows that repeat; other columns are left out.
    """
    queries = [trigram_query(rx) for _, rx, _, _ in rules]
    terms = sorted(set().union(*map(trigrams, queries)))
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = held.withColumn("posted", postings(F.col("text"), terms))
    parts = []
    for k, ((_, rx, group, least), query) in enumerate(zip(rules, queries)):
        candidate = F.lit(True) if query is True else answer(query, lambda t: F.array_contains("posted", t))
        if not group:
            # a run of one class is matched whole or not at all, so its least length can stand in the regex
            rx = _long_enough(rx, group, least)
        found = F.when(candidate & F.col("text").rlike(rx), F.expr(matches("text", rx, group))).otherwise(F.expr(NONE))
        parts.append(_kept(found, k, least))
    return held.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def listed(found: Column, rules: list[tuple[str, str, int, int]] = RULES) -> Column:
    """kind:start:end of each, comma-joined."""
    kinds = F.array(*(F.lit(r[0]) for r in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""
    found = find(docs)
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.filter("found", lambda x: x["k"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of the text replaced by mark. All columns stay, other texts as they are, null ones null.

    The rules go over the text in order, each on what those before left: unlike
    in find, what a match that is too short has passed over is looked at too.
    """
    queries = [trigram_query(rx) for _, rx, _, _ in RULES]
    posted = fresh(docs.columns, "posted")
    out = docs.withColumn(posted, postings(F.coalesce("text", F.lit("")), sorted(set().union(*map(trigrams, queries)))))
    for (_, rx, group, least), query in zip(RULES, queries):
        hit = _long_enough(rx, group, least)
        candidate = F.lit(True) if query is True else answer(query, lambda t: F.array_contains(posted, t))
        out = out.withColumn("text", F.when(candidate & F.col("text").rlike(hit), F.regexp_replace("text", F.lit(hit), F.lit(mark))).otherwise(F.col("text")))
    return out.select(*docs.columns)


def _long_enough(regex: str, group: int, least: int) -> str:
    """The rule's regex with the least length of its last, repeated class put in: for replacing."""
    if not least:
        return regex
    head, tail = (regex[:-1], ")") if group and regex.endswith("+)") else (regex, "")
    prefix = re.match(r"[A-Z]*", regex)[0] if not group else ""
    return head[:-1] + "{" + str(least - len(prefix)) + ",}" + tail


def trigram_index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The inverted index of docs over terms: (trigram, doc_id), each pair once."""
    return docs.select("doc_id", F.explode(postings(F.coalesce("text", F.lit("")), terms)).alias("trigram")).distinct()


def search_index(index: DataFrame, query) -> DataFrame:
    """The doc_ids whose postings answer query: one grouping of the postings of its trigrams, whatever its form."""
    kept = index.where(F.col("trigram").isin(sorted(trigrams(query))))
    held = kept.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    return held.where(answer(query, lambda t: F.array_contains("held", t))).select("doc_id")


def oracle_sql(rules: list[tuple[str, str, int, int]] = RULES) -> str:
    """The same in DuckDB SQL, every regex over every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, {quote(kind)} AS kind, regexp_split_to_array(text, {quote(rx)}) AS g, regexp_extract_all(text, {quote(rx)}) AS m, regexp_extract_all(text, {quote(rx)}, {group}) AS b, {least} AS least FROM docs WHERE regexp_matches(text, {quote(rx)})"
        for k, (kind, rx, group, least) in enumerate(rules)
    )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({parts}),
placed AS (
  SELECT doc_id, k, kind, least, length(b[i]) AS n,
    list_sum([length(x) for x in g[1:i]])::BIGINT + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0)::BIGINT AS s, length(m[i]) AS len
  FROM matched, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)),
kept AS (SELECT *, kind || ':' || s || ':' || (s + len) AS span FROM placed WHERE n >= least),
found AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, k) FILTER (k < {BASE}) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN found USING (doc_id)"""
