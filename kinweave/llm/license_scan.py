"""Licence scan by ordered signature rules, in DataFrame operations only.

Texts are lower-cased (A-Z) and read as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space. Documents
without any word stem that a match needs (``HEADS``) are done after one test. For the others the rules whose keyword occurs are tried: a match
is an interval of words. A detection is suppressed if another of a stronger or the same priority contains it (of two
of the same interval and priority the rule that stands first wins). ``labels`` has the labels of the detections that
remain and the base labels, whose phrases are always kept; ``score`` is the share of the text's words that detections
and base phrases cover, 1 at most.

Intervals come from splitting the text at the matches and summing the words before each, so nothing is quadratic in
the length of a text or the number of its matches. Detections are grouped by document (its id and a hash of its text):
no group is larger than one document's matches.

Edge cases: null text counts as empty: no words, no labels (empty string), score 0. Repeated rows: each reported, with
equal results. Null ids pass through. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.license_rules import HEADS, rules
from kinweave.operators.components import cut

#: (phrase, label); every place of one is reported.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: The same words before A-Z are lower-cased, as a union of ranges, which Java tests far faster than its complement.
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worth_a_look(text: Column, base) -> Column:
    """Whether a text can hold a base phrase or a match; F.lower takes more letters to a-z than asked, never fewer."""

    def judged(low: Column) -> Column:
        test = F.lit(False)
        for h in HEADS:
            test = test | low.contains(h)
        for phrase, _ in base:
            every = F.lit(True)
            for w in sorted(phrase.split(), key=len, reverse=True):
                every = every & low.contains(w)
            test = test | every
        return test

    return F.exists(F.array(F.lower(text)), judged)  # bound to a variable, the lower-cased text is made once


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, signatures: list | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    signatures = rules() if signatures is None else signatures
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spaced = F.replace(F.concat(F.lit(" "), F.regexp_replace(_lower(F.col("text")), GAP, " "), F.lit(" ")), F.lit("  "), F.lit(" "))
    read = cut(rows.select(  # texts are read once; those without a head go on as a count of words
        "doc_id", F.xxhash64("text").alias("hash"), F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"), F.when(worth_a_look(F.col("text"), base), spaced).alias("padded"),
    ))
    plain, hot = read.select("doc_id", "hash", "n_words"), read.where("padded is not null").select("doc_id", "hash", "padded")
    n_words = F.greatest(_spaces(F.col("padded")) - 1, F.lit(0))
    firsts, lasts, counts, names = [], [], [], []
    for phrase, label in base:
        parts = F.when(F.col("padded").contains(f" {phrase} "), F.split("padded", rf"(?<= ){phrase}(?= )", -1))
        n = F.coalesce(F.size(parts) - 1, F.lit(0))
        n = F.when(n > 0, n).otherwise(0)
        counts.append(n)
        firsts.append(F.when(n > 0, _spaces(F.element_at(parts, 1)) - 1))
        lasts.append(F.when(n > 0, n_words - _spaces(F.element_at(parts, -1)) + 1 - len(phrase.split())))
        names.append(F.when(n > 0, F.lit(label)))
    least = lambda xs: F.array_min(F.array_compact(F.array(*xs))).cast("long")
    most = lambda xs: F.array_max(F.array_compact(F.array(*xs))).cast("long")
    covered = sum((c * len(p.split()) for c, (p, _) in zip(counts, base)), F.lit(0))
    # of repeated rows one is enough: results are joined back by id and hash
    places = hot.select(
        "doc_id", "hash", sum(counts, F.lit(0)).cast("long").alias("n_base"), least(firsts).alias("first_word"), most(lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*names))).alias("base"), covered.cast("long").alias("base_words"),
    ).where("n_base > 0").dropDuplicates(["doc_id", "hash"])
    per = detections(hot, signatures).groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set("label")).alias("own"), F.sum("words").cast("long").alias("own_words"), F.count(F.lit(1)).alias("n_detections"))
    for part, mark in ((places, "p"), (per, "q")):
        part = part.withColumnsRenamed({"doc_id": f"{mark}_id", "hash": f"{mark}_hash"})
        plain = plain.join(part, F.col("hash").eqNullSafe(F.col(f"{mark}_hash")) & F.col("doc_id").eqNullSafe(F.col(f"{mark}_id")), "left").drop(f"{mark}_id", f"{mark}_hash")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat(F.coalesce("base", none), F.coalesce("own", none))))
    share = F.greatest(F.coalesce("base_words", F.lit(0)), F.coalesce("own_words", F.lit(0))) / F.greatest("n_words", F.lit(1))
    return plain.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.array_join(F.coalesce("base", none), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.least(share, F.lit(1.0)).alias("score"), F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
    )


def detections(texts: DataFrame, signatures) -> DataFrame:
    """(doc_id, hash, label, words) of the matches in (doc_id, hash, padded) that no other suppresses."""
    by_keyword: dict[str, list] = {}
    for n, label, keyword, expression, priority in signatures:
        rule = F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(rf"(?<= )(?:{expression})(?= )").alias("expression"), F.lit(priority).alias("priority"))
        by_keyword.setdefault(keyword, []).append(rule)
    if not by_keyword:
        return texts.select("doc_id", "hash", F.lit("").alias("label"), F.lit(0).alias("words")).limit(0)
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*r).alias("rules")) for k, r in by_keyword.items()])
    hit = F.filter(table, lambda k: F.contains(F.col("padded"), k["keyword"]))
    tried = texts.select("doc_id", "hash", "padded", F.explode(F.flatten(F.transform(hit, lambda k: k["rules"]))).alias("r"))
    matched = tried.select("doc_id", "hash", "r", "padded", F.regexp_extract_all("padded", F.col("r.expression"), F.lit(0)).alias("hits")).where(F.size("hits") > 0)
    gaps = F.split(F.col("padded"), F.col("r.expression"), F.lit(-1))
    placed = matched.select(
        "doc_id", "hash", "r.rule", "r.label", "r.priority",
        F.posexplode(F.arrays_zip(F.transform(F.slice(gaps, 1, F.size("hits")), _spaces).alias("gap"), F.transform("hits", _spaces).alias("inner"))).alias("k", "m"),
    ).distinct()  # repeated rows
    order = Window.partitionBy("doc_id", "hash", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = placed.withColumn("start", F.sum(F.col("m.gap") + F.col("m.inner")).over(order) - F.col("m.inner") - 1)
    spans = spans.select("doc_id", "hash", "rule", "label", "priority", "start", (F.col("start") + F.col("m.inner") + 1).alias("end"))
    # from left to right, the longest first: an interval is contained if one before it reaches as far
    ahead = Window.partitionBy("doc_id", "hash").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({s[4] for s in signatures})
    reach = {p: F.max(F.when(F.col("priority") <= p, F.col("end"))).over(ahead) for p in levels}
    judged = spans.withColumns({f"reach{p}": c for p, c in reach.items()})
    mine = F.lit(None).cast("long")
    for p in levels:
        mine = F.when(F.col("priority") == p, F.col(f"reach{p}")).otherwise(mine)
    return judged.where(F.coalesce(mine, F.lit(-1)) < F.col("end")).select("doc_id", "hash", "label", (F.col("end") - F.col("start")).alias("words"))


def oracle(base: tuple = BASE, signatures: list | None = None) -> str:
    """DuckDB SQL for the same rows. Its expressions cannot look around, so each word there has two spaces of its own."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    double = lambda e: e.replace(" ?", "\x00").replace(" ", "  ").replace("\x00", "(?:  )?")
    table = ", ".join(f"({n}, {quote(label)}, {quote(key)}, {quote(f' (?:{double(e)}) ')}, {p})" for n, label, key, e, p in (rules() if signatures is None else signatures))
    places = " UNION ALL ".join(
        f"SELECT r, {quote(label)} AS label, {len(phrase.split())} AS n, unnest(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = {quote(x)}' for k, x in enumerate(phrase.split()))})) - 1 AS spot FROM d"
        for phrase, label in base
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS single, ' ' || array_to_string(w, '  ') || ' ' AS pair FROM d),
rule(n, label, keyword, expression, priority) AS (VALUES {table}),
m AS (SELECT r, n, label, priority, regexp_extract_all(pair, expression) AS hits, string_split_regex(pair, expression) AS gaps FROM t JOIN rule ON contains(single, keyword)),
k AS (SELECT r, n, label, priority, unnest(range(1, len(hits) + 1)) AS k, list_transform(gaps, lambda x: len(regexp_extract_all(x, '[^ ]+'))) AS g, list_transform(hits, lambda x: len(regexp_extract_all(x, '[^ ]+'))) AS h FROM m),
s AS (SELECT r, n, label, priority, k, list_sum(g[1:k]) + coalesce(list_sum(h[1:k - 1]), 0) AS a, list_sum(g[1:k]) + list_sum(h[1:k]) AS b FROM k),
kept AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND o.a <= s.a AND o.b >= s.b AND o.priority <= s.priority AND (o.a < s.a OR o.b > s.b OR o.priority < s.priority OR o.n < s.n))),
own AS (SELECT r, list(DISTINCT label) AS labels, sum(b - a) AS words, count(*) AS n FROM kept GROUP BY r),
place AS ({places}),
bas AS (SELECT r, count(*) AS n, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels, sum(n) AS words FROM place GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(bas.n, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(bas.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bas.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  least(1.0, greatest(coalesce(bas.words, 0), coalesce(own.words, 0))::DOUBLE / greatest(len(w), 1))::DOUBLE AS score, coalesce(own.n, 0) AS n_detections
FROM d LEFT JOIN own ON own.r = d.r LEFT JOIN bas ON bas.r = d.r
"""
