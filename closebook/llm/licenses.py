"""License scans [native].

The ordered signature rules of ``license_rules`` run over whole texts.  A text
that holds no keyword of any rule is done after one look at its words.  In the others every
keyword occurrence is looked up, and only its own rules are tried on the words
around it; a rule that matches gives a detection: an interval of word positions.
Overlaps are resolved by priority and containment: a detection falls if another
of a higher level, or of the same level and longer (ties: the earlier rule),
contains its interval.  Detections that merely overlap both stand.

All of it is one projection over the documents: no shuffle, no join, and what a
row needs grows with its own text only.

Defined results.  Null text: like an empty one, no words and no detections, empty
label lists, null positions, score 0.  Null ids and repeated rows: each row is
judged by itself.  Empty table: no rows.  Extra columns are ignored, so their
names cannot clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.llm.decontam import words
from closebook.llm.license_rules import AFTER, BEFORE, LEVELS, RULES, Rule

_RULES_TYPE = ("map<string,array<struct<rule:int,label:string,before:string,after:string,"
               "priority:int,score:double,base:boolean>>>")


def _rule_map(rules: list[Rule]) -> Column:
    """keyword -> its rules.  One JSON literal that folds to a constant of the
    plan: hundreds of rules as expressions would cost the planner seconds."""
    by: dict[str, list[dict]] = {}
    for r in rules:
        by.setdefault(r.keyword, []).append({k: v for k, v in r._asdict().items() if k != "keyword"})
    return F.from_json(F.lit(json.dumps(by)), _RULES_TYPE)


def _keywords(rules: list[Rule]) -> Column:
    return F.from_json(F.lit(json.dumps(sorted({r.keyword for r in rules}))), "array<string>")


def _group(context: Column, pattern: Column) -> Column:
    return F.call_function("regexp_extract", context, pattern, F.lit(1))


def _word_count(piece: Column) -> Column:
    """Words of a matched piece: each comes with one blank."""
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))


def detections(w: Column, rules: list[Rule] = RULES) -> Column:
    """All detections in the word array ``w``, sorted by start, the longer and
    the higher ones first."""
    keys, rule_map = _keywords(rules), _rule_map(rules)
    at = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(keys, F.get(w, i))),
        lambda i: F.struct(
            i.alias("at"),
            F.concat(F.lit(" "), F.array_join(F.slice(w, F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE))), " "), F.lit(" ")).alias("head"),
            F.concat(F.lit(" "), F.array_join(F.slice(w, i + 2, F.lit(AFTER)), " "), F.lit(" ")).alias("tail"),
            F.element_at(rule_map, F.get(w, i)).alias("rules")))

    def matches(c: Column) -> Column:
        hit = F.filter(c["rules"], lambda r: F.rlike(c["head"], r["before"]) & F.rlike(c["tail"], r["after"]))

        def detection(r: Column) -> Column:
            start = c["at"] - _word_count(_group(c["head"], r["before"]))
            end = c["at"] + 1 + _word_count(_group(c["tail"], r["after"]))
            return F.struct(start.alias("start"), (-end).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["rule"].alias("rule"),
                            r["label"].alias("label"), r["score"].alias("score"), r["base"].alias("base"))

        return F.transform(hit, detection)

    return F.sort_array(F.flatten(F.transform(at, matches)))


_FOUND = "array<struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string,score:double,base:boolean>>"


def suppressed(found: Column) -> Column:
    """The detections that stand.  ``found`` is sorted, so whatever contains a
    detection comes before it; per level the furthest end of it and the levels
    above says whether one does."""

    def step(acc: Column, d: Column) -> Column:
        level, end = -d["neg_priority"], -d["neg_end"]
        reach = F.transform(acc["reach"], lambda e, i: F.when(i < level, F.greatest(e, end)).otherwise(e))
        stands = F.get(acc["reach"], level - 1) < end
        return F.struct(reach.alias("reach"), F.when(stands, F.concat(acc["kept"], F.array(d))).otherwise(acc["kept"]).alias("kept"))

    zero = F.struct(F.array_repeat(F.lit(-1), LEVELS).alias("reach"), F.array().cast(_FOUND).alias("kept"))
    return F.aggregate(found, zero, step)["kept"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, n_words, found, kept): all detections of every document, and
    those that stand; start is the first word, -neg_end one past the last."""
    d = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    d = d.select("doc_id", F.size("w").cast("long").alias("n_words"),
                 F.when(F.arrays_overlap("w", _keywords(rules)), detections(F.col("w"), rules)).alias("found"))
    none = F.array().cast(_FOUND)
    return d.select("doc_id", "n_words", F.coalesce("found", none).alias("found"),
                    F.when(F.size("found") > 0, suppressed(F.col("found"))).otherwise(none).alias("kept"))


def _labels(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda d: d["label"]))


def report(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per document: words, base places, labels and the confidence of
    the surest detection."""
    base = F.filter("found", lambda d: d["base"])
    d = scan(docs, rules=rules).withColumn("base", base)
    starts = F.transform("base", lambda x: x["start"])
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(_labels(F.col("base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(_labels(F.col("base")), _labels(F.col("kept")))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        F.size("kept").cast("long").alias("n_detections"))


def oracle(rules: list[Rule] = RULES) -> str:
    """``report`` as DuckDB SQL: rules as rows, one join on the keyword, and
    suppression by a plain pair condition."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    values = ",\n".join(f"({r.rule}, {q(r.label)}, {q(r.keyword)}, {q(r.before)}, {q(r.after)}, {r.priority}, {r.score}::DOUBLE, {str(r.base).lower()})"
                        for r in rules)
    keys = ", ".join(q(k) for k in sorted({r.keyword for r in rules}))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH rules(rule, label, keyword, before, after, priority, score, base) AS (VALUES
{values}),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({keys}))) AS i FROM d),
c AS MATERIALIZED (SELECT rid, i - 1 AS k, w[i] AS keyword,
  ' ' || array_to_string(w[greatest(i - {BEFORE}, 1):i - 1], ' ') || ' ' AS head,
  ' ' || array_to_string(w[i + 1:i + {AFTER}], ' ') || ' ' AS tail FROM p),
f AS MATERIALIZED (SELECT rid, rule, label, priority, score, base,
  k - len(regexp_replace(regexp_extract(head, before, 1), '[^ ]', '', 'g')) AS lo,
  k + 1 + len(regexp_replace(regexp_extract(tail, after, 1), '[^ ]', '', 'g')) AS hi
  FROM c JOIN rules USING (keyword) WHERE regexp_matches(head, before) AND regexp_matches(tail, after)),
kept AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.rid = f.rid AND g.lo <= f.lo AND g.hi >= f.hi
  AND (g.priority > f.priority OR g.priority = f.priority AND (g.hi - g.lo > f.hi - f.lo OR g.hi - g.lo = f.hi - f.lo AND g.rule < f.rule)))),
b AS (SELECT rid, count(*) AS n_base, min(lo) AS first_word, max(lo) AS last_word,
  array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM f WHERE base GROUP BY rid),
s AS (SELECT rid, max(score) AS score, count(*) AS n_detections FROM kept GROUP BY rid),
l AS (SELECT rid, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
  FROM (SELECT rid, label FROM kept UNION ALL SELECT rid, label FROM f WHERE base) u GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score,
  CAST(coalesce(n_detections, 0) AS BIGINT) AS n_detections
FROM d LEFT JOIN b USING (rid) LEFT JOIN s USING (rid) LEFT JOIN l USING (rid)"""
