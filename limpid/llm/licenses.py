"""License scan of whole texts by ordered signature rules. Only functions of Spark SQL, no shuffle.

A text is turned into lower-case words between single blanks. Keywords are looked
for first; only the rules whose keyword is there are tried (hundreds of regular
expressions, few per text). Detections are intervals of words. In the order of
their start, a detection that lies inside one of a smaller tier is suppressed;
base phrases always stay. Suppression is a fold that keeps the farthest end per
tier, so its work follows the number of detections.

Defined cases: null and empty texts have no words, no detection and score 0;
texts of any length are scanned whole, rows stay apart whatever their id, an empty
table gives an empty result, and columns called like an output are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.common import fresh_name, lower_ascii
from limpid.llm.license_rules import TIER_SCORE, Rule, build_rules

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RULE = "array<struct<rule:string,label:string,tier:int,keyword:string,regex:string,base:boolean>>"
_FOUND = "array<struct<start:bigint,end:bigint,tier:int,label:string,rule:string,base:boolean>>"


def as_words(text: Column) -> Column:
    """Words between single blanks, one in front and one behind; a lone blank if there is none."""
    inner = F.trim(F.regexp_replace(lower_ascii(text), NOT_WORD, " "))
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _blanks(x: Column) -> Column:
    return (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))).cast("bigint")


def _places(words: Column, rule: Column) -> Column:
    """Where a rule matches: word intervals, end exclusive, from what lies between the matches."""
    between, found = F.split(words, rule["regex"], -1), F.regexp_extract_all(words, rule["regex"], F.lit(0))
    step = F.zip_with(
        F.transform(between, _blanks), F.transform(found, _blanks),
        lambda gap, inside: F.struct(F.coalesce(gap, F.lit(0)).alias("gap"), inside.alias("inside")),
    )
    nothing = F.from_json(F.lit('{"at":0,"out":[]}'), f"at bigint, out {_FOUND}")

    def more(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(
            (start - 1).alias("start"), (start + x["inside"]).alias("end"), rule["tier"].alias("tier"),
            rule["label"].alias("label"), rule["rule"].alias("rule"), rule["base"].alias("base"),
        )
        return F.struct(
            (start + F.coalesce(x["inside"], F.lit(0))).alias("at"),
            F.when(x["inside"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"),
        )

    return F.aggregate(step, nothing, more, lambda acc: acc["out"])


def _surviving(found: Column, tiers: int) -> Column:
    """Detections in order of start (longer first, smaller tier first) that no interval of a smaller tier holds."""
    order = F.array_sort(F.transform(found, lambda d: F.struct(
        d["start"].alias("start"), (-d["end"]).alias("back"), d["tier"].alias("tier"), d["label"].alias("label"),
        d["rule"].alias("rule"), d["base"].alias("base"),
    )))
    zero = F.from_json(F.lit(json.dumps({"far": [-1] * tiers, "kept": []})), f"far array<bigint>, kept {_FOUND}")

    def step(acc: Column, d: Column) -> Column:
        end = -d["back"]
        inside = F.exists(F.slice(acc["far"], F.lit(1), d["tier"]), lambda far: far >= end)
        one = F.array(F.struct(d["start"], end.alias("end"), d["tier"], d["label"], d["rule"], d["base"]))
        return F.struct(
            F.transform(acc["far"], lambda far, k: F.when(k == d["tier"], F.greatest(far, end)).otherwise(far)).alias("far"),
            F.when(inside & ~d["base"], acc["kept"]).otherwise(F.concat(acc["kept"], one)).alias("kept"),
        )

    return F.aggregate(order, zero, step, lambda acc: acc["kept"])


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Append ``n_words``, ``detections`` (those that survive) and ``base_places`` (all places of base phrases)."""
    rules = build_rules() if rules is None else rules
    table = F.from_json(F.lit(json.dumps([vars(r) for r in rules])), _RULE)
    tiers = max((r.tier for r in rules), default=0) + 1
    keywords = sorted({r.keyword for r in rules})
    outputs = ("n_words", "detections", "base_places")
    kept = [c for c in docs.columns if c.lower() not in outputs]
    words, hits, found = (fresh_name(n, kept) for n in ("_words", "_hits", "_found"))
    none = F.from_json(F.lit("[]"), _FOUND)
    seen = docs.select(*(f"`{c}`" for c in kept), as_words(F.col(text)).alias(words)).withColumn(
        hits, F.filter(F.array(*(F.when(F.contains(words, F.lit(k)), F.lit(k)) for k in keywords)), lambda k: k.isNotNull())
    )
    tried = F.filter(table, lambda r: F.array_contains(F.col(hits), r["keyword"]))
    every = F.when(F.size(hits) == 0, none).otherwise(F.flatten(F.transform(tried, lambda r: _places(F.col(words), r))))
    marked = seen.withColumn(found, every)
    return marked.select(
        *(f"`{c}`" for c in kept), F.greatest(_blanks(F.col(words)) - 1, F.lit(0)).alias("n_words"),
        F.when(F.size(found) == 0, none).otherwise(_surviving(F.col(found), tiers)).alias("detections"),
        F.filter(found, lambda d: d["base"]).alias("base_places"),
    )


def joined_labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def score(found: Column) -> Column:
    """The weight of the strongest tier that was found; 0 if none."""
    weight = F.array(*(F.lit(TIER_SCORE[t]) for t in sorted(TIER_SCORE)))
    return F.coalesce(F.array_max(F.transform(found, lambda d: F.element_at(weight, d["tier"] + 1))), F.lit(0.0))
