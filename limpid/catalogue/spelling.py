"""Spelling variants: folding, collisions, majorities, declared repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from limpid.catalogue import query
from limpid.catalogue import tables as t
from limpid.functions.text import fold
from limpid.operators import checks, collisions, corrections, prepare

_FOLDED = t.sql_fold("word")


@query("fold_words", f"""
WITH {t.SQL_WORDS} SELECT word, {_FOLDED} AS folded, count(*) AS n FROM w GROUP BY 1
""")
def fold_words(spark, d):
    """Folding runs on distinct values only."""
    counts = collisions.value_counts(t.words(spark, d), "word")
    return counts.select(F.col("value").alias("word"), fold(F.col("value")).alias("folded"), "n")


@query("semantic_collisions_words", f"""
WITH {t.SQL_WORDS}, c AS (SELECT word, count(*) AS n FROM w GROUP BY 1)
SELECT {_FOLDED} AS form, count(*) AS spellings, min(word) AS first_spelling, max(word) AS last_spelling,
       CAST(sum(n) AS BIGINT) AS "rows"
FROM c WHERE trim(word) <> '' GROUP BY 1 HAVING count(*) > 1
""")
def semantic_collisions_words(spark, d):
    return checks.no_semantic_collisions(t.words(spark, d), "word")


@query("colliding_spellings_by_language", f"""
WITH {t.SQL_WORDS}, c AS (SELECT lang, word, count(*) AS n, {_FOLDED} AS form FROM w GROUP BY 1, 2)
SELECT lang, form, word AS value, n FROM (
  SELECT *, count(*) OVER (PARTITION BY lang, form) AS k FROM c WHERE trim(word) <> '') WHERE k > 1
""")
def colliding_spellings_by_language(spark, d):
    counts = t.words(spark, d).groupBy("lang", F.col("word").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return collisions.spellings(counts, ["lang"])


@query("collisions_document_text", f"""
WITH c AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT md5({t.sql_fold('text')}) AS form, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS "rows"
FROM c WHERE trim(text) <> '' GROUP BY {t.sql_fold('text')} HAVING count(*) > 1
""")
def collisions_document_text(spark, d):
    """Whole texts that differ only by case, accents or blanks."""
    return collisions.colliding_texts(t.read(spark, d, "documents"), "text")


@query("majority_spelling_words", f"""
WITH {t.SQL_WORDS}, c AS (SELECT word, count(*) AS n, {_FOLDED} AS form FROM w GROUP BY 1),
r AS (SELECT *, first_value(word) OVER (PARTITION BY form ORDER BY n DESC, word) AS canonical FROM c)
SELECT word AS value, canonical FROM r WHERE word <> canonical
""")
def majority_spelling_words(spark, d):
    counts = collisions.value_counts(t.words(spark, d), "word")
    m = collisions.fold_majority(counts)
    return m.where(F.col("value") != F.col("canonical")).select("value", "canonical")


@query("normalised_words", f"""
WITH {t.SQL_WORDS}, c AS (SELECT word, count(*) AS n, {_FOLDED} AS form FROM w GROUP BY 1),
r AS (SELECT word, first_value(word) OVER (PARTITION BY form ORDER BY n DESC, word) AS canonical FROM c)
SELECT lang, canonical AS word, count(*) AS n FROM w JOIN r USING (word) GROUP BY 1, 2
""")
def normalised_words(spark, d):
    """All words rewritten to the most frequent of their spellings."""
    return corrections.normalise(t.words(spark, d), "word").groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n")
    )


_BLANKS = (
    "v AS (SELECT CASE WHEN p_type = 'ECONOMY' THEN replace(p_name, ' ', '') "
    "WHEN p_type = 'SMALL' THEN replace(p_name, ' ', '  ') ELSE p_name END AS name FROM part)"
)


def _names(spark, d):
    """Part names as three careless sources would write them."""
    kind = F.col("p_type")
    squeezed, spread = F.replace("p_name", F.lit(" "), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("  "))
    return t.read(spark, d, "part").select(
        F.when(kind == "ECONOMY", squeezed).when(kind == "SMALL", spread).otherwise(F.col("p_name")).alias("name")
    )


@query("blank_variants_on_majority", f"""
WITH {_BLANKS}, c AS (SELECT name, count(*) AS n FROM v GROUP BY 1),
r AS (SELECT name, first_value(name) OVER (PARTITION BY replace(name, ' ', '') ORDER BY n DESC, name) AS canonical FROM c)
SELECT canonical AS name, count(*) AS n FROM v JOIN r USING (name) GROUP BY 1
""")
def blank_variants_on_majority(spark, d):
    return prepare.fold_blanks_on_majority(_names(spark, d), "name").groupBy("name").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("preparation_report", f"""
WITH {_BLANKS}, f AS (SELECT {t.sql_fold('name')} AS name FROM v),
c AS (SELECT name, count(*) AS n FROM f GROUP BY 1),
r AS (SELECT name, first_value(name) OVER (PARTITION BY replace(name, ' ', '') ORDER BY n DESC, name) AS canonical FROM c)
SELECT 'fold' AS rule_id, (SELECT count(DISTINCT name) FROM v) AS distinct_before,
       (SELECT count(DISTINCT name) FROM f) AS distinct_after
UNION ALL SELECT 'blanks', (SELECT count(DISTINCT name) FROM f), (SELECT count(DISTINCT canonical) FROM r)
""")
def preparation_report(spark, d):
    """Two declared rules on one column, distinct values before and after each."""
    rules = [
        {"id": "fold", "day": 1, "date": "2018-03-01", "table": "products", "column": "name",
         "rule": "strip_accents_lower_collapse_spaces"},
        {"id": "blanks", "day": 1, "date": "2018-03-01", "table": "products", "column": "name",
         "rule": "fold_space_variants_on_majority"},
        {"id": "absent", "day": 1, "date": "2018-03-01", "table": "geolocation", "column": "city",
         "rule": "strip_accents_lower_collapse_spaces"},
    ]
    _, report = prepare.apply_rules({"products": _names(spark, d)}, rules, "2018-03-01", "2018-03-01")
    return report.select("rule_id", "distinct_before", "distinct_after")


@query("declared_repair", """
SELECT CASE p_type WHEN 'SMALL' THEN 'small' WHEN 'ECONOMY' THEN 'éco' ELSE p_type END AS p_type, count(*) AS n
FROM part GROUP BY 1
""")
def declared_repair(spark, d):
    rule = {"mapping": {"SMALL": "small", "ECONOMY": "éco"}}
    return prepare.repair_declared(t.read(spark, d, "part"), "p_type", rule).groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("hidden_duplicates_words", """
SELECT value, stripped, CAST(sum(n) FILTER (own) AS BIGINT) AS n FROM (
  SELECT word AS value, trim(regexp_replace(word, '[^\\x00-\\x7F]', '', 'g'), ' ') AS stripped, true AS own, count(*) AS n
  FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS word FROM documents) WHERE regexp_matches(word, '[^\\x00-\\x7F]') GROUP BY 1
  UNION ALL SELECT NULL, word, false, 1 FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS word FROM documents) WHERE word <> '')
GROUP BY GROUPING SETS ((stripped, value)) QUALIFY value IS NOT NULL AND bool_or(value IS NULL) OVER (PARTITION BY stripped)
""")
def hidden_duplicates_words(spark, d):
    return collisions.hidden_duplicates(collisions.value_counts(t.words(spark, d), "word"))
