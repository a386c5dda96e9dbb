"""One query per corpus operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid.llm import chat, collocations, decontaminate, divergence, licenses, line_runs, search, sharding, simhash, suffix_dedup, token_files, tokens, toxicity
from limpid.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SHARDS = 16


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans",
    )


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode_and_decode(docs).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.assign(docs, [1.0] * SHARDS)
    return sharding.with_slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read(spark, sf_dir, t) for t in ("documents", "benchmark"))
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return decontaminate.judge(docs.select("doc_id", "text"), items.select("item_id", "text")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


ORACLE["op9_decontaminate"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
item AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS a FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[a + 1:a + 10], ' ') AS t FROM starts),
run AS (SELECT r, a, n, array_to_string(w[a + 1:a + n], ' ') AS t
    FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS a FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, a, run.n, item_id FROM run JOIN win USING (n, t)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS p FROM hit) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    return chat.read_back(chat.render(chat.fold(chat.events_of_turns(given.unionByName(more)))))


ORACLE["op10_chat"] = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|start|><|message|><|end|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
        + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    start = F.transform("base_places", lambda d: d["start"])
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        licenses.joined_labels(F.col("base_places")).alias("base_labels"),
        licenses.joined_labels(F.col("detections")).alias("labels"), licenses.score(F.col("detections")).alias("score"),
    )


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), added=True)


@query
def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.where(F.col("doc_id") % 50 == 0))


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op13_line_dedup"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM doc)),
often AS (SELECT key FROM line WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
told AS (SELECT r, i, line, often.key IS NOT NULL AS gone FROM line LEFT JOIN often USING (key)),
done AS (SELECT r, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM told GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM doc JOIN done USING (r)
"""


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE["op11_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS c FROM tok SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
        1 + CAST(CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 2) // (g.n + 2 * v.v) AS BIGINT) AS p,
        1 + CAST(CAST(1000000000 AS HUGEINT) * (k.total + 2) // (v.n + 2 * v.v) AS BIGINT) AS q
    FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(two.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM cell WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM part QUALIFY part = 'pair' OR rank <= 10
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


ORACLE["op12_collocations"] = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
said AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, 1 AS n, unnest(w) AS phrase FROM said
    UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM said WHERE len(w) > 1
    UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM said WHERE len(w) > 2),
words AS (SELECT lang, count(*) AS n FROM gram WHERE n = 1 GROUP BY lang),
f AS (SELECT lang, n, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM gram GROUP BY lang, n, phrase HAVING count(*) >= 10),
cut AS (SELECT lang, n, phrase, a, 1 AS k, w[1] AS lf, array_to_string(w[2:], ' ') AS rt FROM f WHERE n > 1
    UNION ALL SELECT lang, n, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM f WHERE n = 3),
scored AS (SELECT cut.lang, cut.n, cut.phrase, cut.a, k, x.a AS l, y.a AS r,
        CAST(CAST(1000000 AS HUGEINT) * cut.a * cut.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.lf JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rt),
weak AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM f WHERE n = 3),
longer AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY lang, phrase),
kept AS (SELECT weak.* FROM weak LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * weak.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, words.n, score
FROM kept JOIN words ON words.lang = kept.lang QUALIFY rank <= 2000
"""
