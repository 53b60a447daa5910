"""One registered query per operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegov.llm import (
    bottom_k, bpe, decontaminate, fingerprint, html_text, lm_score, periodic, perspectives, quality, sharding, simhash, spelling,
    training_order,
)
from tablegov.llm.common import ship_code, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_multiset_fingerprints")
def multiset_fingerprints(spark, sf_dir):
    rows = fingerprint.edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint.fingerprint_of(F.col("lanes")).alias("fingerprint"),
        fingerprint.fingerprint_of(F.col("edited_lanes")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        fingerprint.likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))


@query("op2_training_order")
def training_order_shards(spark, sf_dir):
    placed, _ = training_order.materialise(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN, key=20_240_601)
    return placed.select("seq", "slot", "shard", "byte_offset", "first_doc", "n_tokens", "crc32")


@query("op3_gated_recurrent_lm")
def gated_recurrent_lm(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents"))


@query("op4_perspective_rotation", """
WITH u AS (
    SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said,
        greatest(coalesce(turn, -1) // 256, 0) AS chunk
    FROM conversations),
t AS (
    SELECT *, (row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn, said, who) - 1) // 256 AS part FROM u),
s AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
r AS (
    SELECT t.conv_id, speaker, chunk, part, turn, said, who, who = speaker AS own,
        '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant'
            ELSE 'user name=' || who END || chr(10) AS head, said || '<|im_end|>' || chr(10) AS body
    FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
    SELECT *, sum(length(head) + length(body)) OVER w - length(body) AS pos, row_number() OVER w AS n
    FROM r WINDOW w AS (PARTITION BY conv_id, speaker, chunk, part ORDER BY turn, said, who ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, CAST(chunk AS BIGINT) AS chunk, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
    string_agg(head || body, '' ORDER BY n) AS text,
    coalesce(string_agg(CASE WHEN own THEN pos || '-' || (pos + length(body)) END, ',' ORDER BY n), '') AS spans,
    CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_trained
FROM p GROUP BY conv_id, speaker, chunk, part
""")
def perspective_rotation(spark, sf_dir):
    rows = perspectives.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast(
        "string"))), ",")
    return rows.withColumn("spans", spans)


@query("op5_kneser_ney_quality")
def kneser_ney_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@query("op6_histogram_sort_shards")
def histogram_sort_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash")), "sizes")
    placed = sharding.histogram_shards(rows, 40, "doc_id", "size", "text_hash")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias(
        "shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_simhash_bk_trees")
def simhash_bk_trees(spark, sf_dir):
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_sentencepiece_bpe")
def sentencepiece_bpe(spark, sf_dir):
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)
    return bpe.decode(encoded, vocabulary()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


@query("op9_prefix_filtered_windows", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS t
    FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
    FROM d, sizes WHERE len(w) >= n),
hit AS (
    SELECT p.doc_id, p.i, p.n, x.item
    FROM pos p JOIN win x ON x.n = p.n AND x.t = array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ')),
covered AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def prefix_filtered_windows(spark, sf_dir):
    rows = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query("op10_tag_path_ratios")
def tag_path_ratios(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op11_bottom_k_sketches", r"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS t
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT x, b FROM reach JOIN link ON y = a),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, w.doc_id = c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN least ON x = w.doc_id
""")
def bottom_k_sketches(spark, sf_dir):
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with the repeats that are planted: of the documents whose
    h = crc32(doc_id) ends in 0, each word from a = floor(h/10) % n on is that p words
    before it, p = 1 + floor((n - a) / (3 + floor(h/10) % 8))."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g")).withColumn(
        "w", F.when(F.col("g").isNotNull(), F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)"))
    edited = F.expr("array_join(transform(sequence(0L, n - 1L), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, char(10))), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_spelling_variants", """
WITH RECURSIVE table_of AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
        ORDER BY i) AS t FROM range(256) r(i)),
run AS (
    SELECT doc_id, r, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
    WHERE length(r) >= 6 GROUP BY ALL),
bytes AS (
    SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b
    FROM run),
hashed AS (
    SELECT r, n, xor(4294967295, list_reduce([4294967295] || list_transform(b, lambda x: CAST(x AS BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, table_of),
said AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
v AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
hole AS MATERIALIZED (
    SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM hole a JOIN hole b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM hole a JOIN v b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM hole a JOIN v b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, encode(near))) AS first FROM near GROUP BY word),
rated AS MATERIALIZED (
    SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN top >= 5 * n THEN first END AS form,
        CASE WHEN top >= 5 * n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
follow AS (
    SELECT word, word AS target FROM rated
    UNION SELECT follow.word, form FROM follow JOIN rated ON rated.word = target WHERE form IS NOT NULL)
SELECT rated.word, rated.form, target AS root, rated.n, rated.n_near, rated.form_n
FROM rated JOIN follow ON follow.word = rated.word JOIN rated last ON last.word = target AND last.form IS NULL
""")
def spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"), drop_every=199)
