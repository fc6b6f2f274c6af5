"""The training-data operators over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorleaf.llm import (
    decontaminate,
    fill_in_middle,
    fingerprints,
    hard_negatives,
    html_text,
    language_id,
    line_dedup,
    near_duplicates,
    quality,
    secrets,
    sentencepiece_viterbi,
    token_files,
    toxicity,
)

PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """The quarter of the documents that models don't learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


# ---- SQL texts ---------------------------------------------------------------

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
          FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS x FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
s AS (SELECT r, doc_id, len(w) AS n, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [text]
      ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS k FROM d),
c AS (SELECT n = 0 AS bare, k, min(doc_id) AS id, count(*) AS copies FROM s GROUP BY ALL),
e AS (SELECT row_number() OVER () AS c, * FROM c),
x AS (SELECT c, len(k) AS size, unnest(k) AS one FROM e WHERE NOT bare),
pairs AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.one = b.one AND a.c <> b.c
          GROUP BY a.c, b.c, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.8),
reach AS (SELECT c AS a, c AS b FROM e UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
named AS (SELECT a AS c, min(id) AS class_id FROM reach JOIN e ON e.c = reach.b GROUP BY a),
links AS (SELECT a AS c, sum(copies) AS n FROM pairs JOIN e ON e.c = pairs.b GROUP BY a)
SELECT s.doc_id, class_id, (coalesce(links.n, 0) + copies - 1)::BIGINT AS n_links
FROM s JOIN e ON s.k = e.k AND (s.n = 0) = e.bare JOIN named USING (c) LEFT JOIN links USING (c)"""

LINE_DEDUP = f"""
WITH l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
           FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM l),
repeated AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(repeated.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (repeated.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN repeated USING (key) GROUP BY r, doc_id"""

HARD_NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
      FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS FIRST, r) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id NULLS FIRST, s.r)::INT AS rank
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5"""

# Kinds of secrets in their order: pattern, and what a match m must be. g is what follows the prefix or key.
_CRC = """(4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, 31), lambda i: ascii(substr(g, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_CHECKSUM = f"""array_to_string(list_transform([916132832, 14776336, 238328, 3844, 62, 1],
    lambda d: substr('{secrets.DIGITS}', ({_CRC} // d % 62 + 1)::BIGINT, 1)), '')"""
_CHECKED = f"CASE WHEN length(g) = 36 THEN substr(g, 31) = {_CHECKSUM} ELSE false END"
_KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 6"),
    "access": ("AKIA([A-Z0-9]+)", "length(m) >= 20"),
    "hex": ("([0-9a-f]{24,})", "true"),
    "github": ("gh[pousr]_([A-Za-z0-9]+)", _CHECKED),
    "npm": ("npm_([A-Za-z0-9]+)", _CHECKED),
}
_FOUND = " UNION ALL ".join(
    f"""SELECT r, '{kind}' AS kind, {k} AS k, a AS start, a + length(m) AS stop FROM (
        SELECT r, unnest(ms) AS m, unnest(gs) AS g, unnest(list_transform(range(1, len(ms) + 1),
            lambda i: coalesce(list_sum(list_transform(gaps[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0)))::BIGINT AS a
        FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', 1) AS gs,
                     regexp_split_to_array(text, '{pattern}') AS gaps FROM d)) WHERE {test}"""
    for k, (kind, (pattern, test)) in enumerate(_KINDS.items())
)
_SPANS = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) {}, '')"
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), found AS ({_FOUND})
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex, sha256({_SPANS.format("FILTER (k < 3)")}) AS base_sha256,
       {_SPANS.format("FILTER (kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             list_transform(range(0, 4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS hs FROM d),
c AS (SELECT *, len(units) AS n, least(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS a,
             greatest(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 50
                  THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM x"""


# ---- queries -----------------------------------------------------------------


@query()
def op1_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints_of_edits(table(spark, sf_dir, "documents"))


@query()
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict_languages(docs, docs.where(~held_out()))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


@query(DECONTAMINATION)
def op3_decontamination(spark, sf_dir):
    found = decontaminate.benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.array_compact("items")))
    n_hit = decontaminate.hit_words("spans")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query(JACCARD_JOIN)
def op4_jaccard_join(spark, sf_dir):
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    null = F.lit(near_duplicates.NULL_ID)
    return found.select(F.nullif("id", null).alias("doc_id"), F.nullif("class_id", null).alias("class_id"), "n_links")


@query()
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.quality_model(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = quality.grade_quality(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "expected_grade", "p_good", "selected")


@query()
def op6_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    both = sentencepiece_viterbi.encode_texts(docs, public_tokenizers.path(PIECES), decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


@query()
def op7_html_text(spark, sf_dir):
    found = html_text.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query(LINE_DEDUP)
def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.drop_repeated_lines(docs)
    return found.select(
        "doc_id", F.col(line_dedup.N_LINES).alias("n_lines"), F.col(line_dedup.N_DROPPED).alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query()
def op9_token_files(spark, sf_dir):
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return token_files.read_token_files(spark, folder, with_ids=False)


@query()
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = toxicity.grade_toxicity(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "expected_severity", "p_toxic", "toxic")


@query(HARD_NEGATIVES)
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query(SECRETS)
def op12_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("secrets", lambda s: s.kind.isin(*secrets.KINDS[: secrets.BASE]))
    return found.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in secrets.KINDS[: secrets.BASE]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


@query(FILL_IN_MIDDLE)
def op13_fill_in_middle(spark, sf_dir):
    found = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )
