"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetime.llm import licences
from versetime.llm.audio import PAD_TO, audio_features, padded, tensor_digest, wav, wav_payload
from versetime.llm.centroids import clustered
from versetime.llm.chat import answer_pairs, preference_examples
from versetime.llm.common import new_shared_path, read_table, staged
from versetime.llm.decontaminate import contamination
from versetime.llm.language import identify, train
from versetime.llm.lines import deduplicated_lines
from versetime.llm.mixing import MixtureWeights, mix
from versetime.llm.ppm import ppm_scores
from versetime.llm.ranking import ranked
from versetime.llm.simhash import near_duplicates
from versetime.llm.tokens import read_tokens, token_count, with_global_start, write_tokens
from versetime.llm.warc import read_warc, resolved, write_warc

#: The tokenizer's vocabulary is 50,257 ids; the id that ends a document is 2.
VOCABULARY, END_ID = 50_257, 2


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back and return what they say of each page."""
    spark = pages.sparkSession
    path = new_shared_path(spark, "warc")
    write_warc(pages, path)
    measured = read_warc(spark, path).select(
        "page_id", "kind", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    return resolved(staged(measured, "warc-index")).select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(read_table(spark, sf_dir, "pages"))


#: Target weights of the mixture, in hundredths; sources of a language are alike.
WEIGHTS = MixtureWeights(domain={"crawl": 50, "curated": 30, "forum": 20}, language={"en": 60, "de": 15, "fr": 15, "es": 10})
DOMAIN = "CASE WHEN source = 'src0' THEN 'crawl' WHEN right(source, 1) IN ('1', '3', '5', '7', '9') THEN 'forum' ELSE 'curated' END"


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"), F.expr(DOMAIN), WEIGHTS, keep=["doc_id"])
    return mixed.select("doc_id", "domain", "language", "origin", "n_tokens", "epoch")


def packed_tokens(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as token files, read them back and return what they say of each document."""
    import public_tokenizers

    spark = docs.sparkSession
    path = new_shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID, vocabulary=VOCABULARY)
    read = read_tokens(spark, path)
    rows = staged(read.select("file", "doc_id", "file_start", token_count(F.col("ids")).alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "token-index")
    return with_global_start(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(read_table(spark, sf_dir, "documents"))


#: Languages that are told apart, those of the labelled documents.
LANGUAGES = ["en", "de", "fr", "es"]
#: What is not text in a page: scripts, styles, comments, tags and entities.
_MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;"


def page_languages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The language of each page, by a model trained on labelled documents."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    found = identify(
        pages, train(documents, LANGUAGES), keep=["page_id"], text=F.regexp_replace("html", _MARKUP, " "), host=F.nullif(host, F.lit("")),
        declared=F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1),
    )
    return found.select("page_id", "language", F.round("posterior", 6).alias("posterior"), "accepted", "declared", "suffix_language")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def stored_audio(docs: DataFrame, rate: int = 16_000) -> DataFrame:
    """Store each text's bytes as 8-bit audio, read them back, and store their features; what comes out is read from both.

    Null texts are empty; rows with a null id and repeated rows are each returned; an empty table gives no rows;
    other columns are not read.
    """
    text = F.encode("text", "UTF-8")
    stored = staged(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), wav(padded(text), rate).alias("media")), "audio")
    payload = wav_payload(F.col("media"))
    measured = stored.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring("media", -PAD_TO, PAD_TO)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media",
    )
    active = F.expr("aggregate(segments, 0L, (n, x) -> n + x.end_ms - x.start_ms)")
    found = staged(audio_features(measured), "audio-features")
    feature = F.concat_ws(":", "n_frames", F.size("segments"), active, tensor_digest(F.col("tensors")))
    return found.select(*(c for c in measured.columns if c != "media"), feature.alias("feature"))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_audio(read_table(spark, sf_dir, "documents"))


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = preference_examples(answer_pairs(read_table(spark, sf_dir, "conversations")))
    return examples.withColumns({c: F.array_join(c, ",") for c in ("chosen_mask", "rejected_mask")})


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    found = licences.licence_paragraphs(documents, licences.train(documents))
    return found.withColumns({c: F.round(c, 6) for c in ("probability", "template_share")})


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(read_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read_table(spark, sf_dir, "embeddings"))[0]


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated_lines(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_near_dedup, op2_decontamination, op3_warc, op4_source_mixing, op5_token_binary, op6_language_id, op7_audio_features, op8_preference_format,
        op9_licence_scan, op10_lm_scoring, op11_centroid_clustering, op12_line_dedup, op13_lexical_search,
    )
    return {f.__name__: f for f in found}


#: DuckDB's SQL for the same rows.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""

OP8_SQL = """
WITH t AS (SELECT conv_id, list({'r': replace(coalesce(role, ''), '<|', '< |'), 't': replace(coalesce(text, ''), '<|', '< |')}
    ORDER BY turn NULLS FIRST, replace(coalesce(role, ''), '<|', '< |'), replace(coalesce(text, ''), '<|', '< |')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].r = 'assistant')) AS last FROM t),
p AS (SELECT a.conv_id AS pair_id, a.turns[1:coalesce(a.last, len(a.turns))] AS c, CASE WHEN a.last IS NOT NULL AND b.last IS NOT NULL THEN a.turns[1:a.last - 1] || [b.turns[b.last]] END AS r
  FROM l a LEFT JOIN l b ON b.conv_id = a.conv_id + 1),
k AS (SELECT *, CASE WHEN r IS NULL THEN 0 ELSE coalesce(list_filter(range(0, greatest(len(c), len(r))), lambda i: c[i + 1] IS DISTINCT FROM r[i + 1])[1], len(c)) END AS n FROM p),
s AS (SELECT pair_id, n, c[1:n] AS q, c[n + 1:] AS c, r[n + 1:] AS r FROM k),
o AS (SELECT pair_id, CAST(n AS INTEGER) AS n_common,
  array_to_string(list_transform(q, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(c, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS chosen,
  CASE WHEN r IS NOT NULL THEN coalesce(array_to_string(list_transform(r, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), ''), '') END AS rejected,
  flatten(list_transform(c, lambda x: CASE WHEN x.r = 'assistant' THEN [-22, length(x.t) + 10, -1] ELSE [-(length(x.r) + length(x.t) + 24)] END)) AS cm,
  flatten(list_transform(r, lambda x: CASE WHEN x.r = 'assistant' THEN [-22, length(x.t) + 10, -1] ELSE [-(length(x.r) + length(x.t) + 24)] END)) AS rm FROM s)
SELECT pair_id, n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(array_to_string(cm, ','), '') AS chosen_mask,
  rejected, CASE WHEN rejected IS NOT NULL THEN coalesce(array_to_string(rm, ','), '') END AS rejected_mask,
  coalesce(chosen <> rejected AND list_max(cm) > 0 AND list_max(rm) > 0, false) AS usable
FROM o
"""


def _mixing_sql(percent: int = 80, epochs: int = 2, seed: int = 7) -> str:
    """The mixture in SQL: one block for each level of the tree, then each leaf's prefix by a running sum."""
    weight = {
        level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in getattr(WEIGHTS, level).items()) + f" ELSE {WEIGHTS.default} END"
        for level in ("domain", "language")
    } | {"origin": str(WEIGHTS.default)}
    parts, given = [], "(SELECT CAST(sum(tokens)::HUGEINT * %d // 100 AS BIGINT) AS given FROM leaves)" % percent
    for above, level in (([], "domain"), (["domain"], "language"), (["domain", "language"], "origin")):
        own, by = ", ".join([*above, level]), f"PARTITION BY {', '.join(above)}" if above else ""
        on = f"JOIN {given} g USING ({', '.join(above)})" if above else f"CROSS JOIN {given} g"
        parts.append(f"""
{level}_a AS (SELECT n.*, g.given AS budget, {weight[level]} AS w
  FROM (SELECT {own}, sum(tokens)::HUGEINT AS tokens, sum(docs) AS docs, {epochs} * sum(tokens)::HUGEINT AS cap FROM leaves GROUP BY {own}) n {on}),
{level}_b AS (SELECT *, cap * (sum(w) OVER ({by}) - coalesce(sum(w) OVER o, 0)) <= w * (budget - coalesce(sum(cap) OVER o, 0)) AS full_up
  FROM {level}_a WINDOW o AS ({by} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{level}_given AS (SELECT {own}, tokens, docs, CAST(CASE WHEN full_up THEN cap ELSE
  (budget - coalesce(sum(CASE WHEN full_up THEN cap END) OVER ({by}), 0)) * w // (sum(CASE WHEN full_up THEN 0 ELSE w END) OVER ({by})) END AS BIGINT) AS given FROM {level}_b)""")
        given = f"{level}_given"
    return f"""
WITH d AS (SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, 'und') AS language, coalesce(source, 'unknown') AS origin,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens) AS tokens, count(*) AS docs FROM d GROUP BY ALL),{",".join(parts)},
r AS (SELECT d.*, g.given // greatest(g.tokens, 1) AS full_epochs, g.given % greatest(g.tokens, 1) AS rest,
    md5('{seed}:' || CAST(g.given // greatest(g.tokens, 1) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS seeded
  FROM d JOIN origin_given g USING (domain, language, origin)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY seeded, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS until FROM r)
SELECT doc_id, domain, language, origin, n_tokens, CAST(epoch AS BIGINT) AS epoch
FROM (SELECT *, unnest(range(0, CAST(full_epochs + CASE WHEN until <= rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM s)
"""


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
f AS (SELECT l.*, m.k IS NOT NULL AS gone FROM l LEFT JOIN (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10) m USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
n AS (SELECT r, doc_id, len(terms) AS n, count(*) OVER () AS docs, sum(len(terms)) OVER () AS total FROM d WHERE len(terms) > 0),
t AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM t GROUP BY t),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
s AS (SELECT q, item_id, n.r, doc_id, sum(CAST(floor(1000 * ln((2 * n.docs + 2) / (2 * f.df + 1))) AS BIGINT) *
    ((1000000000 * t.tf) // (1000 * t.tf + 8 * CAST(100 - 90 + (90 * n.n * n.docs) // n.total AS BIGINT)))) AS score
  FROM (SELECT q, item_id, unnest(terms) AS t FROM i) JOIN t USING (t) JOIN f USING (t) JOIN n USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def _clustering_sql(k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """Lloyd's rounds with all distances, one block each."""
    parts = [f"""
e AS (SELECT row_number() OVER () AS r, vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM e WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS (SELECT e.r, min({{'d': list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c.c}}) AS best FROM e CROSS JOIN c{i} c GROUP BY e.r)""")
        if i < rounds:
            parts.append(f"""
s{i} AS (SELECT a.best.c AS c, p.i, sum(e.v[p.i])::BIGINT AS s, count(*) AS n FROM a{i} a JOIN e USING (r) CROSS JOIN range(1, 65) p(i) GROUP BY ALL),
c{i + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c) m USING (c))""")
    return f"""
WITH {",".join(parts)}
SELECT e.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM e JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.best.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_source_mixing": _mixing_sql(), "op8_preference_format": OP8_SQL, "op11_centroid_clustering": _clustering_sql(), "op12_line_dedup": OP12_SQL, "op13_lexical_search": OP13_SQL}
