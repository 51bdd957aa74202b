"""The registered queries of this package, one for each operator, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.llm.archive import convert
from sealwright.llm.cascade import judge_urls
from sealwright.llm.divergence import source_divergence
from sealwright.llm.learn import fold
from sealwright.llm.mixing import mix_rows
from sealwright.llm.mtree import top_products
from sealwright.llm.packing import pack
from sealwright.llm.passages import near_passages
from sealwright.llm.quality import mark_best, score_quality, train_quality
from sealwright.llm.repeats import cut_repeats
from sealwright.llm.scratch import shared_path
from sealwright.llm.setsketch import near_duplicates
from sealwright.llm.simhash import fingerprint_with_edits
from sealwright.llm.threshold import top_documents
from sealwright.llm.toxicity import score_toxicity, train_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The path of the word-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TOXIC_FROM, GOOD_FROM = 0.7, 0.3  # scores from which op1 and op8 predict 1


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """The model of op1 and the pipeline: it learns from the two folds that aren't held out."""
    return train_toxicity(docs, labels, fold("doc_id", 3) != 1)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with expected toxic words and offending spans."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "toxic_words", "spans"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture that sees every document, small sources up to one and a half times."""
    docs = table(spark, sf_dir, "documents")
    return mix_rows(docs, budget=None, max_repeats=1.5)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents less every 50-byte string that a smaller id holds."""
    return cut_repeats(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through ARC and WARC files, as read back."""
    records = convert(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where("vec_id % 100 = 0"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = mark_best(score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"), "above_cut")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents have nearly in common with smaller ids."""
    return near_passages(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their words, pair by pair and term by term."""
    return source_divergence(table(spark, sf_dir, "documents"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under block and allow rules."""
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_mixing, op3_suffix_dedup, op4_warc, op5_mtree, op6_packing, op7_near_dedup, op8_quality, op9_simhash, op10_passages, op11_divergence, op12_url_rules, op13_ranked_search]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op5_mtree": OP5_SQL, "op7_near_dedup": OP7_SQL, "op11_divergence": OP11_SQL, "op12_url_rules": OP12_SQL, "op13_ranked_search": OP13_SQL}


# every string of 50 bytes with the smallest id that holds it
OP3_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, pos, array_slice(b, pos, pos + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS pos FROM d)),
low AS (SELECT s, min(doc_id) AS owner FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT p.doc_id, pos FROM p JOIN low USING (s) WHERE owner < doc_id),
g AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
x AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 50 AS z FROM r GROUP BY doc_id, run),
n AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z FROM x GROUP BY doc_id),
k AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS f, a - 1 AS t FROM x
  UNION ALL SELECT d.doc_id, coalesce(z, 1), octet_length(b) FROM d LEFT JOIN n USING (doc_id)),
c AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN t >= f THEN hex(array_slice(b, f, t)) ELSE '' END, '' ORDER BY f))) AS kept_sha256 FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, kept_sha256
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS i ON i.doc_id = x JOIN n AS j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages WHERE page_id IS NOT NULL),
g AS (SELECT payload_digest, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN newest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN newest > page_id THEN newest END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT s.lang, s.source, term, coalesce(c.n, 0) AS n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (s.n + 2 * v.v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (k.total + 2) // (v.n + 2 * v.v) AS BIGINT) AS q
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
m AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 10
"""

OP12_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM j WHERE k = 1
"""

OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
i AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(w) AS term FROM d) SEMI JOIN i USING (term) GROUP BY r, doc_id, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, n_docs),
m AS (SELECT r, CAST(25 + (75 * len(w) * n_docs) // n_terms AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score FROM i JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
y AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 10
"""
