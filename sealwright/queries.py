"""The registered queries over the audit operators, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealwright.functions.hashing import chain_digest, from_hex, sha256_hex, stamp_imprint, stamp_request, to_hex
from sealwright.functions.normalize import shadow
from sealwright.functions.sqlfunctions import register_sql_functions
from sealwright.functions.validators import iban, luhn, pesel
from sealwright.operators import chain, decide, evidence, merkle, segments
from sealwright.operators.manyrules import evaluate_many
from sealwright.model import ENTRY
from sealwright.plans.packs import Pack, Rule, compile_pattern, load_packs
from sealwright.shared import kept, shared_folder
from sealwright.sources.committed import AuditLogs
from sealwright.sources.logs import LogWriter, read_log
from sealwright.sources.requests import audit_requests, read_requests
from sealwright.streaming.counters import Counters, observe_decisions, observe_seals, totals_of
from sealwright.streaming.sealing import SEALED, resume_state, seal_stream, write_arrivals
from sealwright.streaming.stamping import StampSink, answers, stamp_stream, stored_stamps

SIZE = 50  # entries of a segment
SEALED_AT = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, core_bytes: int = 32 << 20) -> DataFrame:
    """Deals a table of less than core_bytes a core over all cores, as its few row groups would keep only some busy; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * core_bytes else df


def b6_shadow_normalize(spark, sf_dir):
    """Texts with hidden and look-alike characters put in, as shadows."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.concat(F.lit("P​L­61 АBC Ρx ё "), F.coalesce("text", F.lit("")))
    return d.select("doc_id", shadow(text).alias("s")).select("doc_id", F.substring("s", 1, 20).alias("head"), sha256_hex(F.col("s")).alias("shadow_hash"))


# Texts and their shadows: compatibility forms, composed letters, hidden and look-alike characters.
NFKC_TEXTS = [("ﬁx Ρ", "fix p"), ("ＰＬ６１", "pl61"), ("cafe\u0301", "café"), ("Å \u212b", "å å"), ("x\u00b2 \u2460", "x2 1"), ("A\u200bB", "ab"), ("\u0410BC", "abc"), ("\u1e9b\u0323", "\u1e69"), ("plain", "plain")]


def b2_nfkc_shadow(spark, sf_dir):
    """Texts that NFKC changes, as shadows."""
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (t, _) in enumerate(NFKC_TEXTS)))
    d = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(rows).alias("x"))
    return d.select("n_nationkey", "x.i", shadow(F.col("x.t")).alias("s"))


# What NFKC makes one of, in each pair the first from the second.
_WRITTEN = [("é", "e\u0301"), ("ü", "u\u0308"), ("ö", "o\u0308"), ("ñ", "n\u0303"), ("ç", "c\u0327"), ("fi", "\ufb01"), ("...", "\u2026"), ("2", "\u00b2"), ("5", "\u2464"), ("7", "\uff17"), ("k", "\uff4b"), ("D", "\U0001d403")]


def b2_nfkc_documents(spark, sf_dir):
    """Whole texts, with marks split off, ligatures and other compatibility forms written in, as shadows: those of the texts as they were."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")))
    odd = F.col("t")
    for plain, written in _WRITTEN:
        odd = F.replace(odd, F.lit(plain), F.lit(written))
    d = d.select("doc_id", odd.alias("odd"), (odd != F.col("t")).alias("changed"))
    return d.select("doc_id", "changed", sha256_hex(shadow(F.col("odd"))).alias("shadow_hash"))


def c4_interaction_hashes(spark, sf_dir):
    """A user's turn with the turn after it."""
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    original = F.concat(F.lit("chat "), F.col("text"), F.lit(" "), F.coalesce("answer", F.lit("")))
    return c.select("conv_id", "turn", sha256_hex(original).alias("input_hash"), sha256_hex(shadow(original)).alias("shadow_hash"))


def finance_rows(spark, sf_dir) -> DataFrame:
    """Documents as interactions; some contexts open the finance gate."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    context = F.when(F.col("lang").isin("en", "de"), "Finance Bot").otherwise("Help Bot")
    rows = d.select("doc_id", context.alias("context"), F.coalesce("text", F.lit("")).alias("prompt"), F.lit("").alias("response"), F.lit(None).cast("string").alias("policy_set"))
    return decide.evaluate(rows, load_packs())


def _decided(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "policy_set", "decision", F.array_join(F.transform("violations", lambda v: v["rule"]), ",").alias("rules"))


def e7_decide_finance(spark, sf_dir):
    return _decided(finance_rows(spark, sf_dir), "doc_id")


def a14_requests(spark, sf_dir):
    """Documents as a stream of JSON requests, some of them broken: how many are decided how, and what is wrong with the others."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")))
    i = F.col("doc_id")
    prompt = F.when(i % 101 == 5, F.rpad("text", 300_000, " ")).otherwise(F.col("text"))
    context = F.when(F.col("lang").isin("en", "de"), "Finance Bot").otherwise("Help Bot")
    policy = F.when(i % 29 == 3, "none").when(i % 2 == 0, "finance-v1")
    body = F.to_json(F.struct(context.alias("context"), policy.alias("policy_set"), F.struct(F.when(i % 17 != 4, prompt).alias("prompt"), F.lit("").alias("response")).alias("payload"), i.alias("id")))
    line = F.when(i % 13 == 2, F.substring(body, 1, 40)).when(i % 19 == 6, F.replace(body, F.lit('{"context":'), F.lit('{"context":5,"was":'))).otherwise(body)
    folder = shared_folder(spark, "requests")
    d.select(line.alias("value")).write.text(f"{folder}/in")
    answered = audit_requests(read_requests(spark, f"{folder}/in", stream=True, max_bytes=1 << 18), load_packs())
    q = answered.select("status", "problem", "policy_set", "decision").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("status", "problem", "policy_set", "decision").agg(F.count("*").alias("n"))


def e5_violations_finance(spark, sf_dir):
    """Violations in rule order, one row each."""
    rows = finance_rows(spark, sf_dir).select("doc_id", F.posexplode_outer("violations").alias("ord", "v")).where("v IS NOT NULL")
    return rows.select("doc_id", F.col("ord").cast("int").alias("ord"), "v.rule", "v.action", F.round(F.col("v.confidence").cast("double"), 3).alias("confidence"), "v.validator")


def e2_first_match(spark, sf_dir):
    """The first card-like number of each document that has one, and whether it passes."""
    p = compile_pattern(r"\b(?:\d[ -]*?){13,19}\b")
    d = table(spark, sf_dir, "documents").withColumn("s", shadow(F.coalesce("text", F.lit("")))).where(F.col("s").rlike(p))
    return d.select("doc_id", F.regexp_extract("s", p, 0).alias("m")).select("doc_id", "m", luhn(F.col("m")).alias("passes"))


def f5_decision_counts(spark, sf_dir):
    return decide.decision_counts(finance_rows(spark, sf_dir))


def f9_rule_hits(spark, sf_dir):
    return decide.rule_hits(finance_rows(spark, sf_dir))


def _pesel_text(key: str):
    """Ten digits made from a key, and the right check digit for even keys."""
    ten = F.expr(f"lpad(cast({key} * 104729 % 10000000000 as string), 10, '0')")
    weighted = sum((F.substring(ten, i + 1, 1).cast("int") * w for i, w in enumerate([1, 3, 7, 9] * 2 + [1, 3])), F.lit(0))
    digit = (10 - weighted % 10) % 10
    return F.concat(ten, F.when(F.col(key) % 2 == 0, digit).otherwise((digit + 3) % 10).cast("string"))


def d2_pesel_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", _pesel_text("o_orderkey").alias("t"))
    return o.select("o_orderkey", "t", pesel(F.col("t")).alias("ok"))


def d3_iban_check(spark, sf_dir):
    body = F.lpad(F.col("c_custkey").cast("string"), 24, "7")
    right = F.lpad((98 - F.concat(body, F.lit("252100")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("pl"), F.when(F.col("c_custkey") % 3 == 0, right).otherwise("11"), body).alias("t"))
    return c.select("c_custkey", "t", iban(F.col("t")).alias("ok"))


def e7_decide_medtech(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("Patient "), _pesel_text("p_partkey"), F.lit(" gets "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " mg").otherwise(" cups"), F.when(F.col("p_partkey") % 5 == 0, "; Diagnosis open").otherwise("; kardiologiczna"))
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 4 < 2, "MedTech desk").otherwise("Desk").alias("context"), text.alias("prompt"), F.lit("ok").alias("response"), F.lit("medtech-v1").alias("policy_set"))
    return _decided(decide.evaluate(rows, load_packs()), "p_partkey")


HR_TEXTS = ["She is too  old for it.", "People over 50 apply", "On maternity leave", "osoba niepełnosprawna", "An invalid form", "All fine here"]


def e7_decide_hr(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    text = F.element_at(F.array(*map(F.lit, HR_TEXTS)), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = c.select("c_custkey", F.lit("HR").alias("context"), text.alias("prompt"), F.lit("ack").alias("response"), F.lit("hr-bias-v1").alias("policy_set"))
    return _decided(decide.evaluate(rows, load_packs()), "c_custkey")


def e11_unknown_packs(spark, sf_dir):
    """Customers whose market segment names a pack (null: the default) or one that isn't loaded."""
    c = table(spark, sf_dir, "customer")
    packs = F.when(F.col("c_mktsegment") == "BUILDING", "medtech-v1").when(F.col("c_mktsegment") == "MACHINERY", F.lit(None)).otherwise(F.col("c_mktsegment"))
    known, rejected = decide.split_known(c.select("c_custkey", packs.alias("policy_set")), load_packs())
    return known.select("c_custkey", F.lit("audit").alias("path")).union(rejected.select("c_custkey", F.lit("reject").alias("path")))


def entry_rows(spark, sf_dir) -> DataFrame:
    """Events as the entries of 16 logs, numbered in order of event_id."""
    return chain.allocate(unnumbered_rows(spark, sf_dir), "log_id", ["event_id"])


def unnumbered_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    props = F.coalesce("props", F.lit(""))
    return e.select(
        F.coalesce(F.col("user_id") % 16, F.lit(0)).cast("string").alias("log_id"),
        "event_id",
        F.when(F.col("event_id") % 7 == 0, "DENY").when(F.col("event_id") % 5 == 0, "REVIEW").otherwise("ALLOW").alias("decision"),
        F.lit("finance-v1").alias("policy_set"),
        F.when(F.col("event_id") % 1000 < 990, sha256_hex(F.lit("pack"))).otherwise(sha256_hex(F.lit("old pack"))).alias("policy_hash"),
        F.coalesce("event_type", F.lit("")).alias("context"),
        sha256_hex(props).alias("input_hash"),
        sha256_hex(F.lower(props)).alias("shadow_hash"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )


def chained(spark, sf_dir) -> DataFrame:
    return chain.append_chain(unnumbered_rows(spark, sf_dir), ["event_id"]).withColumn("pos", F.col("seq"))


def tampered(spark, sf_dir) -> DataFrame:
    """Some decisions flipped, some links zeroed with their hash made anew."""
    c = kept(chained(spark, sf_dir), "chain")
    c = c.withColumn("decision", F.when(F.col("seq") % 97 == 11, "ALLOW!").otherwise(F.col("decision")))
    c = c.withColumn("prev_hash", F.when(F.col("seq") % 101 == 50, F.lit("0" * 64)).otherwise(F.col("prev_hash")))
    return c.withColumn("chain_hash", F.when(F.col("seq") % 101 == 50, chain_digest(F.col("prev_hash"))).otherwise(F.col("chain_hash")))


def f3_chain_build(spark, sf_dir):
    return chained(spark, sf_dir).select("log_id", "seq", "prev_hash", "chain_hash")


def a1_log_round_trip(spark, sf_dir):
    """One log's entries appended as JSON lines, and read back."""
    one = chained(spark, sf_dir).where("log_id = '3'")
    full = one.select(F.lit("audit.v1").alias("schema"), "*", F.concat(F.lit("id-"), F.col("seq").cast("string")).alias("audit_id"), F.array().cast(ENTRY["violations"].dataType).alias("violations"))
    path = shared_folder(spark, "log")
    LogWriter(path).append(full)
    return read_log(spark, path).select("seq", "audit_id", "decision", "context", "timestamp", "chain_hash")


def a7_committed_logs(spark, sf_dir):
    """All logs appended in three commits, each from the heads that the one before left, and read back."""
    logs = AuditLogs(spark, shared_folder(spark, "logs"))
    rows = unnumbered_rows(spark, sf_dir)  # each append numbers its own
    full = rows.select(F.lit("audit.v1").alias("schema"), "*", F.concat(F.lit("id-"), F.col("event_id").cast("string")).alias("audit_id"), F.array().cast(ENTRY["violations"].dataType).alias("violations"))
    thirds = F.ntile(3).over(Window.partitionBy("log_id").orderBy("event_id"))
    parts = kept(full.withColumn("part", thirds), "parts")
    for i in (1, 2, 3):
        logs.append(parts.where(F.col("part") == i).drop("part"), ["event_id"])
    heads = logs.heads().withColumnRenamed("chain_hash", "head")
    return logs.read().join(heads, "log_id").select("log_id", "seq", "audit_id", "decision", "context", "timestamp", "prev_hash", "chain_hash", "next_seq", "head")


def i1_chain_verify(spark, sf_dir):
    return chain.verify_chain(tampered(spark, sf_dir)).select("log_id", "pos", "status")


def h4_first_breaks(spark, sf_dir):
    return chain.first_breaks(chain.verify_chain(tampered(spark, sf_dir))).select("log_id", "pos", "status")


def a2_heads(spark, sf_dir):
    return chain.heads(chained(spark, sf_dir))


def f4_segment_summary(spark, sf_dir):
    return segments.summaries(chained(spark, sf_dir), SIZE).select("log_id", "segment_id", "first_seq", "last_seq", "entry_count", "head_chain_hash_at_close")


def f1_merkle_roots(spark, sf_dir):
    c = chained(spark, sf_dir).select("log_id", F.floor(F.col("seq") / SIZE).cast("long").alias("segment"), "seq", from_hex(F.col("chain_hash")).alias("b"))
    from sealwright.functions.hashing import leaf_hash

    return merkle.roots(c.withColumn("leaf", leaf_hash(F.col("b"))), ["log_id", "segment"], "seq")


def f1_deep_merkle_roots(spark, sf_dir):
    """Whole logs as one tree each, level by level."""
    from sealwright.functions.hashing import entry_leaf

    return merkle.deep_roots(chained(spark, sf_dir).select("log_id", "seq", entry_leaf(F.col("chain_hash")).alias("leaf")), ["log_id"], "seq")


def sealed(spark, sf_dir) -> DataFrame:
    return segments.manifests(chained(spark, sf_dir), SIZE, SEALED_AT)


def c18_segment_chain(spark, sf_dir):
    return sealed(spark, sf_dir).select("log_id", "segment_id", "first_seq", "last_seq", "entry_count", "merkle_root", "prev_merkle_root", "prev_segment_chain_hash", "segment_chain_hash")


def i3_segment_verify(spark, sf_dir):
    m = sealed(spark, sf_dir).where("segment_id % 11 <> 7")
    m = m.withColumn("schema", F.when(F.col("segment_id") % 13 == 3, "other").otherwise(F.col("schema"))).withColumn("sealed_at", F.when(F.col("segment_id") % 9 == 4, "never").otherwise(F.col("sealed_at")))
    return segments.verify_segment_chain(m)


def i4_manifest_vs_log(spark, sf_dir):
    """Manifests with wrong counts and heads against logs that lost their tail and some links."""
    c = kept(chained(spark, sf_dir), "chain")
    m = segments.manifests(c, SIZE, SEALED_AT)
    m = m.withColumn("entry_count", F.when(F.col("segment_id") % 5 == 0, F.col("entry_count") + 1).otherwise(F.col("entry_count")))
    m = m.withColumn("head_chain_hash_at_close", F.when(F.col("segment_id") % 7 == 0, F.lit("f" * 64)).otherwise(F.col("head_chain_hash_at_close")))
    cut = c.where("seq < 180 OR log_id <> '3'").withColumn("chain_hash", F.when(F.col("seq") % 160 == 155, F.lit("0" * 64)).otherwise(F.col("chain_hash")))
    return segments.verify_against_log(m, cut)


def i6_inclusion_proofs(spark, sf_dir):
    c = kept(chained(spark, sf_dir), "chain")
    p = segments.proofs(c, segments.manifests(c, SIZE, SEALED_AT))
    return p.select("log_id", "entry_seq", "segment_id", "leaf_index", "tree_size", "merkle_root", F.array_join("audit_path", ",").alias("audit_path"), "verified")


def i6_deep_proofs(spark, sf_dir):
    """Whole logs as one tree each: the path of every entry, by blocks of 32 nodes."""
    from sealwright.functions.hashing import entry_leaf

    leaves = chained(spark, sf_dir).select("log_id", "seq", entry_leaf(F.col("chain_hash")).alias("leaf"))
    p = merkle.deep_proofs(leaves, ["log_id"], "seq", levels_at_once=5)
    return p.select("log_id", "leaf_index", "tree_size", "merkle_root", F.array_join("audit_path", ",").alias("audit_path"), "verified")


def g5_covering(spark, sf_dir):
    """Entries and the first manifest over them, where some manifests reach into their neighbours' ranges or claim far more than there is."""
    c = kept(chained(spark, sf_dir), "chain")
    m = segments.summaries(c, SIZE).where("segment_id % 6 <> 5")
    first = F.when(F.col("segment_id") % 3 == 0, F.col("first_seq") - 70).otherwise(F.col("first_seq"))
    last = F.when(F.col("segment_id") % 4 == 3, F.lit(1 << 50)).when(F.col("segment_id") % 5 == 2, F.col("last_seq") + 20).otherwise(F.col("last_seq"))
    m = m.select("log_id", "segment_id", first.alias("first_seq"), last.alias("last_seq"))
    return segments.covering(c.select("log_id", "seq", "chain_hash"), m)


def g8_overlapping_ranges(spark, sf_dir):
    """Right manifests, and beside each one that claims a slice seven entries on and one with a count of its own."""
    c = kept(chained(spark, sf_dir), "chain")
    m = kept(segments.manifests(c, SIZE, SEALED_AT), "manifests")
    on = m.withColumns({"segment_id": F.col("segment_id") + 100_000, "first_seq": F.col("first_seq") + 7, "last_seq": F.col("last_seq") + 7})
    more = m.withColumns({"segment_id": F.col("segment_id") + 200_000, "first_seq": F.lit(0).cast("long")}).where("last_seq > 60")
    return segments.verify_against_log(m.unionByName(on).unionByName(more), c)


SYLLABLES = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "at", "en", "es", "tion"]  # a word of three of them has one spelling


def g9_many_rules(spark, sf_dir):
    """A pack of a rule for each word of three syllables (2,197 rules): how many documents each one hits."""
    from itertools import product

    rules = tuple(Rule(w, rf"\b{w}\b", "review", 0.5) for w in map("".join, product(SYLLABLES, repeat=3)))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = d.select("doc_id", F.lit("Desk").alias("context"), F.coalesce("text", F.lit("")).alias("prompt"), F.lit("ok").alias("response"), F.lit("words").alias("policy_set"))
    return decide.rule_hits(evaluate_many(rows, {"words": Pack("words", "1", "0", rules)})).select("rule", "n")


# Patterns of the dialect that no other engine here reads as they stand.
DIALECT = [
    r"[a-z&&[^aeiou]]{4}", r"[[:alpha:]--[a-f]]{3}\d", r"(?-i)\b\p{Lu}{2}", r"(?-u:\b)the(?-u:\b)", r"(?m-i)^[[:upper:]]", r"(?-i)\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+ ", r"[[:^ascii:]]", r"e{2}|t{2,}?h",
    r"(?x) (?: \d{3} ) - # three and four\n \d{4}", r"[a-c~~b-d]n[d-f--e]", r"(?P<end>[^\w\s]+)$", r"a++ n",
]


def e8_dialect(spark, sf_dir):
    """How many documents each of the dialect's patterns matches, all in one pass."""
    d = spread(table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("t")))
    counts = d.agg(*(F.count_if(F.col("t").rlike(compile_pattern(p.replace("\\n", "\n")))).alias(f"c{i}") for i, p in enumerate(DIALECT)))
    return counts.select(F.posexplode(F.array(*(f"c{i}" for i in range(len(DIALECT)))))).select(F.col("pos").alias("pattern"), F.col("col").alias("n"))


PATHS_SQL = """
SELECT p.log_id, p.seq AS entry_seq, p.segment_id, p.leaf_index, p.tree_size, p.merkle_root, array_join(p.audit_path, ',') AS audit_path,
  verify_audit_path(tree_leaf(p.chain_hash), p.leaf_index, p.tree_size, p.audit_path, p.merkle_root) AS verified
FROM audit_path(TABLE(
  SELECT c.log_id, c.seq, c.chain_hash, m.segment_id, m.merkle_root, tree_leaf(c.chain_hash) AS leaf
  FROM {chain} AS c JOIN {manifests} AS m ON c.log_id = m.log_id AND c.seq DIV {size} + 1 = m.segment_id
) PARTITION BY (log_id, segment_id) ORDER BY seq) AS p
"""


def k_audit_path(spark, sf_dir):
    """The same rows as i6_inclusion_proofs by a table function, in one SQL text."""
    register_sql_functions(spark)
    c = kept(chained(spark, sf_dir), "chain")
    return spark.sql(PATHS_SQL, chain=c, manifests=segments.manifests(c, SIZE, SEALED_AT), size=SIZE)


CHECKS_SQL = """
WITH p AS (SELECT o_orderkey, o_custkey, o_orderpriority, lpad(CAST(o_orderkey * 104729 % 10000000000 AS STRING), 10, '0') AS ten FROM parquet.`{dir}/orders.parquet`),
c AS (SELECT *, (10 - aggregate(transform(array(1, 3, 7, 9, 1, 3, 7, 9, 1, 3), (w, i) -> w * CAST(substr(ten, i + 1, 1) AS INT)), 0, (a, x) -> a + x) % 10 + o_orderkey % 3) % 10 AS digit FROM p),
b AS (SELECT c_custkey, lpad(CAST(2100 + c_custkey AS STRING), 12, '0') AS body FROM parquet.`{dir}/customer.parquet`),
a AS (SELECT c_custkey, concat('PL', lpad(CAST(IF(c_custkey % 3 = 0, 98 - CAST(CAST(concat(body, '252100') AS DECIMAL(38, 0)) % 97 AS INT), c_custkey % 100) AS STRING), 2, '0'), ' ', body) AS text FROM b),
l AS (SELECT o_orderkey, tree_leaf(sha2(CAST(o_orderkey AS STRING), 256)) AS x, tree_leaf(sha2(CAST(o_custkey AS STRING), 256)) AS y, tree_leaf(sha2(o_orderpriority, 256)) AS z FROM p),
t AS (SELECT *, lower(hex(tree_node(tree_node(x, y), z))) AS root, lower(hex(x)) AS hx, lower(hex(y)) AS hy, lower(hex(z)) AS hz FROM l)
SELECT 'pesel' AS kind, o_orderkey AS id, concat(ten, CAST(digit AS STRING)) AS text, pesel_ok(concat(ten, CAST(digit AS STRING))) AS ok FROM c
UNION ALL SELECT 'iban', c_custkey, text, iban_ok(text) FROM a
UNION ALL SELECT 'luhn', o_orderkey, concat_ws('-', ten, CAST(o_custkey AS STRING)), luhn_ok(concat_ws('-', ten, CAST(o_custkey AS STRING))) FROM p
UNION ALL SELECT 'path', o_orderkey, root, verify_audit_path(CASE o_orderkey % 3 WHEN 0 THEN x WHEN 1 THEN y ELSE z END, o_orderkey % 3, IF(o_orderkey % 7 = 0, 4, 3),
  CASE o_orderkey % 3 WHEN 0 THEN array(hy, hz) WHEN 1 THEN array(hx, IF(o_orderkey % 5 = 0, hy, hz)) ELSE array(lower(hex(tree_node(x, y)))) END, root) FROM t
"""


def k_sql_checks(spark, sf_dir):
    """Checksums and tree paths in one SQL text over the tables' files."""
    register_sql_functions(spark)
    return spark.sql(CHECKS_SQL.replace("{dir}", sf_dir))


def j7_sealing_resumed(spark, sf_dir):
    """Logs sealed up to a point, then taken up again from log and manifests: the same manifests as in one go."""
    c = kept(chained(spark, sf_dir), "chain")
    first = segments.manifests(c.where("seq < 125"), SIZE, SEALED_AT, keep_open=True)
    both = first.unionByName(segments.manifests(c, SIZE, SEALED_AT, after=first))
    return both.select("log_id", "segment_id", "first_seq", "last_seq", "entry_count", "merkle_root", "prev_merkle_root", "prev_segment_chain_hash", "segment_chain_hash")


def e14_unsealed_tail(spark, sf_dir):
    c = kept(chained(spark, sf_dir), "chain")
    return segments.unsealed(c, segments.manifests(c, SIZE, SEALED_AT, keep_open=True)).select("log_id", "seq")


def f6_seal_counts(spark, sf_dir):
    c = kept(chained(spark, sf_dir), "chain")
    return segments.seal_counts(c, segments.manifests(c, SIZE, SEALED_AT, keep_open=True))


def i2_lineage(spark, sf_dir):
    packs = spark.range(1).select(F.lit("finance-v1").alias("policy_set"), sha256_hex(F.lit("pack")).alias("disk_hash"))
    return evidence.lineage_mismatches(entry_rows(spark, sf_dir), packs)


def _responses(m: DataFrame) -> DataFrame:
    """Stand-ins for an authority's answers: some missing, some for another digest."""
    digest = stamp_imprint(F.col("segment_chain_hash"))
    wrong = F.unhex(F.sha2("segment_chain_hash", 256))
    body = F.concat(F.unhex(F.lit("30820000")), F.unhex(F.lit("0420")), F.when(F.col("segment_id") % 6 == 5, wrong).otherwise(digest), F.unhex(F.lit("00ff")))
    return m.where("segment_id % 4 <> 0").select("log_id", "segment_id", body.alias("content"))


def i9_verify_stamps(spark, sf_dir):
    m = sealed(spark, sf_dir)
    return evidence.verify_stamps(m, _responses(m))


def f8_stamp_summary(spark, sf_dir):
    return evidence.stamp_summary(i9_verify_stamps(spark, sf_dir))


def c21_stamp_requests(spark, sf_dir):
    m = sealed(spark, sf_dir)
    return m.select("log_id", "segment_id", to_hex(stamp_request(stamp_imprint(F.col("segment_chain_hash")))).alias("request"))


def _stream(spark, folder: str, name: str, rows: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """What the streaming sealer makes of rows, through files in order of arrival, a batch for each; each name has a checkpoint of its own."""
    write_arrivals(rows, f"{folder}/{name}-in", [*(c for c in ("flush",) if c in rows.columns), "order_key"])
    out = seal_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}-in"), SIZE, 0, SEALED_AT, initial)
    q = out.writeStream.format("parquet").option("path", f"{folder}/{name}-out").option("checkpointLocation", f"{folder}/{name}-check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(SEALED).parquet(f"{folder}/{name}-out")


def _arrivals(spark, sf_dir) -> DataFrame:
    return entry_rows(spark, sf_dir).withColumnRenamed("event_id", "order_key")


def j5_stream_seal(spark, sf_dir):
    """The same logs through the streaming sealer, read back as manifests."""
    done = _stream(spark, shared_folder(spark, "stream"), "one", unnumbered_rows(spark, sf_dir).withColumnRenamed("event_id", "order_key")).where("kind = 'manifest'")
    return done.select("log_id", "segment_id", "first_seq", "last_seq", "entry_count", "merkle_root", "segment_chain_hash")


def j_state_resume(spark, sf_dir):
    """A sealer that stops inside segments; another one takes its logs up from entries and manifests, and is flushed at the end: all manifests, as if sealed in one go."""
    folder, rows = shared_folder(spark, "resume"), _arrivals(spark, sf_dir)
    rows = rows.withColumn("early", F.col("seq") * 2 < F.count("*").over(Window.partitionBy("log_id")))
    first = _stream(spark, folder, "first", rows.where("early").drop("seq", "early"))
    sealed_before = first.where("kind = 'manifest'")
    state = resume_state(first.where("kind = 'entry'"), sealed_before)
    rest = rows.where("NOT early").drop("seq", "early").withColumn("flush", F.lit(False))
    ends = rows.select("log_id").distinct().withColumn("flush", F.lit(True))
    second = _stream(spark, folder, "second", rest.unionByName(ends, allowMissingColumns=True), state)
    both = sealed_before.unionByName(second.where("kind = 'manifest'"))
    return both.select("log_id", "segment_id", "first_seq", "last_seq", "entry_count", "merkle_root", "prev_merkle_root", "prev_segment_chain_hash", "segment_chain_hash")


def authority(request: bytes) -> bytes:
    """A stand-in for a time-stamp authority: for some digests it isn't there, for some it answers about another one."""
    digest = request[24:56]
    if digest[0] % 4 == 0:
        raise ConnectionError("no answer")
    return b"\x30\x82" + (b"\x04\x20" + (bytes(32) if digest[0] % 4 == 1 else digest)) + b"\x00"


def _stamped(spark, sf_dir, counters=None) -> str:
    """Manifests through the stamping stream in several batches, the first one twice; the folder of the answers."""
    folder, m = shared_folder(spark, "stamps"), kept(sealed(spark, sf_dir), "manifests")
    for part in (m.where("segment_id % 2 = 0"), m.where("segment_id % 3 <> 1")):
        part.repartition(2).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stamp_stream(stream, authority, f"{folder}/out", f"{folder}/check", counters, availableNow=True).awaitTermination()
    StampSink(f"{folder}/out", authority)(m, 0)  # a batch replayed
    return f"{folder}/out"


def j8_stamp_stream(spark, sf_dir):
    """Which segments have a stored stamp, how often it is stored, and whether it verifies."""
    m = sealed(spark, sf_dir)
    folder = _stamped(spark, sf_dir)
    kept_once = answers(spark, folder).groupBy("log_id", "segment_id").agg(F.count_if(F.col("status") == "stored").alias("stored"), F.min("error").alias("error"))
    checked = evidence.verify_stamps(m, stored_stamps(spark, folder))
    return checked.join(kept_once, ["log_id", "segment_id"], "left")


def l6_observed_counters(spark, sf_dir):
    """Counters of one batch of decisions, of one stream of seals and of one of stamps, as their plans observe them."""
    from pyspark.sql import Observation

    seen = Observation()
    observe_decisions(finance_rows(spark, sf_dir), seen).write.format("noop").mode("overwrite").save()
    folder, rows = shared_folder(spark, "counted"), unnumbered_rows(spark, sf_dir).withColumnRenamed("event_id", "order_key")
    batches = write_arrivals(rows, f"{folder}/in", ["order_key"])
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 100 + batches)  # totals_of counts what the session keeps
    out = observe_seals(seal_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), SIZE, 0, SEALED_AT))
    q = out.writeStream.format("noop").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    stamps = Counters()
    _stamped(spark, sf_dir, stamps)
    found = {"decisions": seen.get} | totals_of(q) | stamps.totals()
    return spark.createDataFrame([(name, k, int(v)) for name, own in found.items() for k, v in own.items()], "counter string, metric string, n long")


_ALL = [
    b2_nfkc_shadow, b2_nfkc_documents, b6_shadow_normalize, a1_log_round_trip, j7_sealing_resumed, c4_interaction_hashes, d2_pesel_check, d3_iban_check, e2_first_match, e5_violations_finance, e7_decide_finance, e7_decide_medtech, e7_decide_hr,
    e11_unknown_packs, f5_decision_counts, f9_rule_hits, f3_chain_build, i1_chain_verify, h4_first_breaks, a2_heads, f4_segment_summary, f1_merkle_roots, f1_deep_merkle_roots,
    c18_segment_chain, i3_segment_verify, i4_manifest_vs_log, i6_inclusion_proofs, e14_unsealed_tail, f6_seal_counts, i2_lineage, i9_verify_stamps, f8_stamp_summary, c21_stamp_requests, j5_stream_seal, j_state_resume, k_audit_path, k_sql_checks, i6_deep_proofs, g5_covering, g8_overlapping_ranges, g9_many_rules, e8_dialect, j8_stamp_stream, l6_observed_counters, a7_committed_logs, a14_requests,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
