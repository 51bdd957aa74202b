import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sealwright.cli import main
from sealwright.config import load_settings, origins
from sealwright.errors import LogHalted, LogParseError, PackError
from sealwright.functions.hashing import CHAIN_FIELDS, contains_imprint, der_length, from_hex, stamp_request
from sealwright.functions.normalize import shadow
from sealwright.functions.validators import iban, luhn, pesel
from sealwright.model import ENTRY
from sealwright.operators import chain, decide, segments
from sealwright.operators.merkle import audit_path, deep_roots, levels, roots, verify_path
from sealwright.plans.packs import compile_pattern, load_pack, load_packs, parse_pack, rules_frame
from sealwright.plans.signing import Signers, keygen, sign, verify
from sealwright.sources.logs import LogWriter, append_log, read_log, read_manifests, read_stamps, submit_stamps, write_manifest
from sealwright.status import status
from sealwright.streaming.sealing import LogState, fold_root


def one(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


@pytest.mark.parametrize(
    "text,want",
    [("Hello 123", "hello 123"), ("PL​61​10", "pl6110"), ("АABCDE12XXX", "aabcde12xxx"), ("PL６１", "pl61"), ("Niższa Żółć", "niższa żółć"), ("café", "café"), ("ﬁx Ρ", "fix p"), (None, None)],
)
def test_shadow(spark, text, want):
    assert one(spark, [text, "a"], shadow(F.col("x")))[0] == want


def test_validators(spark):
    good = {luhn: ["4111111111111111", "5555-5555 55554444", "378282246310005"], pesel: ["44051401359", "02070803628"], iban: ["PL61109010140000071219812874", "de89370400440532013000", "PL61 1090 1014 0000 0712 1981 2874"]}
    bad = {luhn: ["4111111111111112", "0000000000000001", "", None, "42"], pesel: ["12345678901", "00000000000", "44051401358", "44131401359", "1", None], iban: ["PL61109010140000071219812875", "PL00000000000000000000000000", "", "PL6110901014000007121981287é", None]}
    for f, xs in good.items():
        assert one(spark, xs, f(F.col("x"))) == [True] * len(xs)
    for f, xs in bad.items():
        assert one(spark, xs, f(F.col("x"))) == [False] * len(xs)


GOLDEN = [
    ("finance-v1", "Finance Bot", "Card 4111-1111-1111-1111 please", "DENY"),
    ("finance-v1", "Finance Bot", "Reference 4111-1111-1111-1112 please", "ALLOW"),
    ("finance-v1", "Finance Compliance", "Send EUR 100 to PL61109010140000071219812874", "DENY"),
    ("finance-v1", "Support Bot", "Code DEUTDEFF appeared in the docs.", "ALLOW"),
    ("finance-v1", "Finance Compliance", "Code DEUTDEFF for the wire.", "REVIEW"),
    ("finance-v1", "Finance Compliance", "Code АEUTDEFF seen.", "REVIEW"),
    ("medtech-v1", "MedTech Clinic Assistant", "Patient 44051401359 diagnosis kardiologiczna 25 mg.", "DENY"),
    ("medtech-v1", "MedTech Clinic Assistant", "Transaction 12345678901 confirmed.", "ALLOW"),
    ("medtech-v1", "MedTech", "25 µg", "REVIEW"),
    ("hr-bias-v1", "HR Screening Bot", "She is too old for the role.", "DENY"),
    (None, "General Support", "How do I reset my password?", "ALLOW"),
    ("finance-v1", "Finance Bot", "Card 4111​-1111​-1111​-1111", "DENY"),
    ("finance-v1", "Help", "4111111111111112 then 4111111111111111", "ALLOW"),
    ("nope", "x", "y", None),
]


def test_golden_decisions(spark):
    rows = [(i, c, p, "ok", s) for i, (s, c, p, _) in enumerate(GOLDEN)]
    got = decide.evaluate(spark.createDataFrame(rows, "i int, context string, prompt string, response string, policy_set string"), load_packs()).orderBy("i").collect()
    assert [r.decision for r in got] == [g[3] for g in GOLDEN]
    assert got[0].violations[0].asDict() == {"rule": "credit-card", "action": "deny", "confidence": 1.0, "validator": "luhn"}
    assert got[0].input_hash == hashlib.sha256(b"Finance Bot Card 4111-1111-1111-1111 please ok").hexdigest()


def test_packs(spark, tmp_path):
    for bad in ("(?=a)", r"(a)\1", "(?>a)", "(", "(?<!a)b"):
        with pytest.raises(PackError):
            compile_pattern(bad)
    with pytest.raises(PackError):
        parse_pack(b'{"name": "a", "version": "1", "rules": []}', "b")
    with pytest.raises(PackError):
        parse_pack(b'{"name": "a", "version": "1", "rules": [{"id": "r", "pattern": "x", "action": "deny", "score": 1, "validator": "zip"}]}', "a")
    with pytest.raises(PackError):
        load_pack("none", str(tmp_path))
    assert rules_frame(spark, load_packs()).count() == 10


def test_signatures(spark, tmp_path):
    d = str(tmp_path)
    trusted = os.path.join(d, "trusted.json")
    with open(trusted, "w") as f:
        json.dump({"_note": "x"}, f)
    public = keygen(spark, os.path.join(d, "k"), "me", trusted)
    path = os.path.join(d, "p.json")
    with open(path, "w") as f:
        f.write('{"name": "p", "version": "1", "rules": []}')
    signers = Signers.load(trusted)
    with pytest.raises(PackError):
        load_pack("p", d, signers, spark)
    sign(spark, os.path.join(d, "k"), "me", [path])
    assert load_pack("p", d, signers, spark).name == "p"
    assert main(["sign", "--key", os.path.join(d, "k"), "--signer", "you", path], spark) == 0
    with pytest.raises(PackError):
        load_pack("p", d, signers, spark)
    sign(spark, os.path.join(d, "k"), "me", [path])
    with open(path, "a") as f:
        f.write(" ")
    with pytest.raises(PackError):
        load_pack("p", d, signers, spark)
    assert not verify(spark, public, b"x", "00") and not verify(spark, public, b"x", "zz")


def leaf(i):
    return hashlib.sha256(b"\0" + f"entry-{i}".encode()).digest()


def test_trees_of_small_sizes(spark):
    rows = [(n, [leaf(i) for i in range(n)]) for n in range(1, 18)]
    df = spark.createDataFrame(rows, "n int, leaves array<binary>").withColumn("levels", levels(F.col("leaves")))
    df = df.select("n", "leaves", "levels", F.posexplode("leaves").alias("i", "leaf")).withColumn("path", audit_path(F.col("levels"), F.col("i")))
    df = df.withColumn("root", F.lower(F.hex(F.get(F.element_at("levels", -1), 0))))
    v = lambda leaf_, i, path: verify_path(leaf_, i, F.col("n"), path, F.col("root"))
    got = df.select("n", "i", "root", v(F.col("leaf"), F.col("i"), F.col("path")).alias("ok"), v(F.unhex(F.lit("00" * 32)), F.col("i"), F.col("path")).alias("wrong"), v(F.col("leaf"), F.col("i") + 99, F.col("path")).alias("outside"), v(F.col("leaf"), F.col("i"), F.concat("path", F.array(F.lit("00" * 32)))).alias("long"), F.when(F.size("path") > 0, v(F.col("leaf"), F.col("i"), F.slice("path", 1, F.size("path") - 1))).alias("short")).collect()
    assert len(got) == sum(range(1, 18))
    for r in got:
        assert r.root == fold_root([leaf(i) for i in range(r.n)])
        assert r.ok and not r.wrong and not r.outside and not r.long and not r.short


def test_trees_beyond_65536_leaves(spark):
    from sealwright.functions.hashing import leaf_hash

    n = 65_537
    df = spark.range(n).select(F.lit("a").alias("k"), "id", leaf_hash(F.col("id").cast("string").cast("binary")).alias("leaf"))
    want = fold_root([hashlib.sha256(b"\0" + str(i).encode()).digest() for i in range(n)])
    assert roots(df, ["k"], "id").first().merkle_root == deep_roots(df, ["k"], "id").first().merkle_root == want
    entries = df.select(F.col("k").alias("log_id"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("chain_hash"))
    m = segments.manifests(entries, 70_000, "t")
    assert m.first().merkle_root == fold_root([hashlib.sha256(b"\0" + hashlib.sha256(str(i).encode()).digest()).digest() for i in range(n)])
    p = segments.proofs(entries, m).where("entry_seq in (0, 65536)").orderBy("entry_seq").collect()
    assert [(r.verified, len(r.audit_path)) for r in p] == [(True, 17), (True, 1)]


def test_forged_ranges_are_cut(spark):
    c = chain.build_chain(spark.createDataFrame(log_rows(7), FIELDS))
    m = segments.manifests(c, 3, "t").withColumn("last_seq", F.when(F.col("segment_id") == 3, F.lit(2**62)).otherwise(F.col("last_seq")))
    assert sorted((r.seq, r.segment_id) for r in segments.covering(c, m).collect()) == [(i, i // 3 + 1) for i in range(7)]


def test_sealing_goes_on_after_any_stop(spark):
    c = chain.build_chain(spark.createDataFrame(log_rows(11), FIELDS))
    whole = segments.manifests(c, 3, "t")
    for held in (0, 2, 3, 7, 11):
        first = segments.manifests(c.where(F.col("seq") < held), 3, "t", keep_open=True)
        both = first.unionByName(segments.manifests(c, 3, "t", after=first))
        assert sorted(map(repr, both.collect())) == sorted(map(repr, whole.collect()))
    other = segments.manifests(c, 3, "t", schema="x.v2")
    assert {r.status for r in segments.verify_segment_chain(other).collect()} == {"BAD_SCHEMA"} and {r.status for r in segments.verify_segment_chain(other, schema="x.v2").collect()} == {"OK"}


def test_halted_log_takes_no_more(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    w = LogWriter(str(tmp_path / "file" / "log"))
    df = spark.createDataFrame([(1,)], "seq long")
    for error in (Exception, LogHalted):
        with pytest.raises(error):
            w.append(df)
    assert w.halted


def log_rows(n):
    return [("a", i, ["ALLOW", "DENY", "REVIEW"][i % 3], "finance-v1", "h", f"ctx | {i}", "i", "s", f"2024-01-01T00:00:0{i % 10}.123456789Z") for i in range(n)]


FIELDS = "log_id string, seq long, decision string, policy_set string, policy_hash string, context string, input_hash string, shadow_hash string, timestamp string"


def test_files_and_commands(spark, tmp_path, capsys, monkeypatch):
    d = str(tmp_path)
    c = chain.build_chain(spark.createDataFrame(log_rows(7), FIELDS))
    full = c.withColumn("schema", F.lit("audit.v1")).withColumn("audit_id", F.lit("u")).withColumn("violations", F.array().cast(ENTRY["violations"].dataType)).cache()
    append_log(full.where("seq < 4").coalesce(1), f"{d}/log")
    append_log(full.where("seq >= 4").coalesce(1), f"{d}/log")
    back = spark.read.schema(ENTRY).json(f"{d}/log").orderBy("seq")
    lines = [r.value for r in back.select(F.to_json(F.struct("*")).alias("value")).collect()]
    one_file = f"{d}/audit.jsonl"
    with open(one_file, "w") as f:
        f.write("\n\n".join(lines) + "\n")
    log = read_log(spark, one_file)
    assert [(r.line, r.pos, r.seq) for r in log.orderBy("pos").collect()] == [(2 * i + 1, i, i) for i in range(7)]
    for m in segments.manifests(full, 3, "2024-01-01T00:00:00Z").drop("log_id").collect():
        write_manifest(f"{d}/seg", m.asDict())
    assert read_manifests(spark, f"{d}/seg").count() == 3 and read_manifests(spark, f"{d}/none").count() == 0
    assert main(["replay", "--log", one_file, "--segments", f"{d}/seg", "--verify-segments"], spark) == 0
    assert main(["--report", f"{d}/report.json", "verify", "--log", one_file, "--segments", f"{d}/seg"], spark) == 0
    assert json.load(open(f"{d}/report.json"))["status"] == "ok"
    monkeypatch.setenv("SEALWRIGHT_AUDIT_LOG_PATH", one_file)
    monkeypatch.setenv("SEALWRIGHT_SEGMENTS_DIR", f"{d}/seg")
    assert main(["verify"], spark) == 0
    assert main(["verify-chain", "--segments", f"{d}/seg"], spark) == 0
    capsys.readouterr()
    assert main(["proof", "--log", one_file, "--segments", f"{d}/seg", "--seq", "4"], spark) == 0
    proof = json.loads(capsys.readouterr().out)
    assert proof["verified"] and proof["segment_id"] == 2 and proof["tree_size"] == 3 and len(proof["audit_path"]) == 2
    assert main(["proof", "--log", one_file, "--segments", f"{d}/seg", "--seq", "99"], spark) == 1
    assert main(["replay", "--log", one_file, "--verify-lineage", "--no-signature-verify", "--policies-dir", load_pack.__globals__["BUILT_IN"]], spark) == 3
    calls = []

    def authority(request):
        calls.append(request)
        return b"junk" if len(calls) == 2 else b"\x30\x82" + request[21:59]

    assert submit_stamps(read_manifests(spark, f"{d}/seg"), f"{d}/seg", authority) == (2, 1)
    assert read_stamps(spark, f"{d}/seg").count() == 2
    assert main(["verify-tst", "--segments", f"{d}/seg"], spark) == 0
    with open(f"{d}/seg/000002.tsr", "wb") as f:
        f.write(b"other")
    assert main(["verify-tst", "--segments", f"{d}/seg"], spark) == 6 and main(["verify-tst", "--segments", f"{d}/seg", "--segment-id", "9"], spark) == 1
    with open(f"{d}/cut.jsonl", "w") as f:
        f.write("\n".join(lines[:5]) + "\n")
    assert main(["verify", "--log", f"{d}/cut.jsonl", "--segments", f"{d}/seg"], spark) == 5
    prove = lambda log, seq: main(["proof", "--log", f"{d}/{log}.jsonl", "--segments", f"{d}/seg", "--seq", str(seq)], spark)
    assert [prove("cut", s) for s in (2, 4, 6, 7, -1)] == [0, 5, 5, 1, 1]
    with open(f"{d}/tampered.jsonl", "w") as f:
        f.write("\n".join(x.replace(full.where("seq = 4").first().chain_hash, "0" * 64) for x in lines))
    assert [prove("tampered", s) for s in (1, 3, 4)] == [0, 5, 5]
    with open(f"{d}/odd.jsonl", "w") as f:
        f.write("\n".join(x.replace(full.where("seq = 4").first().chain_hash, "zz") for x in lines))
    assert [prove("odd", s) for s in (1, 4)] == [0, 5]
    with open(f"{d}/bad.jsonl", "w") as f:
        f.write("\n".join([lines[0].replace("ALLOW", "DENY"), *lines[1:]]))
    assert main(["replay", "--log", f"{d}/bad.jsonl"], spark) == 2
    os.remove(f"{d}/seg/000002.manifest.json")
    assert main(["verify-chain", "--segments", f"{d}/seg"], spark) == 4
    with open(f"{d}/broken.jsonl", "w") as f:
        f.write(lines[0] + "\n\n" + '{"seq": 1}\n')
    with pytest.raises(LogParseError, match="line 3"):
        read_log(spark, f"{d}/broken.jsonl")
    assert main(["replay", "--log", f"{d}/broken.jsonl"], spark) == 1


def test_chain_statuses(spark):
    c = chain.build_chain(spark.createDataFrame(log_rows(3), FIELDS)).withColumn("pos", F.col("seq")).cache()
    assert chain.first_breaks(chain.verify_chain(c)).count() == 0
    flipped = c.withColumn("decision", F.when(F.col("seq") == 1, "ALLOW").otherwise(F.col("decision")))
    assert [(r.pos, r.status) for r in chain.first_breaks(chain.verify_chain(flipped)).collect()] == [(1, "HASH_BREAK")]
    more = chain.build_chain(spark.createDataFrame([("a", 3, *log_rows(4)[3][2:])], FIELDS), heads=chain.heads(c))
    whole = chain.build_chain(spark.createDataFrame(log_rows(4), FIELDS))
    assert more.first().chain_hash == whole.where("seq = 3").first().chain_hash
    assert chain.verify_chain(c.limit(0)).count() == 0
    assert chain.sequence_gaps(c.withColumn("seq", F.col("seq") * 2)).count() == 2


def test_stream_state_triggers():
    fields = dict(zip(["decision", "policy_set", "policy_hash", "context", "input_hash", "shadow_hash", "timestamp"], "abcdefg"))
    log = LogState("l", None, 3, "", 1000)
    for _ in range(2):
        log.append(fields, 1000)
    again = LogState("l", log.values(), 3, "", 2000)
    again.append(fields, 2000)
    sealed = [r for r in again.rows if r["kind"] == "manifest"]
    assert [(m["first_seq"], m["last_seq"], m["entry_count"]) for m in sealed] == [(0, 2, 3)] and again.leaves == []
    again.append(fields, 3000)
    again.seal(4000)
    again.seal(5000)
    assert again.segment_id == 2 and again.rows[-1]["entry_count"] == 1 and again.rows[-1]["prev_merkle_root"] == sealed[0]["merkle_root"]
    off = LogState("l", None, 0, "", 0)
    for _ in range(5):
        off.append(fields, 0)
    assert off.segment_id == 0


def test_der_and_hex(spark):
    df = spark.createDataFrame([(b"\xab" * 32,)], "d binary")
    r = df.select(stamp_request(F.col("d")).alias("r"), contains_imprint(stamp_request(F.col("d")), F.col("d")).alias("has"), contains_imprint(F.lit(b"\x00" * 60), F.col("d")).alias("no")).first()
    assert r.r[0] == 0x30 and r.r[1] == len(r.r) - 2 == 57 and r.has and not r.no
    assert der_length(0x7F) == b"\x7f" and der_length(0x100) == b"\x82\x01\x00"
    with pytest.raises(Exception, match="not hex"):
        spark.createDataFrame([("zz",)], "x string").select(from_hex(F.col("x"))).collect()


def test_settings():
    s = load_settings({"SEALWRIGHT_SEGMENT_SIZE": "7", "SEALWRIGHT_ENFORCE_SIGNATURES": "no", "SEALWRIGHT_ALLOWED_ORIGINS": " a, ,b "})
    assert s.segment_size == 7 and not s.enforce_signatures and s.allowed_origins == ("a", "b") and s.default_policy_set == "finance-v1"
    assert origins(["x ", ""]) == ("x",) and origins(None) == ()


def test_status(spark, tmp_path, capsys):
    folder = load_pack.__globals__["BUILT_IN"]
    log = LogWriter(str(tmp_path / "log"))
    got = status(folder, None, "g", "s", log)
    assert got["status"] == "ready" and got["policies_loaded"] == 3 and got["policies"]["finance-v1"]["rules"] == 4 and not got["signature_enforcement"]
    log.halted = True
    assert status(folder, None, "g", "s", log)["status"] == "halted"
    with pytest.raises(PackError):
        status(folder, Signers({}), "g", "s", spark=spark)
    assert main(["status", "--policies-dir", folder, "--trusted-signers", str(tmp_path / "none.json")], spark) != 0


def test_numbering_and_chaining_in_one_go(spark):
    rows = spark.range(40).select((F.col("id") % 3).cast("string").alias("log_id"), (F.col("id") * 7 % 40).alias("at"), *(F.concat(F.lit(n), "id").alias(n) for n in [*CHAIN_FIELDS, "timestamp"]), F.array(F.struct("id")).alias("more")).repartition(4)
    one = chain.append_chain(rows, ["at"])
    two = chain.build_chain(chain.allocate(rows, "log_id", ["at"]))
    assert sorted(map(tuple, one.select(*two.columns).collect())) == sorted(map(tuple, two.collect()))
    heads = chain.heads(two.where("seq < 6"), pos="seq")
    rest = chain.append_chain(two.where("seq >= 6").drop("seq", "prev_hash", "chain_hash"), ["at"], heads=heads)
    assert sorted(map(tuple, rest.select("log_id", "seq", "chain_hash").collect())) == sorted(map(tuple, two.where("seq >= 6").select("log_id", "seq", "chain_hash").collect()))
    assert chain.append_chain(rows.limit(0), ["at"]).count() == 0
    with pytest.raises(Exception, match="null field"):
        chain.append_chain(rows.withColumn("context", F.lit(None).cast("string")), ["at"]).collect()
