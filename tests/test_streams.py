"""Keyed claims against a plain store, the ledger across micro-batches, bursts, replies, payloads and duplicates by type."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tallymark.operators import audit, duplicates, envelope
from tallymark.plans import catalog, streams
from tallymark.session import shared_dir
from tallymark.sources import fixtures as X
from tallymark.sources import images
from tallymark.streaming import claims

DAY = 86_400
KINDS = "key string, owner string, action string, at long"


def store(batches, ttl):
    """The same claims held in a dict, batch by batch."""
    held, out = {}, []
    for rows in batches:
        for key, owner, action, at in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
            if key in held and at - held[key][1] >= ttl:
                del held[key]
            if action == "release":
                done = key in held and held[key][0] == owner
                if done:
                    del held[key]
                outcome = "released" if done else "ignored"
            elif key not in held:
                held[key], outcome = (owner, at), "new"
            else:
                outcome = "resumed" if held[key][0] == owner else "duplicate"
            out.append((key, owner, action, at, outcome, held.get(key, (None,))[0]))
    return sorted(out, key=repr)


def test_claims_over_micro_batches_equal_a_plain_store(spark):
    rng = random.Random(7)
    batches = [[(f"k{rng.randrange(6)}", f"o{rng.randrange(3)}", rng.choice(["claim", "claim", "claim", "release"]), DAY * (40 * i + 9) + rng.randrange(40 * DAY)) for _ in range(40)] for i in range(4)]
    batches[0] += [("edge", "a", "claim", DAY), ("edge", "b", "claim", DAY + 1)]
    batches[2] += [("edge", "c", "claim", 91 * DAY - 1)]
    batches[3] += [("edge", "d", "claim", 91 * DAY), ("edge", "e", "claim", 91 * DAY + 1)]
    base = f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, KINDS).withColumn("ts", F.timestamp_seconds("at")).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(KINDS + ", ts timestamp").parquet(f"{base}/in")
        query = claims.claims(stream, "100 days").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination(300)
        query.stop()
    got = sorted((tuple(r) for r in spark.read.schema(claims._OUT).parquet(f"{base}/out").collect()), key=repr)
    assert got == store(batches, 90 * DAY)
    assert [r[4] for r in got if r[0] == "edge"] == ["new", "duplicate", "duplicate", "new", "duplicate"]


@pytest.fixture(scope="module")
def ledger(spark, sf):
    return streams._verified(spark, sf)


def test_repeats_across_micro_batches_are_found_and_nobody_shares_a_charge(spark, sf, ledger):
    rows = ledger.read("verdicts", streams._SEEN).collect()
    assert {r.batch_id for r in rows} == {0, 1} and len(rows) == X.receipts(spark, sf).count()
    second = [r for r in rows if r.batch_id == 1 and r.verdict == "DUPLICATE"]
    assert any(r.original_id and r.original_id.startswith("r_") for r in second)
    valid = [r.charge_id for r in rows if r.verdict == "VALID"]
    assert len(valid) == len(set(valid)) and not set(valid) & {r.charge_id for r in X.claims(spark, sf).collect()}
    assert sorted(valid) == sorted(r.charge_id for r in ledger.read("claims", streams._CLAIM).collect())
    told = ledger.read("audit", audit.SCHEMA).collect()
    assert len(told) == len(rows) and {r.level for r in told} == {"INFO", "ERROR"}
    assert all(json.loads(r.line)["status"] == r.status for r in told)


def test_a_batch_that_runs_twice_changes_nothing(spark, sf, ledger):
    tables = {"verdicts": streams._SEEN, "claims": streams._CLAIM, "images": streams._IMAGE}
    before = {t: sorted(map(repr, ledger.read(t, s).collect())) for t, s in tables.items()}
    batch = X.receipts(spark, sf).filter(F.col("receipt_id").startswith("d_"))
    streams.verify_batch(ledger, batch, 1, X.charges(spark, sf), X.customers(spark, sf), X.claims(spark, sf), X.AS_OF)
    assert {t: sorted(map(repr, ledger.read(t, s).collect())) for t, s in tables.items()} == before


def test_streamed_bursts_are_assigned_as_in_batch(spark, sf):
    streamed = {r.receipt_id: (r.charge_id, r.forced) for r in catalog.QUERIES["stream_burst_batch"](spark, sf).collect()}
    batch = {r.receipt_id: r.charge_id for r in catalog.QUERIES["batch_assign"](spark, sf).collect()}
    assert all(batch[i] == charge for i, (charge, forced) in streamed.items() if not forced and i in batch)
    assert any(not forced for _, forced in streamed.values()) and any(forced for _, forced in streamed.values())
    assert all(charge is None for charge, forced in streamed.values() if forced)


def test_replies_of_all_shapes(spark):
    ok, ocr = {"status": "MATCHED", "verdict": "VALID"}, {"fields": None, "provider": "p"}
    deep = lambda n, x: deep(n - 1, {"json": x}) if n else x
    cases = [
        (json.dumps(ok), ("DECISION", "VALID", None)),
        (json.dumps([ok]), ("DECISION", "VALID", None)),
        (json.dumps([ok, ok]), (None, None, "N8N_INVALID_RESPONSE")),
        (json.dumps({"body": json.dumps(ok)}), ("DECISION", "VALID", None)),
        (json.dumps(json.dumps([ok])), ("DECISION", "VALID", None)),
        (json.dumps({"data": {"x": 1}, "verification_result": ok}), ("DECISION", "VALID", None)),
        (json.dumps(ocr | {"verification": {"data": ok}}), ("DECISION", "VALID", None)),
        (json.dumps(ocr | {"verification": {"data": 3}}), ("EXTRACTION", None, None)),
        (json.dumps({"fields": 3, "provider": "p"}), (None, None, "N8N_INVALID_RESPONSE")),
        (json.dumps({"ocr_result": {"fields": {}, "confidence": 0.5}}), ("EXTRACTION", None, None)),
        (json.dumps({"json": ocr, "body": ok}), ("EXTRACTION", None, None)),
        (json.dumps({"status": "ERROR", "reason_code": "X"}), ("DECISION", None, None)),
        (json.dumps({"status": 3, "verdict": "VALID"}), (None, None, "N8N_INVALID_RESPONSE")),
        (json.dumps(deep(5, ok)), ("DECISION", "VALID", None)),
        (json.dumps(deep(6, ok)), (None, None, "N8N_INVALID_RESPONSE")),
        ("not json", (None, None, "N8N_INVALID_RESPONSE")),
        ("null", (None, None, "N8N_INVALID_RESPONSE")),
        ("  ", (None, None, "N8N_EMPTY_RESPONSE")),
        (None, (None, None, "N8N_EMPTY_RESPONSE")),
    ]
    d = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i long, b string")
    got = {r.key: (r.kind, r.verdict, r.error_code) for r in envelope.unwrap(d, "i", "b").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_image_files_and_payloads(spark, tmp_path):
    import base64
    import hashlib

    data = {f"{i}.png": bytes(random.Random(i).randrange(256) for _ in range(50 * i)) for i in range(1, 4)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "note.txt").write_text("no image")
    got = {r.path.rsplit("/", 1)[-1]: r.h for r in images.image_files(spark, str(tmp_path), "*.png").select("path", F.sha2("content", 256).alias("h")).collect()}
    assert got == {n: hashlib.sha256(c).hexdigest() for n, c in data.items()}
    rows = [(n, base64.b64encode(c).decode()) for n, c in data.items()] + [("junk", "@@@"), ("cut", "QUJ"), ("none", None)]
    found = {r.k: r.content for r in images.image_payloads(spark.createDataFrame(rows, "k string, b string"), "k", "b").collect()}
    assert {n: bytes(found[n]) for n in data} == data and found["junk"] is None and found["none"] is None


IMAGE = "receipt_id string, received_at long, group_id string, phash string, full_print string, legacy_print string, visual_print string, tx string, name string, amount long, mail string, charge_id string, verdict string"


@pytest.mark.parametrize(
    ("first", "second", "want"),
    [
        ({"charge_id": "c"}, {"charge_id": "c", "phash": "1" + "0" * 15}, "PHASH"),
        ({"charge_id": "c"}, {"charge_id": "d"}, "CONFLICT"),
        ({"charge_id": "c", "tx": "t"}, {"tx": "t"}, "PHASH_TRANSACTION_ID"),
        ({"tx": "t"}, {"tx": "t"}, "TRANSACTION_EVIDENCE"),
        ({"tx": "t"}, {"tx": "t", "charge_id": "c"}, None),
        ({"charge_id": "c", "name": "n"}, {"name": "n", "phash": "7" + "0" * 15}, "PHASH_RECEIPT_EVIDENCE"),
        ({}, {}, "PHASH_VISUAL_RECEIPT"),
        ({}, {"phash": "1" + "0" * 15}, None),
        ({"charge_id": "c", "verdict": "VALID"}, {"phash": "1" + "0" * 15}, "PHASH_VALIDATED_GROUP_RECEIPT"),
        ({"charge_id": "c", "verdict": "VALID"}, {"phash": "1" + "0" * 15, "group_id": "h"}, None),
        ({"charge_id": "c", "verdict": "VALID", "full_print": None, "legacy_print": None, "visual_print": None}, {"phash": "1" + "0" * 15}, "PHASH_VALIDATED_GROUP_LEGACY_RECEIPT"),
        ({"charge_id": "c", "verdict": "VALID", "full_print": None, "legacy_print": None, "visual_print": None}, {"phash": "3" + "0" * 15}, None),
        ({}, {"phash": "f" * 16}, None),
        ({"full_print": "l"}, {"full_print": "x", "visual_print": "w", "name": "n", "tx": "t"}, None),
        ({"full_print": "l", "tx": "t"}, {"full_print": "x", "name": "n", "tx": "t"}, "TRANSACTION_EVIDENCE"),
    ],
)
def test_duplicate_types_and_their_negatives(spark, first, second, want):
    base = {"receipt_id": "a", "received_at": 1, "group_id": "g", "phash": "0" * 16, "full_print": "f", "legacy_print": "l", "visual_print": "v", "tx": None, "name": None, "amount": 5, "mail": "m", "charge_id": None, "verdict": "UNCLEAR"}
    rows = [tuple((base | first).values()), tuple((base | {"receipt_id": "b", "received_at": 2} | second).values())]
    got = duplicates.matches(spark.createDataFrame(rows, IMAGE)).collect()
    told = [("CONFLICT" if r.conflict_id else r.match_type, r.original_id or r.conflict_id) for r in got if r.receipt_id == "b"]
    assert told == ([] if want is None else [(want, "a")]) and not [r for r in got if r.receipt_id == "a"]
