"""Queries over dense events: many charges of one amount and day, as larger tables have them."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tallymark.operators import cascade, replies
from tallymark.plans import evidence
from tallymark.plans import linkage as L


def dense(spark, folder, n):
    """``n`` purchases within two days, of ten amounts and ``n`` // 10 users."""
    i = F.col("id")
    rows = spark.range(n).select(i.alias("event_id"), F.timestamp_seconds(1705276800 + i * 7919 % 172800).cast("timestamp_ntz").alias("ts"), (i * 31 % (n // 10)).alias("user_id"), F.lit("purchase").alias("event_type"), (i * 17 % 10).cast("double").alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/made")
    part = next(p for p in (folder / "made").iterdir() if p.suffix == ".parquet")
    part.rename(folder / "events.parquet")
    return str(folder)


def agrees(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found = E.queries()[name](spark, folder)
    want = con.sql(E.oracle_sql()[name])
    columns = want.columns
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)
    return got == sorted(want.fetchall(), key=key), len(got)


def test_candidates_by_window_beyond_the_budget(spark, tmp_path):
    """A query of candidates lists them all: 11 000 charges on a receipt's days are more than a search of the cascade reads."""
    same, n = agrees(spark, dense(spark, tmp_path, 11_000), "cand_by_window")
    assert same and n > 50_000


def test_other_payers_charges_are_met_by_open_receipts_only(spark, tmp_path):
    """Rows of the cascade stay near its receipts, where every amount and day has a hundred charges."""
    folder = dense(spark, tmp_path, 2_000)
    found = L._judged(spark, folder)[1].count()
    assert found < 30_000


def test_a_reply_is_bared_once(spark):
    """Fences and thinking are taken off once a reply, not for each of its characters; the first object stays the same."""
    replies_ = ["```json\n{\"a\": {\"b\": 1}}\n```", "<think>{\"a\": 0}</think> so {x} {\"a\": 2} {\"a\": 3}", "none", None, ""]
    found = spark.createDataFrame([(r,) for r in replies_], "r string").select(replies.first_object(F.col("r")).alias("o"))
    assert [r.o for r in found.collect()] == ['{"a": {"b": 1}}', '{"a": 2}', None, None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("json|```") <= 1


def test_pairs_by_amount_carry_their_receipt(spark, tmp_path):
    """Pairs are many: they are not joined with their receipts again."""
    found = L.charge_time_match(spark, dense(spark, tmp_path, 500))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2


def test_candidate_rows_are_narrow_and_sorted_once(spark):
    """What a row says by itself is one number, and receipts are decided in one shuffle and one sort; only the first tier's rows are counted."""
    facts = list(cascade._facts())
    bit = lambda *names: sum(1 << facts.index(n) for n in names)
    made = [("r1", "a", True, bit("strict")), ("r1", "b", False, bit("strict")), ("r1", "c", False, bit("broad")), ("r2", "a", False, bit("canonical")), ("r2", "b", False, bit("canonical", "c7")), ("r3", "a", False, bit("strict", "told", "c0")), ("r3", "b", False, bit("told", "timely", "c0", "now0"))]
    rows = spark.createDataFrame(made, "receipt_id string, id string, claimed boolean, facts long").selectExpr("receipt_id", "id", "0L AS created", "'' AS payer", "'' AS payer_name", "false AS same_name", "claimed", "0L AS c_amount", "true AS date_ok", "facts")
    found = cascade._decided(rows.repartition("receipt_id").dropDuplicates(["receipt_id", "id"]))
    assert {(r.receipt_id, r.id, r.tier, r.tier_n) for r in found.filter("hit").collect()} == {("r1", "b", "strict", 1), ("r2", "b", "canonical", 1), ("r3", "b", "identifier", 1)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Window [") <= 3 and plan.count("Sort [") <= 2


def test_ambiguous_receipts_are_found_once(spark, tmp_path):
    """They are a table, since scores and bursts read them several times."""
    assert hasattr(evidence._open_receipts(spark, dense(spark, tmp_path, 300))[0], "scratch_path")


def test_candidates_of_two_sources_are_prepared_once(spark, tmp_path, monkeypatch):
    runs, real = [], L._prepared
    monkeypatch.setattr(L, "_prepared", lambda *a: runs.append(a) or real(*a))
    same, n = agrees(spark, dense(spark, tmp_path, 300), "distinct_candidates")
    assert same and n > 100 and len(runs) == 1


def test_a_new_claim_asks_its_state_once():
    """Each call of the state is a message, and most keys come once: one to read, one to write."""
    from tallymark.streaming.claims import _Claims

    class State:
        def __init__(self):
            self.calls = []

        def __getattr__(self, name):
            return lambda *a: self.calls.append(name)

    job = _Claims(100)
    job.handle, job.held = State(), State()
    out = list(job.handleInputRows(("k",), iter([{"owner": "a", "action": "claim", "at": 5}, {"owner": "b", "action": "claim", "at": 6}]), None))
    assert [r["outcome"] for r in out] == ["new", "duplicate"] and job.held.calls == ["get", "update"]


@pytest.mark.parametrize("name", ["charge_eligible", "src_charge_search"])
def test_pairs_by_amount_come_in_tiles(spark, tmp_path, name):
    """All pairs of an amount, as their SQL lists them; written tile by tile they take a fraction of a byte each."""
    folder, out = dense(spark, tmp_path, 3_000), str(tmp_path / "out")
    E.queries()[name](spark, folder).write.parquet(out)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    con.execute(f"CREATE TABLE want AS {E.oracle_sql()[name]}")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{out}/*.parquet'")
    count = lambda t: con.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0]
    n = count("got")
    assert n > 300_000 and n == count("want")
    assert not con.sql("SELECT * FROM got EXCEPT ALL SELECT * FROM want").fetchall()
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * n
