import pathlib
import random

import pytest
from pyspark.sql import functions as F

from pmspark.operators import asof as A
from pmspark.operators import book as B
from pmspark.operators import metrics as M
from pmspark.operators import portfolio as P
from pmspark.operators import research as R
from pmspark.operators import scan as S
from pmspark.operators import signals as G
from pmspark.operators import slippage as L
from pmspark.registry import queries
from pmspark.sources import blob as X
from pmspark.sources import readers as I
from pmspark.sources import sinks as O
from pmspark.streaming import streams as V

HOUR = 3600 * 10**9


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_asof_takes_the_last_at_or_before_and_forward_the_next(spark):
    left = frame(spark, [("a", 5), ("a", 10), ("b", 1)], "instrument_id string, ts_ns bigint")
    right = frame(spark, [("a", 5, 1, 1.0), ("a", 5, 2, 2.0), ("a", 9, 3, 3.0), ("b", 2, 1, 9.0)], "instrument_id string, ts_ns bigint, seq bigint, v double")
    back = {(r[0], r[1]): r[2] for r in A.asof(left, right, "instrument_id", ["v"]).collect()}
    assert back == {("a", 5): 2.0, ("a", 10): 3.0, ("b", 1): None}
    ahead = {(r[0], r[1]): r[2] for r in A.asof(left, right, "instrument_id", ["v"], "forward").collect()}
    assert ahead == {("a", 5): 1.0, ("a", 10): None, ("b", 1): 9.0}


def hot_rows(n=3000, seed=3):
    """Rows of which one instrument has nearly all; some share a time."""
    rng = random.Random(seed)
    return [("hot" if i % 9 else f"m{i % 4}", rng.randrange(n // 2), i, rng.choice([None, round(rng.random(), 3)])) for i in range(n)]


def by_place(df, *columns):
    return {(r["instrument_id"], r["ts_ns"], r["seq"]): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_of_a_hot_instrument_in_pieces(spark, monkeypatch, direction):
    right = frame(spark, hot_rows(), "instrument_id string, ts_ns bigint, seq bigint, v double").where("v is not null").repartition(4)
    left = frame(spark, [(k, t, i, 1) for k, t, i, _ in hot_rows(900, 4)] + [(None, 5, -1, 1), ("none", 5, -2, 1)], "instrument_id string, ts_ns bigint, seq bigint, x int").repartition(4)
    want = by_place(A.asof(left, right, "instrument_id", ["v"], direction), "v")
    monkeypatch.setattr(S, "PIECE", 100)
    assert by_place(A.asof(left, right, "instrument_id", ["v"], direction, hot=True), "v") == want
    pieces = S.pieced(right, ["instrument_id"])[0].groupBy("instrument_id", "_piece").count().collect()
    assert len({r["_piece"] for r in pieces if r["instrument_id"] == "hot"}) > 10 and max(r["count"] for r in pieces) < 300
    assert len(want) == 902


def test_recurrences_of_a_hot_instrument_in_pieces(spark, monkeypatch):
    rows = [(k, t, i, v or 0.5, (i * 7 % 5) / 4) for k, t, i, v in hot_rows()]
    df = frame(spark, rows, "instrument_id string, ts_ns bigint, seq bigint, v double, keep double").repartition(4)
    want, y = {}, {}
    for k, t, i, v, keep in sorted(rows):
        y[k] = want[k, t, i] = keep * y.get(k, 2.0) + v
    for piece, chunk in ((1 << 17, 128), (100, 8), (40, 3)):
        monkeypatch.setattr(S, "PIECE", piece)
        got = by_place(S.affine(df, "instrument_id", ("ts_ns", "seq"), F.col("keep"), F.col("v"), "y", 2.0, chunk), "y")
        assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k], rel=1e-9) for k in want)
        numbers = by_place(S.numbered(*(S.pieced(df, ["instrument_id"])[:1]), ["instrument_id"], ("ts_ns", "seq"), "n", len(rows)), "n")
        places = {}
        for k, t, i, *_ in sorted(rows):
            places.setdefault(k, []).append((k, t, i))
        assert all(numbers[p] == (n,) for ps in places.values() for n, p in enumerate(ps, 1))


def test_settlement(spark):
    fills = frame(spark, [("m", 1, 1, "buy", "no", 0.4, 10.0, 0.1), ("m", 2, 2, "hold", "no", 0.5, 1.0, 0.2), ("n", 1, 1, "sell", "yes", 0.5, 4.0, 0.0)], "instrument_id string, ts_ns bigint, seq bigint, action string, side string, price double, quantity double, commission double")
    out = {r["instrument_id"]: r["pnl"] for r in P.settlement_pnl(fills, frame(spark, [("m", 0), ("n", None)], "instrument_id string, realized_outcome int")).collect()}
    assert out["m"] == pytest.approx(-4 + 10 - 0.3)
    assert out["n"] is None


#: Whole cents, tenths of a cent, prices above 1 and below 0, and more prices than a word has bits.
GRIDS = {"cents": ("bigint", 1, 30, 20), "tenths": ("decimal(9,1)", 0.1, 30, 20), "wide": ("bigint", 7, -200, 90), "many": ("decimal(9,2)", 0.25, 100, 2000)}


@pytest.mark.parametrize("grid", list(GRIDS))
def test_best_quote_equals_a_sequential_book(spark, grid):
    from decimal import Decimal

    kind_of, tick, first, ticks = GRIDS[grid]
    price = lambda n: n * tick + first if kind_of == "bigint" else Decimal(str(round(n * tick + first, 2)))
    rng = random.Random(1)
    rows, seq = [], 0
    for t in range(400):
        kind = "book_snapshot" if t % (50 if ticks < 100 else 300) == 0 else "price_change"
        for _ in range(5 if kind == "book_snapshot" else 1):
            seq += 1
            side = rng.choice(["BUY", "SELL"])
            rows.append(("m", t, seq, kind, side, price(rng.randrange(ticks) + (ticks if side == "SELL" else 0)), rng.choice([0, 3, 7])))
    updates = frame(spark, rows, f"instrument_id string, ts_ns bigint, seq bigint, update_type string, side string, price_cents {kind_of}, size bigint")
    deltas = B.updates_to_deltas(updates)
    got = {r["event_index"]: (r["bid"], r["bid_size"], r["ask"], r["ask_size"]) for r in B.best_quote(deltas).collect()}
    book, want = {}, {}
    for r in deltas.orderBy("sequence").collect():
        if r["action"] == 4:
            book = {}
        elif r["size"]:
            book[r["side"], r["price_cents"]] = r["size"]
        else:
            book.pop((r["side"], r["price_cents"]), None)
        bids, asks = ([p for s, p in book if s == side] for side in (1, 2))
        b, a = max(bids, default=None), min(asks, default=None)
        want[r["event_index"]] = (b, book.get((1, b)), a, book.get((2, a)))
    assert got == want
    assert deltas.where("flags = 128").count() == len(want)


def test_a_book_of_more_prices_than_its_words_hold_is_an_error(spark):
    rows = [("m", 0, 0, "book_snapshot", "BUY", 0, 1)] + [("m", 1, i, "price_change", "BUY", i, 1) for i in range(1, B.WORD * B.WORD + 1)]
    updates = frame(spark, rows, "instrument_id string, ts_ns bigint, seq bigint, update_type string, side string, price_cents bigint, size bigint")
    with pytest.raises(Exception, match="more than 3844 prices"):
        B.best_quote(B.updates_to_deltas(updates)).collect()


def test_snapshot_diff_keeps_texts(spark):
    level = "array<struct<price:string,size:string>>"
    rows = [("m", 1, [("0.3", "5"), ("0.4", "1")], [("0.6", "2")]), ("m", 2, [("0.3", "5.0")], [("0.6", "2"), ("0.7", "1")])]
    out = B.snapshot_diff(frame(spark, rows, f"instrument_id string, ts_ns bigint, bids {level}, asks {level}")).where("ts_ns = 2").orderBy("sequence").collect()
    assert [(r["side"], r["price"], r["size"], r["flags"]) for r in out] == [(1, "0.3", "5.0", 0), (1, "0.4", "0", 0), (2, "0.7", "1", 128)]


def test_vwap_walks_the_asks(spark):
    df = frame(spark, [([("0.5", "10"), ("0.6", "10")],)], "asks array<struct<price:string,size:string>>")
    r = df.select(B.vwap_for_size(F.col("asks"), F.lit(15)).alias("a"), B.vwap_for_size(F.col("asks"), F.lit(25)).alias("b")).first()
    assert r["a"] == pytest.approx((5 + 3) / 15) and r["b"] is None


@pytest.mark.parametrize("chunk", [3, 128])
def test_affine_scan_equals_the_recurrence(spark, chunk):
    rng = random.Random(2)
    xs = [rng.random() for _ in range(50)]
    q = frame(spark, [("m", i, i, x) for i, x in enumerate(xs)], "instrument_id string, ts_ns bigint, seq bigint, price double")
    got = {r["seq"]: r["y"] for r in G.affine_scan(q, "price", 0.3, 5, "y", chunk).collect()}
    y = sum(xs[:5]) / 5
    want = {4: y}
    for i in range(5, 50):
        y = 0.7 * y + 0.3 * xs[i]
        want[i] = y
    assert got == pytest.approx(want)


def test_average_cost_resets_at_flat(spark):
    rows = [("m", 1, 1, "buy", 2.0, 0.4), ("m", 2, 2, "buy", 2.0, 0.6), ("m", 3, 3, "sell", 4.0, 0.9), ("m", 4, 4, "buy", 1.0, 0.2)]
    out = P.average_cost(frame(spark, rows, "instrument_id string, ts_ns bigint, seq bigint, action string, quantity double, price double")).orderBy("seq").collect()
    assert [None if r["avg_cost"] is None or r["avg_cost"] != r["avg_cost"] else round(r["avg_cost"], 6) for r in out] == [0.4, 0.5, None, 0.2]


def test_gate_and_late_rows(spark):
    rows = [("m", 1, 1, "price_change", 5, 0), ("m", 2, 2, "book_snapshot", 5, 0), ("m", 3, 3, "price_change", 5, 1), ("m", 2, 4, "price_change", 5, 2)]
    u = frame(spark, rows, "instrument_id string, ts_ns bigint, seq bigint, update_type string, size bigint, batch int")
    missing = frame(spark, [("m", 3), ("x", 1)], "instrument_id string, hour_ns bigint")
    assert sorted(r["seq"] for r in B.gate_on_snapshot(u, missing.limit(0)).collect()) == [2, 3, 4]
    assert sorted(r["seq"] for r in B.gate_on_snapshot(u, missing).collect()) == [2, 4]
    assert sorted(r["seq"] for r in B.drop_late_updates(u, "batch").collect()) == [1, 2, 3]


def test_sinks_replace_their_own_instruments_and_days_only(spark):
    path = O.scratch(spark)
    day = 24 * HOUR
    rows = lambda *x: frame(spark, x, "instrument_id string, ts_ns bigint, v int")
    held = lambda: sorted((r["instrument_id"] or "", str(r["day"]), r["v"]) for r in spark.read.parquet(path).collect())
    for buckets in (1,):  # all instruments of a day in one partition
        O.write_by_day(rows(("m", 0, 1), ("m", day, 2)), path, buckets=buckets)
        O.write_by_day(rows(("n", 0, 3), ("n", 5, 4), (None, 0, 5)), path, buckets=buckets)
        assert held() == [("", "1970-01-01", 5), ("m", "1970-01-01", 1), ("m", "1970-01-02", 2), ("n", "1970-01-01", 3), ("n", "1970-01-01", 4)]
        O.write_by_day(rows(("n", 7, 6)), path, buckets=buckets)
        O.write_by_day(rows((None, 1, 7), (None, None, 8)), path, buckets=buckets)
        assert held() == [("", "1970-01-01", 7), ("", "None", 8), ("m", "1970-01-01", 1), ("m", "1970-01-02", 2), ("n", "1970-01-01", 6)]
        O.write_by_day(rows(), path, buckets=buckets)
        assert len(held()) == 5
    with pytest.raises(ValueError, match="lacks"):
        I.read_deltas(spark, path)


def test_a_write_that_fails_leaves_the_table_as_it_was(spark):
    path = O.scratch(spark)
    rows = lambda v: frame(spark, [("m", 0, v), ("n", 0, v + 1)], "instrument_id string, ts_ns bigint, v int")
    O.write_by_day(rows(1), path, buckets=1)
    bad = rows(5).where("instrument_id = 'm'").withColumn("v", F.when(F.col("v") > 0, F.raise_error(F.lit("stop"))).cast("int"))
    with pytest.raises(Exception, match="stop"):
        O.write_by_day(bad, path, buckets=1)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_schema_promotion(spark):
    a, b, c = (frame(spark, [], s).schema for s in ("x int", "x int, y string", "x string"))
    assert O.promote_schema(a, b) == b
    assert O.promote_schema(a, c) is None


def test_empty_inputs_give_empty_results(spark):
    fills = frame(spark, [], "instrument_id string, ts_ns bigint, seq bigint, action string, side string, price double, quantity double, commission double")
    prices = frame(spark, [], "instrument_id string, ts_ns bigint, seq bigint, price double")
    assert P.dense_equity(fills, prices, 1.0).count() == 0
    assert G.mean_reversion(prices, 5, 0.1, 0.1).count() == 0


def test_commissions_by_label_rate_and_waiver(spark):
    from pmspark.operators import fees as E

    cases = [("Crypto", 50, 0.2), ("not crypto at all", 50, 0.25), ("not crypto at all", 37, 0.0), (None, 720, 0.2), (None, 41, 0.0), ("Other-General", 37, 0.25), ("sports", 0, 0.0), ("", None, 0.0)]
    markets = frame(spark, [(f"m{i}", c, None if b is None else b / 10_000) for i, (c, b, _) in enumerate(cases)], "instrument_id string, category string, taker_fee double")
    fills = frame(spark, [(f"m{i}", kind, 0.5, 100.0) for i in range(len(cases)) for kind in ("limit", "market")] + [("unknown", "market", 0.5, 1.0)], "instrument_id string, order_type string, price double, quantity double")
    got = {(r["instrument_id"], r["order_type"]): float(r["commission"]) for r in E.add_commission(fills, markets, "bps").collect()}
    for i, (_, bps, share) in enumerate(cases):
        fee = 25 * (bps or 0) / 10_000
        assert got[f"m{i}", "market"] == pytest.approx(fee) and got[f"m{i}", "limit"] == pytest.approx(-fee * share, abs=6e-6)  # half up at five digits
    assert got["unknown", "market"] == 0
    assert all(float(r["commission"]) >= 0 for r in E.add_commission(fills, markets, "bps", rebates=False).collect())
    waived = frame(spark, [("a", "1970-01-01T00:00:01", 0.1), ("b", "soon", None), ("c", None, 0.02)], "instrument_id string, fee_waiver_expiration_time string, taker_fee double")
    orders = frame(spark, [(k, t, p, 10.0) for k in "abcd" for t in (10**9, 10**9 + 1) for p in (0.5, 1.0)], "instrument_id string, ordered_ns bigint, price double, quantity double")
    got = {(r["instrument_id"], r["ordered_ns"] - 10**9, r["price"]): float(r["commission"]) for r in E.add_commission(orders, waived, "cents").collect()}
    assert [got[k, t, 0.5] for k in "abcd" for t in (0, 1)] == [0, 0.25, 0.18, 0.18, 0.05, 0.05, 0.18, 0.18]
    assert not any(v for (_, _, p), v in got.items() if p == 1.0)


@pytest.mark.parametrize("block", [1, 64])
def test_stab_finds_each_level_once_with_few_rows_an_interval(spark, block):
    rng = random.Random(block)
    spans = [(a, a + n) for n in (1, 2, 63, 64, 65, 1000, 99_999) for a in (1, 2, 63, 64, 65, 128, rng.randrange(1, 5000))]
    intervals = frame(spark, [("m", 1, 1, i, 1, a, b) for i, (a, b) in enumerate(spans)], "instrument_id string, epoch bigint, side int, price_cents bigint, size bigint, from_seq int, to_seq int")
    points = sorted({p for a, b in spans for p in (a - 1, a, a + 1, b - 1, b)} | {rng.randrange(100_000) for _ in range(50)})
    got = sorted(tuple(r) for r in B.stab(frame(spark, [("m", p) for p in points], "instrument_id string, sequence int"), intervals, block).select("sequence", "price_cents").collect())
    assert got == sorted((p, i) for p in points for i, (a, b) in enumerate(spans) if a <= p < b)


def deltas_of(spark, rows):
    return B.updates_to_deltas(frame(spark, rows, "instrument_id string, ts_ns bigint, seq bigint, update_type string, side string, price_cents bigint, size bigint"))


def test_ledger_match_walks_the_book_up_to_its_price(spark):
    book = [("m", 1, i, "book_snapshot", s, p, q) for i, (s, p, q) in enumerate([("SELL", 41, 10), ("SELL", 42, 5), ("SELL", 45, 100), ("BUY", 39, 7), ("BUY", 38, 1)])]
    deltas = deltas_of(spark, [*book, ("m", 5, 9, "price_change", "SELL", 41, 0)])
    orders = [("m", 0, "BUY", "0.45", 1, 1), ("m", 1, "BUY", "0.42", 12, 2), ("m", 1, "BUY", "0.42", 100, 3), ("m", 5, "BUY", "0.44", 8, 4), ("m", 4, "SELL", "0.38", 8, 5), ("m", 4, "SELL", "0.40", 8, 6), ("x", 4, "SELL", "0.40", 8, 7)]
    ledger = frame(spark, orders, "instrument_id string, ts_ns bigint, side string, price string, size bigint, input_seq bigint")
    got = {r["input_seq"]: (r["crossed"], r["fillable"], r["average"] and round(r["average"], 6), r["levels"]) for r in R.ledger_match(ledger, deltas).collect()}
    assert got == {
        1: (False, 0.0, None, 0),
        2: (True, 12.0, round((10 * 0.41 + 2 * 0.42) / 12, 6), 2),
        3: (True, 15.0, round((10 * 0.41 + 5 * 0.42) / 15, 6), 2),
        4: (True, 5.0, 0.42, 1),
        5: (True, 8.0, round((7 * 0.39 + 0.38) / 8, 6), 2),
        6: (False, 0.0, None, 0),
        7: (False, 0.0, None, 0),
    }


def test_streamed_books_close_an_hour_after_their_last_hour(spark):
    """The hour 2 is never loaded: what comes later waits for a snapshot, and a row of hour 1 that comes late still goes into the open book."""
    rows = [("m", 0, 1, "book_snapshot", 0), ("m", HOUR, 2, "price_change", 1), ("m", HOUR + 5, 3, "price_change", 2), ("m", 3 * HOUR, 4, "price_change", 2), ("m", 4 * HOUR, 5, "book_snapshot", 3), ("m", 4 * HOUR + 1, 6, "price_change", 3)]
    updates = frame(spark, [(k, t, n, u, "BUY", 40 + n, 5, batch) for k, t, n, u, batch in rows], "instrument_id string, ts_ns bigint, seq bigint, update_type string, side string, price_cents bigint, size bigint, batch int")
    hours = frame(spark, [("m", h * HOUR, b) for h, b in ((0, 0), (1, 1), (3, 1), (4, 3))], "instrument_id string, hour_ns bigint, batch int")
    marks = V.with_hours(updates.limit(0), hours).drop("batch").join(hours.select(F.col("hour_ns").alias("ts_ns"), "batch"), "ts_ns").select(*updates.columns)
    stream = V.in_parts(updates.unionByName(marks), O.scratch(spark), F.col("batch"), 4)
    out = V.incremental(stream, O.scratch(spark), V.deltas_step)
    assert sorted((r["ts_ns"], r["price_cents"]) for r in out.where("action <> 4").collect()) == [(0, 41), (HOUR, 42), (HOUR + 5, 43), (4 * HOUR, 45), (4 * HOUR + 1, 46)]


def test_streamed_rows_of_one_time_are_put_together_over_batches(spark):
    """Of a snapshot one row comes a batch later, as does the first of two changes of one time: the deltas are those of one batch."""
    rows = [("m", 1, 1, "book_snapshot", 40, 0), ("m", 1, 2, "book_snapshot", 41, 1), ("m", 2, 3, "price_change", 41, 2), ("m", 2, 4, "price_change", 42, 1), ("m", 3, 5, "price_change", 43, 3), ("n", 1, 1, "book_snapshot", 50, 0), ("n", 1, 2, "price_change", 50, 1)]
    updates = frame(spark, [(k, t, n, u, "BUY", p, 5, b) for k, t, n, u, p, b in rows], "instrument_id string, ts_ns bigint, seq bigint, update_type string, side string, price_cents bigint, size bigint, batch int")
    out = V.incremental(V.in_parts(updates, O.scratch(spark), F.col("batch"), 4), O.scratch(spark), V.deltas_step)
    want = B.updates_to_deltas(updates.drop("batch"))
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def market_days(spark, rows):
    return frame(spark, rows, "channel string, slug string, segment string, day string, size bigint").withColumn("day", F.col("day").cast("date"))


def everything(spark, slugs="abcz", first="2024-01-01", last="2024-12-31"):
    return frame(spark, [("t", x, "0", first, last) for x in slugs], "channel string, slug string, segment string, first_day string, last_day string").withColumns({c: F.col(c).cast("date") for c in ("first_day", "last_day")})


def test_parts_are_cut_by_bytes_and_days_and_split_no_market_day(spark):
    rng = random.Random(1)
    days = [("t", f"m{i:04}", "0", f"2024-{1 + i % 2:02}-{1 + i % 28:02}", rng.choice([10, 100, 900, 5000])) for i in range(600)]
    cut = X.cut_parts(market_days(spark, days).withColumns({"year": F.year("day"), "month": F.month("day"), "bytes": F.col("size")}), 4000, 40)
    parts = {}
    for r in cut.orderBy("slug", "segment", "day").collect():
        parts.setdefault((r["month"], r["part"]), []).append(r["bytes"])
    assert all(len(p) <= 40 and sum(p[:-1]) < 4000 for p in parts.values()) and sum(map(len, parts.values())) == 600
    rows = market_days(spark, [d for d in days for _ in range(rng.choice([1, 30]))])
    X.write_blob(rows, path := O.scratch(spark), 2000, 40)
    kept = spark.read.parquet(f"{path}/data")
    assert kept.count() == rows.count()
    assert kept.groupBy("slug", "segment", "day").agg(F.countDistinct("part", "month").alias("n")).where("n > 1").isEmpty()
    assert X.manifest(spark, path).agg(F.sum("rows")).first()[0] == rows.count()


def test_small_parts_share_folders_and_none_is_split(spark, monkeypatch):
    days = [("t", f"m{i:04}", "0", f"2024-01-{1 + i % 28:02}", 1) for i in range(400)]
    monkeypatch.setattr(X, "FOLDER_BYTES", 4000)
    X.write_blob(market_days(spark, days), path := O.scratch(spark), 100, 40)
    kept = spark.read.parquet(f"{path}/data")
    places = kept.groupBy("part_no").agg(F.countDistinct("part").alias("n"), F.min("part").alias("folder")).collect()
    total = X.manifest(spark, path).agg(F.sum("bytes")).first()[0]
    assert len(places) > 100 and all(p["n"] == 1 and p["folder"] <= p["part_no"] for p in places)
    assert len(list(pathlib.Path(path, "data").rglob("*.parquet"))) == len({p["folder"] for p in places}) == -(-total // 4000)
    assert X.scan_blob(spark, path, everything(spark, ["m0007", "m0399"])).count() == 2


def test_a_store_reads_what_its_manifest_names(spark):
    path = O.scratch(spark)
    first = market_days(spark, [("t", "a", "0", "2024-01-01", 1), ("t", "a", "0", "2024-01-02", 2), ("t", "b", "0", "2024-01-01", 3), ("q", "a", "0", "2024-01-01", 9)])
    none = market_days(spark, [("t", "z", "0", "2024-01-05", 0)]).drop("size").withColumn("checked_at", F.col("day"))
    assert X.write_blob(first, path, empty=none) == 1
    sizes = lambda **k: sorted(r["size"] for r in X.scan_blob(spark, path, everything(spark), **k).collect())
    assert sizes() == [1, 2, 3]
    # A write that fails before its commit leaves an orphan, which nobody reads and the next write replaces.
    market_days(spark, [("t", "a", "0", "2024-01-03", 77)]).withColumns({"year": F.lit(2024), "month": F.lit(1), "part": F.lit(0)}).write.partitionBy("channel", "year", "month", "part").parquet(f"{path}/data/version=2")
    assert sizes() == [1, 2, 3]
    second = market_days(spark, [("t", "a", "0", "2024-01-02", 20), ("t", "z", "0", "2024-01-05", 5)]).withColumn("note", F.lit("new"))
    gone = market_days(spark, [("t", "b", "0", "2024-01-01", 0)]).drop("size").withColumn("checked_at", F.col("day"))
    assert X.write_blob(second, path, empty=gone) == 2
    assert sizes() == [1, 5, 20] and sizes(version=1) == [1, 2, 3]
    assert sorted((r["slug"], r["rows"]) for r in X.manifest(spark, path).where("channel = 't'").collect()) == [("a", 1), ("a", 1), ("b", 0), ("z", 1)]
    assert sorted(str(r["note"]) for r in X.scan_blob(spark, path, everything(spark, "az")).collect()) == ["None", "new", "new"]
    # What the manifest does not name is not opened, even in a version that counts.
    stray = pathlib.Path(path, "data", "version=1", "channel=t", "year=2024", "month=1", "part=5")
    stray.mkdir(parents=True)
    (stray / "x.parquet").write_text("no parquet")
    assert sizes() == [1, 5, 20]
    assert X.scan_blob(spark, path, everything(spark, "q")).isEmpty()
    with pytest.raises(ValueError, match="no version"):
        X.manifest(spark, O.scratch(spark))


def test_dialects_go_by_platform_data_type_and_vendor():
    I.register_dialect("Binary", "fills", " Other ", lambda df: df)
    assert I.resolve_dialect("BINARY ", "Fills", "other") is not I.resolve_dialect("binary", "fills", "chain")
    assert I.unregister_dialect("binary", "fills", "other") and I.unregister_dialect("binary", "fills", "other") is None
    with pytest.raises(NotImplementedError, match="binary/fills/other"):
        I.resolve_dialect("binary", "fills", "other")


def test_slippage_refuses_negative_ticks(spark):
    with pytest.raises(ValueError, match="negative"):
        L.slip_orders(spark.range(1), "bps", ticks=-1)


def test_shuffles_have_partitions_by_the_rows_of_the_tables(spark, small, monkeypatch):
    from pmspark.plans import fixtures as fx

    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    was = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.unset(k)
    monkeypatch.setattr(fx, "TASK_ROWS", 500)
    fx.updates(spark, small), fx.outcomes(spark, small)
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert int(spark.conf.get(names[0])) == -(-rows // 500) and int(spark.conf.get(names[1])) == fx.TASK_BYTES and int(spark.conf.get(names[2])) == fx.SPLIT_BYTES
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_joint_drawdown_sorts_an_instrument_once_and_gathers_no_times(spark, monkeypatch):
    rows = [("a", 1, 1, 5.0), ("a", 1, 2, 7.0), ("a", 3, 3, 4.0), ("b", 1, 1, 10.0), ("b", 2, 2, None), ("b", 2, 3, 12.0)]
    equity, seen, blocked = spark.createDataFrame(rows, "instrument_id string, ts_ns bigint, seq bigint, equity double"), [], M.blocked
    monkeypatch.setattr(M, "blocked", lambda df: (seen.append(df), blocked(df))[1])
    got = [tuple(r) for r in M.joint_drawdown(equity).orderBy("ts_ns").select("ts_ns", "total", "peak", "drawdown").collect()]
    assert got == [(1, 17.0, 17.0, 0.0), (2, 19.0, 19.0, 0.0), (3, 16.0, 19.0, 3.0)]
    assert _plan(seen[0]).count("Sort [") == 1 and "max_by" not in _plan(seen[0])


ONCE = [
    (O, "write_by_day", "sink_deltas"),
    (B, "book_at", "book_at_time"),
    (P, "allocation_value", "allocation_value"),
    (I, "parse_payload", "payload_parse"),
    (R, "ledger_match", "ledger_match"),
    (P, "dense_equity", "dense_equity"),
]


@pytest.mark.parametrize("module, operator, name", ONCE)
def test_what_a_query_takes_in_several_places_is_worked_out_once(spark, small, monkeypatch, module, operator, name):
    """Its operator gets tables without the windows that make them."""
    seen, held = [], getattr(module, operator)
    monkeypatch.setattr(module, operator, lambda *a, **k: (seen.extend(x for x in a if hasattr(x, "_jdf")), held(*a, **k))[1])
    queries()[name](spark, small)
    assert seen and not any("Window" in _plan(df) for df in seen)
