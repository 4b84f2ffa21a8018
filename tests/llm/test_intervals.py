from __future__ import annotations

import datetime as dt
import random
import zlib

import pytest

from quire.llm import intervals as I

EPOCH = dt.datetime(1970, 1, 1)
START = dt.datetime(2024, 1, 5)
NAMES = [["overlaps", "finished_by", "contains"], ["starts", "equals", "started_by"], ["during", "finishes", "overlapped_by"]]


def us(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def plain(sales, lines, clicks):
    """Every sale against every session of its client."""
    seen = {}
    for client, ts, kind in clicks:
        if client is not None and ts is not None:
            seen.setdefault(client, []).append((us(ts), kind == "error"))
    runs = {}
    for client, events in seen.items():
        for at, error in sorted(events):
            own = runs.setdefault(client, [])
            if own and at - own[-1][1] <= 900_000_000:
                own[-1][2] = error or (own[-1][2] and own[-1][1] == at)
                own[-1][1] = at
            else:
                own.append([at, at, error])
    slot, out = 21_600_000_000, {}
    for k, (sale, client, status, sold) in enumerate(sales):
        if client is None or sold is None:
            continue
        end = max([us(sold), *(us(s) for i, s in lines if i == sale and i is not None and s is not None)])
        s, e = us(sold) // slot, float("inf") if status == "open" else end // slot
        for first, until, is_open in runs.get(client, []):
            s2, e2 = first // slot, float("inf") if is_open else until // slot
            if s <= e2 and s2 <= e:
                name = NAMES[(s > s2) - (s < s2) + 1][(e > e2) - (e < e2) + 1]
                row = out.setdefault((k, sale, name), [0, None, 0])
                row[0] += 1
                if min(e, e2) != float("inf"):
                    row[1] = (row[1] or 0) + min(e, e2) - max(s, s2) + 1
                row[2] += zlib.crc32(str(first).encode())
    return sorted(((sale, name, *v) for (_, sale, name), v in out.items()), key=str)


def frames(spark, sales, lines, clicks):
    return (
        spark.createDataFrame(sales, "sale_id long, client_id long, status string, sold_at timestamp_ntz"),
        spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz"),
        spark.createDataFrame(clicks, "client_id long, ts timestamp_ntz, kind string"),
    )


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    r = random.Random(seed)
    hours = lambda n: START + dt.timedelta(hours=r.randrange(n), microseconds=r.choice([0, 1, 999_999, 59_000_000]))
    clients = [None, 1, 1, 1, 2, 3]
    sales = [(r.choice([i, i, 3, None]), r.choice(clients), r.choice(["open", "done", None]), r.choice([None, *[hours(1500)] * 9])) for i in range(60)]
    lines = [(r.choice([None, r.randrange(60)]), r.choice([None, hours(2500), hours(100)])) for _ in range(80)]
    clicks = []
    for _ in range(60):
        at, client = hours(2000), r.choice(clients)
        for _ in range(r.choice([1, 2, 40])):  # some sessions last for days
            clicks.append((client, r.choice([at] * 9 + [None]), r.choice(["view", "error", None])))
            clicks += clicks[-1:] * r.choice([0, 0, 1])
            at += dt.timedelta(microseconds=r.choice([0, 1, 900_000_000, 900_000_001, 600_000_000]))
    got = I.session_relations(*frames(spark, sales, lines, clicks))
    assert got.columns == ["sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(sales, lines, clicks)


def test_sessions_of_several_days_and_negative_times(spark):
    clicks = [(1, EPOCH + dt.timedelta(minutes=15 * k - 9000), "view") for k in range(1200)]
    sales = [(k, 1, "done", EPOCH + dt.timedelta(hours=6 * k - 200)) for k in range(60)]
    lines = [(k, EPOCH + dt.timedelta(hours=6 * k - 200 + 7 * (k % 9))) for k in range(60)]
    assert sorted(map(tuple, I.session_relations(*frames(spark, sales, lines, clicks)).collect()), key=str) == plain(sales, lines, clicks)


@pytest.mark.parametrize("width", [1, 3, 28])
def test_granules_change_no_result(spark, width):
    r = random.Random(width)
    make = lambda n: [(r.randrange(2), s := r.randrange(-40, 80), r.choice([None, s, s + r.randrange(200)])) for _ in range(n)]
    left, right = (spark.createDataFrame(sorted(set(make(60)), key=str), "key long, s long, e long") for _ in range(2))
    inf = 10**9
    pairs = {(a.key, a.s, a.e, b.s, b.e) for a in left.collect() for b in right.collect() if a.key == b.key and a.s <= (inf if b.e is None else b.e) and b.s <= (inf if a.e is None else a.e)}
    got = I.overlapping(left, right, width).collect()
    assert len(got) == len(pairs) and {(x.key, x.s, x.e, x.s2, x.e2) for x in got} == pairs


def test_empty_tables_and_extra_columns(spark):
    sales = [(1, 7, "open", START)]
    s, l, c = frames(spark, sales, [(1, START)], [(7, START, "error")])
    extra = [x.selectExpr("*", "1 as key", "2 as s", "3 as e", "4 as first") for x in (s, l, c)]
    assert [tuple(x) for x in I.session_relations(*extra).collect()] == plain(sales, [(1, START)], [(7, START, "error")])
    for k in range(3):
        tables = [x.limit(0) if i == k else x for i, x in enumerate((s, l, c))]
        assert I.session_relations(*tables).count() == (1 if k == 1 else 0)
