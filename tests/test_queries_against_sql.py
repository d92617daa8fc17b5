"""Queries against their SQL in DuckDB, over small tables with rows at the edges."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__

BEGIN = datetime.datetime(2024, 1, 5, 9)
TYPES = ("click", "error", "view")


def write_events(path, rows) -> str:
    """rows: (offset from BEGIN in microseconds, user, type, value)."""
    at = [BEGIN + datetime.timedelta(microseconds=r[0]) for r in rows]
    columns = {"event_id": range(len(rows)), "ts": pa.array(at, pa.timestamp("us")), "user_id": [r[1] for r in rows], "event_type": [r[2] for r in rows], "value": [float(r[3]) for r in rows], "props": ["{}"] * len(rows)}
    pq.write_table(pa.table(columns), path / "events.parquet")
    return str(path)


def compare(spark, name: str, sf_dir: str) -> int:
    """Fails unless both give the same rows, their number among equal ones included."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    found = __spark_entry__.queries()[name](spark, sf_dir)
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({__spark_entry__.oracle_sql()[name]}) AS o").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    return len(want)


HOUR_US = 3_600_000_000
#: Microseconds around a whole hour and a whole millisecond: the last half millisecond belongs to the next one.
EDGES = [k * HOUR_US + us for k in (1, 2) for us in (-501, -500, -499, -1, 0, 1, 499, 500)]
BEFORE_1970 = -int((BEGIN - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.mark.parametrize("name", ["monitor_timeline", "monitor_page", "temporal_before_after_within"])
def test_times_are_rounded_to_milliseconds_as_in_sql(spark, tmp_path, name):
    shifts = (0, BEFORE_1970) if name == "monitor_timeline" else (0,)
    rows = [(us + shift - n * HOUR_US, n, TYPES[n % 3], 50 + n) for shift in shifts for n, us in enumerate(EDGES * 3)]
    assert compare(spark, name, write_events(tmp_path, rows)) > 0


def test_a_day_of_the_week_ends_with_its_last_microsecond(spark, tmp_path):
    rows = [(15 * HOUR_US + d * 24 * HOUR_US + us, 1, "view", 1) for d in range(8) for us in (-501, -500, -1, 0, 500)]
    assert compare(spark, "temporal_dow_tod", write_events(tmp_path, rows)) == 40


@pytest.mark.parametrize("name", ["window_spans", "window_count", "window_dedup_channels"])
@pytest.mark.parametrize("shift", [0, BEFORE_1970])
def test_a_window_s_seconds_are_those_of_sql(spark, tmp_path, name, shift):
    """Each user's second row comes an hour, a day or a week after its first, a few microseconds from the edge of the window."""
    rows, user = [], 0
    for span in (1, 24, 72, 168):
        for us in (-501, -500, -1, 0, 499, 500, 999_499, 999_500):
            for more in (0, -1_000_000):
                user += 1
                rows += [(shift + us + n, user, TYPES[user % 3], 50) for n in range(9 if span == 168 else 1)]
                rows.append((shift + span * HOUR_US + more, user, TYPES[user % 3], 50))
    assert compare(spark, name, write_events(tmp_path, rows)) == len(rows)


SLIDING = {"window_sum": (10.3, 60.7, 200.9), "window_avg": (10.3, 40.7), "window_ratio": (0.3, 3.7), "window_min": (1.3, 9.9), "window_max": (1.3, 99.9)}


@pytest.mark.parametrize("name", SLIDING)
def test_windows_are_compared_as_doubles(spark, tmp_path, name):
    """Values that differ from a limit by less than a 32-bit number can tell; event_id is a multiple of 7, so a ratio's divisor is 1."""
    values = [x for limit in SLIDING[name] for x in (limit, limit - 1e-9, limit + 1e-9, limit * (1 - 2**-52), limit * (1 + 2**-51))]
    rows = []
    for user, value in enumerate(values):
        rows += [(0, user, "view", value), (2_000_000, user, "view", 1), *[(0, 1000 + user, "view", 1)] * 5]
    assert compare(spark, name, write_events(tmp_path, rows)) == len(rows)


def test_averages_of_few_rows_are_added_oldest_first(spark, tmp_path):
    """Three values whose exact mean is a limit: the sum's last bit, and so the rule, depends on the order of addition."""
    cents = [(a, b, 12210 - a - b) for a in range(3, 4000, 97) for b in range(5, 5000, 211)]
    rows = []
    for user, three in enumerate(cents):
        hours = (1, 16, 20) if user % 2 else (1, 2, 20)
        rows += [(h * HOUR_US, user, "view", x / 100) for h, x in zip(hours, three)]
        rows.append((24 * HOUR_US, user, "view", 1))
    order = {a + b + c == a + (b + c) for a, b, c in ((x / 100, y / 100, z / 100) for x, y, z in cents)}
    assert order == {True, False}
    assert compare(spark, "window_avg", write_events(tmp_path, rows)) == len(rows)


def test_sums_of_few_rows_are_added_oldest_first(spark, tmp_path):
    cents = [(a, b, 20090 - a - b) for a in range(3, 7000, 97) for b in range(5, 9000, 211)]
    rows = []
    for user, three in enumerate(cents):
        hours = (1, 16, 20) if user % 2 else (1, 2, 20)
        rows += [(h * HOUR_US, user, "view", x / 100) for h, x in zip(hours, three)]
        rows.append((24 * HOUR_US, user, "view", 1))
    assert compare(spark, "window_sum", write_events(tmp_path, rows)) == len(rows)
