"""What a review found queries to leave out."""

import base64
from datetime import datetime, timedelta

from duck import connect
from pyspark.sql import functions as F

from quadrille.queries import data, data_sql, reference

T0 = datetime(2024, 1, 1)
A, B = (base64.b64encode(bytes([k]) * 32).decode() for k in (0xFB, 0xFC))


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def status(spark, folder, pairs):
    """Reports of both instances; ``pairs``: repo -> (np_count, checksum) of inst-a and inst-b."""
    rows = [(2 * k + j, inst, repo, *v, T0) for k, (repo, both) in enumerate(pairs.items()) for j, (inst, v) in enumerate(zip(("inst-a", "inst-b"), both))]
    return put(spark, folder, "repo_status", rows, "status_row long, instance string, repo string, np_count long, checksum string, reported_at timestamp_ntz")


def test_fleet_compares_checksums(spark, rows, tmp_path):
    spelled = A.rstrip("=").translate(str.maketrans("+/", "-_"))
    assert spelled != A
    pairs = {"same": ((1, A), (1, f" {spelled} ")), "sum": ((1, A), (1, B)), "count": ((1, A), (2, A)), "null": ((1, A), (1, None)), "nulls": ((None, None), (None, None)), "bad": ((1, "abcde"), (1, None)), "bads": ((1, "abcde"), (1, "fghij"))}
    assert rows(reference.fleet_consistency(spark, status(spark, tmp_path, pairs))) == [("bad",), ("bads",), ("count",), ("null",), ("sum",)]


def test_state_selects_what_runs_process(spark, rows, tmp_path, monkeypatch):
    """Runs of all spans see number 1; only the state can tell that the first of them processed it."""
    day = lambda k: T0 + timedelta(days=k)
    polls = [(k, day(k), n, s, "ok") for k, n, s in ((1, 1, 7), (2, 3, 7), (3, 2, 7), (4, 9, 7), (5, 9, 7), (6, 9, 7), (7, 3, 5), (8, 9, 5))]
    put(spark, tmp_path, "registry_polls", polls, "run_id long, polled_at timestamp_ntz, load_counter long, setup_id long, outcome string")
    np = lambda c: f"https://np.example.org/RA{c * 43}"
    feed = [(7, np("a"), 1, 0), (7, np("b"), 2, 0), (7, np("b"), 2, 5), (7, np("a"), 4, 3), (7, None, 3, 0), (5, np("a"), 1, 6), (5, np("c"), 2, 6), (5, np("c"), 4, 6)]
    folder = put(spark, tmp_path, "window_feed", [(k, s, c, n, day(t)) for k, (s, c, n, t) in enumerate(feed)], "feed_id long, setup_id long, np_id string, load_number long, arrived_at timestamp_ntz")
    changes = []

    def spy(*args):
        judged = classify(*args)
        changes.append({r.change: r.n for r in judged.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()})
        return judged

    classify = data.classify
    monkeypatch.setattr(data, "classify", spy)
    assert rows(data.p4_found(spark, folder)) == [(1, 1), (2, 2), (2, 3), (4, 4), (7, 2), (8, 4)]
    assert changes == [{"new": 2}, {"same": 2, "changed": 1}, {"changed": 1, "new": 2}]


def test_last30d_holds_thirty_days(spark, tmp_path):
    ages = [0, 5, 11, 29.5, 30, 30.5, 45]
    events = [(k, T0 - timedelta(days=a), 1, "view", 1.0, "{}") for k, a in enumerate(ages)]
    folder = put(spark, tmp_path, "events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    age = F.datediff(F.lit(T0.date()), "created")
    assert sorted(r[0] for r in reference.last30d(spark, folder).select(age).collect()) == [0, 5, 11, 30, 30]
    assert reference.last30d(spark, folder, days=10).count() == 2
    shards = {r.repo: r.n for r in reference.shard_fanout(spark, folder).collect()}
    assert shards["last30d"] == 5 and shards["meta"] == len(ages)


def test_rows_without_a_time_are_copies_of_others_only(spark, tmp_path):
    np = lambda c: f"https://np.example.org/RA{c * 43}"
    feed = [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 6), ("only", None), ("twice", None), ("twice", None), ("a", None), ("f", None), ("late", None), ("late", 6), ("b", 6)]
    names = {n: chr(ord("a") + k) for k, n in enumerate(dict.fromkeys(n for n, _ in feed))}
    schema = "feed_id long, setup_id long, np_id string, load_number long, arrived_at timestamp_ntz"
    for case, part in (("mixed", feed), ("undated", [(n, None) for n, _ in feed])):
        folder = put(spark, tmp_path / case, "window_feed", [(k, 1, np(names[n]), k + 1, T0 + timedelta(days=t) if t else None) for k, (n, t) in enumerate(part)], schema)
        got = sorted(r.feed_id for r in data.p5_found(spark, folder).collect())
        assert got == sorted(r[0] for r in connect(folder.removeprefix("file://")).sql(data_sql.SQL["p5_found"]).fetchall())
        assert case == "undated" or got == [8, 9, 10, 11, 13]


def test_checksums_that_are_not_base64_differ(spark, rows, tmp_path):
    values = {"null": ("abcde", None), "two": ("abcde", "fghij"), "same": ("ab*-=", " ab*+"), "half": ("abcde", A), "nulls": (None, " ")}
    folder = status(spark, tmp_path, {repo: ((1, a), (1, b)) for repo, (a, b) in values.items()})
    want = connect(folder.removeprefix("file://")).sql(data_sql.SQL["p3_found"]).fetchall()
    assert rows(data.p3_found(spark, folder)) == sorted(want) == [(repo, "checksum") for repo in ("half", "null", "two")]
