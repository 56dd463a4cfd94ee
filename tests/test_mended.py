"""Cases that SQL twins cannot show: borders, nulls, scopes and forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.operators import logs, ownership, quality, telemetry
from faultline.sources import lake

T0 = dt.datetime(2024, 1, 1)


def day(n, hour=0):
    return T0 + dt.timedelta(days=n, hours=hour)


def test_failed_run_is_judged_by_the_good_ones_before(spark):
    rows = [("t", day(k), k, "success", 10.0 + k) for k in range(4)] + [("t", day(4), 4, "failed", 50.0), ("t", day(5), 5, "success", 1.0)]
    runs = spark.createDataFrame(rows, "task string, ts timestamp, id int, state string, value double")
    got = {r.id: r for r in quality.success_baseline(runs, ["task"], "ts", "id", "value", n=3).collect()}
    assert len(got) == 6
    assert (got[4].base_n, got[4].base_mean, got[4].base_last) == (3, 12.0, 13.0)
    # The failure is no history for the run after it.
    assert (got[5].base_n, got[5].base_mean, got[0].base_n, got[0].base_mean) == (3, 12.0, 0, None)


def test_baseline_with_a_hot_key_and_null_keys(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), T0 + dt.timedelta(seconds=rng.randrange(9000) // 5 * 5), k, rng.choice(["success", "failed"]), rng.random())
            for k in range(800)]
    runs = spark.createDataFrame(rows, "task string, ts timestamp, id int, state string, value double")
    got = quality.success_baseline(runs, ["task"], "ts", "id", "value", n=4, chunk=10).collect()
    assert len(got) == 800
    for r in got:
        before = sorted((x for x in rows if x[0] == r.task and (x[1], x[2]) < (r.ts, r.id) and x[3] == "success"), key=lambda x: (x[1], x[2]))[-4:]
        assert r.base_n == len(before)
        assert (r.base_mean is None) == (not before)
        if before:
            assert r.base_mean == pytest.approx(sum(x[4] for x in before) / len(before))
            assert r.base_last == before[-1][4]


def test_empty_deliveries_do_not_lower_the_baseline(spark):
    counts = [100, 102, 98, 0, 0, 0, 40, 101]
    rows = [("d", day(k), k, c) for k, c in enumerate(counts)]
    table = spark.createDataFrame(rows, "feed string, ts timestamp, id int, rows int")
    verdicts = [r.verdict for r in quality.volume_contract(table, ["feed"], "ts", "id", n=5).orderBy("id").collect()]
    assert verdicts == ["OK", "OK", "OK", "ZERO_ROWS", "ZERO_ROWS", "ZERO_ROWS", "OUT_OF_RANGE", "OK"]
    # Two deliveries are too few to judge by.
    short = [r.verdict for r in quality.volume_contract(table.where("id IN (0, 1, 6)"), ["feed"], "ts", "id").collect()]
    assert short == ["OK"] * 3


def test_the_partition_waited_for_is_missing(spark):
    spans = spark.createDataFrame([("c", day(0, 6), day(3, 6))], "cluster string, first timestamp, until timestamp")
    expected = telemetry.partition_calendar(spans, ["cluster"], "first", "until", "1 day")
    present = spark.createDataFrame([("c", day(0, 7)), ("c", day(2, 5)), ("x", day(1))], "cluster string, ts timestamp")
    got = telemetry.missing_partitions(expected, present, ["cluster"], "ts").orderBy("part").collect()
    # 05:00 of day 2 still belongs to the partition of day 1.
    assert [(r.part, r.lag_seconds) for r in got] == [(day(2, 6), 86400), (day(3, 6), 2 * 86400)]
    none = telemetry.missing_partitions(expected, present.limit(0), ["cluster"], "ts").collect()
    assert len(none) == 4 and all(r.lag_seconds is None for r in none)


def test_metric_of_a_cluster_without_name_or_match(spark):
    rows = [("a", "m_used", 1), ("a", "z", 2), ("b", "q", 3), ("b", "p", 4), (None, "m_used", 5), (None, "a", 6)]
    metrics = spark.createDataFrame(rows, "cluster string, metric string, value int")
    assert sorted(r.value for r in telemetry.metric_pick(metrics, "used").collect()) == [1, 4, 5]


def test_manifest_scope(spark):
    nodes = spark.createDataFrame(
        [("p1", "r1", 0, "model.old_load_x", "p1/old.sql"), ("p1", "r2", 0, "model.b_load_x", "p1/b.sql"),
         ("p2", "r9", 0, "model.a_load_x", "p2/a.sql")],
        "project string, run_id string, ord int, node_id string, original_file_path string",
    )
    tasks = spark.createDataFrame([("load_x", None, "p1"), ("load_x", None, "p2")], "task_id string, hint string, project string")
    got = {r.project: r.node_path for r in ownership.manifest_match(tasks, nodes).collect()}
    assert got == {"p1": "p1/b.sql", "p2": "p2/a.sql"}
    anywhere = ownership.manifest_match(tasks.drop("project"), nodes).collect()
    assert [r.node_path for r in anywhere] == ["p1/b.sql"]


FORMS = [
    ("DB_PASSWORD=hunter2 x", "DB_PASSWORD=*** x"),
    ("access_token=abc,", "access_token=***,"),
    ("AWS_SECRET_ACCESS_KEY=wJa/lr+x y", "AWS_SECRET_ACCESS_KEY=*** y"),
    ('{"password": "hunter2", "a": 1}', '{"password": "***", "a": 1}'),
    ('{"client_secret":"a\\"b"}', '{"client_secret":"***"}'),
    ("api-key: 'a b'", "api-key: ***"),
    ("use ghp_16C7e42F292c6912E7 now", "use *** now"),
    ("xoxb-1234567890-abc ok", "*** ok"),
    ("Authorization: Basic dXNlcg==", "Authorization: Basic ***"),
    ("Bearer abc.def", "Bearer ***"),
    ("post https://hooks.chat.example/services/T/B/x end", "post https://hooks.chat.example/*** end"),
    ("a -----BEGIN PRIVATE KEY-----\nMII\n-----END PRIVATE KEY----- b", "a -----BEGIN PRIVATE KEY-----***-----END PRIVATE KEY----- b"),
    ("a -----BEGIN EC PRIVATE KEY-----\ncut off", "a -----BEGIN EC PRIVATE KEY-----***"),
    ("postgres://u:p@h/d", "postgres://u:***@h/d"),
    ("max_tokens=5 and a token of thanks", "max_tokens=5 and a token of thanks"),
    ("monkey=5 keyboard: x", "monkey=5 keyboard: x"),
    ("PGPASSWORD=x psql", "PGPASSWORD=*** psql"),
    ("dbpassword=x, b", "dbpassword=***, b"),
    ("clientSecret: x", "clientSecret: ***"),
    ("accessToken=x&y=1", "accessToken=***&y=1"),
    ("mysql --password x -h db", "mysql --password *** -h db"),
    ("run --api-key='a b' -q", "run --api-key=*** -q"),
    ("redis://:pw@host/0", "redis://:***@host/0"),
    ("jwt eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl end", "jwt *** end"),
    ("Cookie: session=x; theme=dark\nnext", "Cookie: ***\nnext"),
    ('{"Set-Cookie": "id=a; Path=/", "b": 1}', '{"Set-Cookie": "***", "b": 1}'),
    ("clone with glpat-abcdefghijk now", "clone with *** now"),
    ("sk_live_abcdefgh123 paid", "*** paid"),
    ("password:\n  hunter2\nnext", "password:\n  ***\nnext"),
    ("--password\n--next token", "--password\n--next token"),
    ("tokenizer=bpe secretary: Jo https://host/path?a=b", "tokenizer=bpe secretary: Jo https://host/path?a=b"),
    ("\n\n", "\n\n"),
]


@pytest.mark.parametrize("text, masked", FORMS)
def test_each_credential_form(spark, text, masked):
    frame = spark.createDataFrame([(text,)], "log_text string")
    assert logs.redact(frame).first().log_text == masked


def test_paths_and_prefixes(spark, tmp_path):
    folder = tmp_path / "repos" / "r" / "my models"
    folder.mkdir(parents=True)
    (folder / "a+b c%.sql").write_text("select 1")
    (tmp_path / "repos" / "r" / "dag_id=abc").mkdir()
    (tmp_path / "repos" / "r" / "dag_id=abc" / "x.sql").write_text("select 2")
    root = str(tmp_path / "repos")
    got = {r.file_path: r.content for r in lake.scan_repo_files(spark, root).collect()}
    assert got == {"my models/a+b c%.sql": "select 1", "dag_id=abc/x.sql": "select 2"}
    assert [r.key for r in lake.list_objects(spark, root, "r/dag_id=a").collect()] == ["r/dag_id=abc/x.sql"]
    assert [r.key for r in lake.list_objects(spark, root, "r/", 1).collect()] == ["r/dag_id=abc/x.sql"]
    assert F.col("x") is not None


def test_manifest_index_equals_plain_containment(spark):
    import random

    rng = random.Random(6)
    word = lambda a, b: "".join(rng.choices("abc_", k=rng.randint(a, b)))
    made = [(k, "model.p." + word(3, 30), None) for k in range(300)]
    asked = ["", "a", "b_", "zzz", "model.p.", "model.p.a", *[word(1, 8) for _ in range(150)]]
    nodes = spark.createDataFrame(made, "ord int, node_id string, original_file_path string")
    tasks = spark.createDataFrame([(t, None) for t in [*asked, None]], "task_id string, hint string")
    got = {r.task_id: r.node_id for r in ownership.manifest_match(tasks, nodes).collect()}
    want = {t: next((n for _, n, _ in made if t in n), None) for t in asked}
    assert got == {t: n for t, n in want.items() if n}


def test_common_grams_are_dealt_and_left_out(spark, monkeypatch):
    """No part of a gram holds many nodes, and words that all ids share are not moved at all."""
    monkeypatch.setattr(ownership, "COMMON_PART", 100)
    monkeypatch.setattr(ownership, "COMMON_NODES", 20)
    ids = [f"model.shop.load_{i}_d" for i in range(300)] + [None]
    nodes = spark.createDataFrame([(i, n, None) for i, n in enumerate(ids)], "ord int, node_id string, original_file_path string")
    names = [f"load_{i}" for i in (1, 7, 299, 300)] + ["load", "_d", "", "gone"]
    tasks = spark.createDataFrame([(n, None) for n in names], "task_id string, hint string")
    seen = []
    deal = ownership._dealt
    monkeypatch.setattr(ownership, "_dealt", lambda *a: seen.append(deal(*a)) or seen[0])
    got = {r.task_id: r.node_id for r in ownership.manifest_match(tasks, nodes).collect()}
    assert got == {t: next(n for n in ids if t in n) for t in names if any(t in n for n in ids if n)}
    dealt, asked = seen[0]
    held = {tuple(r)[:2]: r["count"] for r in dealt.groupBy("_gram", "_part").count().collect()}
    grams = {g for g, _ in held}
    # "load" is a task id of its own; "mode" is in every id and in no task id.
    assert "load" in grams and "mode" not in grams and "shop" not in grams
    size = max(20, sum(len({n[i:i + k] for i in range(len(n) - k + 1)}) for n in ids if n for k in (0, 2, 4)) / 100)
    assert max(held.values()) < 2 * size < 300
    assert asked.where("task_id = 'load'").count() > 1


def test_text_objects_stay_small(spark, tmp_path, monkeypatch):
    """Objects that are read whole do not grow with the rows of their folder."""
    monkeypatch.setattr(lake, "TEXT_ROWS", 100)
    rows = spark.range(1000).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"), F.lit("c").alias("cluster"))
    root = str(tmp_path / "logs")
    lake.write_lake(rows, root, ["cluster"], "text")
    texts = [r.value for r in spark.read.text(root, wholetext=True).collect()]
    assert max(t.count("\n") for t in texts) <= 100
    assert sorted(line for t in texts for line in t.splitlines()) == sorted(f"line {i}" for i in range(1000))


def test_few_folders_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Tasks keep a few objects of text or JSON open; more folders than that are sorted, and all rows arrive either way."""
    from pyspark.sql import DataFrameWriter

    rows = spark.range(3000).select(F.col("id").cast("string").alias("value"), (F.col("id") % 3).alias("k"), (F.col("id") % 100).alias("many"))
    before, seen, save = spark.conf.get(lake._WRITERS), [], DataFrameWriter.save
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, path: seen.append(spark.conf.get(lake._WRITERS)) or save(self, path))
    for key, fmt in (("k", "json"), ("many", "text"), ("k", "parquet")):
        root = str(tmp_path / fmt)
        lake.write_lake(rows.select("value", key), root, [key], fmt)
        got = spark.read.schema(f"value string, {key} long").format(fmt).load(root)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.select("value", key).collect()))
    assert seen == [str(lake.OPEN_OBJECTS)] * 2 + [before] and spark.conf.get(lake._WRITERS) == before
