"""Readers, writers and streams: numbering, errors, restarts."""

import uuid

import pytest
from pyspark.sql import functions as F

from lawframe.operators import attempts, order, summary, voting
from lawframe.session import file_system, shared_folder
from lawframe.sources import io
from lawframe.sources.keyed import KeyedTable
from lawframe.streaming.latest import State, Totals, run_incremental_latest, run_incremental_summary

SCHEMA = "pair_id string, model string, seq long, bucket string"


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def _text(spark, path, *lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def test_lines_are_numbered_over_files(spark, folder):
    lines = [f"x{i} = y" if i % 7 else "" for i in range(1, 501)]
    spark.createDataFrame(list(enumerate(lines)), "i int, value string").repartitionByRange(5, "i").sortWithinPartitions("i").select("value").write.text(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # splits of files
    try:
        found = io.scan_equations(spark, folder).orderBy("law_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["law_no"], r["equation"]) for r in found] == list(enumerate(lines, 1))


def test_tree_digests_don_t_depend_on_splits(spark, folder):
    import hashlib

    lines = [bytes([65 + i % 26]) * (i % 40) + b"\xff\r"[: i % 3] for i in range(1, 701)]
    system, make = file_system(spark, folder)
    for name, end in (("a.txt", b"\n"), ("b.txt", b"")):
        out = system.create(make(f"{folder}/{name}"), True)
        out.write(bytearray(b"\n".join(lines) + end))
        out.close()
    sha = lambda parts: hashlib.sha256(b"".join(parts)).hexdigest()
    nodes = [sha([x + b"\n" for x in lines[i : i + 10]]) for i in range(0, 700, 10)]
    nodes = [sha([x.encode() for x in nodes[i : i + 10]]) for i in range(0, len(nodes), 10)]
    want = sha([x.encode() for x in nodes])
    for split in ("300", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            found = io.tree_digest(spark, f"{folder}/*.txt", fan=10, levels=2).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r["n_lines"], r["tree"]) for r in found] == [(700, want)] * 2
    told = {r["file"]: (r["bytes"], r["sha256"]) for r in io.content_digest(spark, f"{folder}/*.txt").collect()}
    raw = b"\n".join(lines)
    assert told == {"a.txt": (len(raw) + 1, sha([raw, b"\n"])), "b.txt": (len(raw), sha([raw]))}
    # one that is too large for a task has its size and no digest of its bytes
    told = {r["file"]: r["sha256"] for r in io.content_digest(spark, f"{folder}/*.txt", most=len(raw)).collect()}
    assert told == {"a.txt": None, "b.txt": sha([raw])}


def test_lists_fail_fast(spark, folder):
    _text(spark, f"{folder}/bad", "no equation", "x = y")
    with pytest.raises(ValueError, match="first line"):
        io.scan_equations(spark, f"{folder}/bad")
    spark.createDataFrame([], "value string").write.text(f"{folder}/empty")
    with pytest.raises(ValueError, match="no equations"):
        io.scan_equations(spark, f"{folder}/empty")
    _text(spark, f"{folder}/good", "x = y", "no equation")
    assert io.scan_equations(spark, f"{folder}/good").count() == 2


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("range"))
    found = order.numbered(rows.drop("range"), ["v"], "place").collect()
    assert sorted((r["v"], r["place"]) for r in found) == [(i, i + 1) for i in range(1000)]
    assert order.numbered(rows.limit(0).drop("range"), ["v"], "place").count() == 0


def test_corpus_keeps_one_record_per_key(spark, folder):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, v int")
    assert io.write_corpus(rows, F.col("k"), folder) == 0
    before = io.corpus_table(spark, folder)
    _, parts = before.parts()
    assert io.write_corpus(rows.where("k <> 'a'").withColumn("v", F.lit(2)), F.col("k"), folder) == 1
    told = lambda df: sorted((r["record_key"], r["row"]) for r in df.collect())
    made = lambda **v: [(k, f'{{"k":"{k}","v":{n}}}') for k, n in v.items()]
    assert told(io.corpus_table(spark, folder).rows()) == made(a=1, b=2, c=2)
    assert told(before.rows(parts)) == made(a=1, b=1, c=1)  # a reader of the former version still sees it whole


def test_of_two_writers_one_starts_again(spark, folder, monkeypatch):
    rows = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int")
    io.write_corpus(rows("a", 1), F.col("k"), folder)
    merged, overtaken = KeyedTable.merged, []

    def slow(self, *args):
        found = merged(self, *args)
        if not overtaken:  # another writer commits between this one's data and its manifest
            overtaken.append(1)
            io.write_corpus(rows("b", 2), F.col("k"), folder)
        return found

    monkeypatch.setattr(KeyedTable, "merged", slow)
    io.write_corpus(rows("c", 3), F.col("k"), folder)
    table = io.corpus_table(spark, folder)
    assert sorted(r["record_key"] for r in table.rows().collect()) == ["a", "b", "c"] and table.versions() == [0, 1, 2]


def test_a_writer_that_dies_leaves_the_former_version(spark, folder, monkeypatch):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    io.write_corpus(rows, F.col("k"), folder, most_rows=8)

    def die(*_args, **_options):
        raise RuntimeError("died")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "commit", die)
        with pytest.raises(RuntimeError):
            io.write_corpus(rows.withColumn("k", F.concat("k", F.lit("x"))), F.col("k"), folder, most_rows=8)
    table = io.corpus_table(spark, folder, most_rows=8)
    assert table.versions() == [0] and table.rows().count() == 50
    io.write_corpus(rows.withColumn("k", F.concat("k", F.lit("x"))), F.col("k"), folder, most_rows=8)
    assert table.rows().count() == 100 and max(n for _, n in table.parts()[1].values()) <= 8


def test_a_batch_is_in_the_log_once(spark, folder, monkeypatch):
    schema = "pair_id string, regime string"
    rows = spark.createDataFrame([("E1", "on"), ("E2", "off"), ("E 3/x", "a b=c")], schema)
    read = lambda: sorted(tuple(r) for r in io.read_results(spark, folder, schema).collect())
    assert read() == []
    assert io.write_results(rows, folder, ["regime"], batch="one") and not io.write_results(rows, folder, ["regime"], batch="one")
    assert read() == sorted(tuple(r) for r in rows.collect())

    def die(*_args, **_options):
        raise RuntimeError("died")

    with monkeypatch.context() as m:
        m.setattr(io, "put_text", die)  # between the data and the commit
        with pytest.raises(RuntimeError):
            io.write_results(rows, folder, ["regime"], batch="two")
    assert len(read()) == 3
    assert io.write_results(rows, folder, ["regime"], batch="two") and len(read()) == 6

    # two writers of one batch: the second finds the commit only when it wants to make its own
    with monkeypatch.context() as m:
        m.setattr(io, "names_in", lambda *_: [])
        assert not io.write_results(rows, folder, ["regime"], batch="two")
    assert len(read()) == 6
    done = io.read_results(spark, folder, schema).select("pair_id", F.lit("m").alias("model"), F.lit("exact").alias("bucket"))
    todo = attempts.pending_tasks(spark.createDataFrame([("E1",), ("E9",)], "pair_id string"), spark.createDataFrame([("m",)], "model string"), done)
    assert [tuple(r) for r in todo.collect()] == [("E9", "m")]


def test_runs_are_unique_by_key(spark):
    runs = [("story", "on", "r1"), ("story", "off", "r2")]
    df = lambda rows: spark.createDataFrame(rows, "form string, regime string, run string")
    assert attempts.discover_runs(df(runs), ["form", "regime"]).count() == 2
    with pytest.raises(ValueError, match="2 runs, r1 to r3"):
        attempts.discover_runs(df([*runs, ("story", "on", "r3")]), ["form", "regime"])
    with pytest.raises(ValueError, match="half"):
        attempts.discover_runs(df([("story", "half", "r1")]), ["form", "regime"])


def test_any_number_of_names_meets_all_rows(spark, monkeypatch):
    monkeypatch.setattr(attempts, "BLOCK", 3)
    names = spark.createDataFrame([(f"m{i}",) for i in range(10)] + [("m1",), (None,)], "model string")
    rows = spark.createDataFrame([("p1",), ("p2",)], "pair_id string")
    found = attempts.with_every(rows, names, "model").collect()
    assert sorted(tuple(r) for r in found) == sorted((p, f"m{i}") for p in ("p1", "p2") for i in range(10))
    assert attempts.with_every(rows, names.limit(0), "model").count() == 0


def test_consistency_of_passes(spark):
    samples = [(p, i, f"E{i}", f"h{i}") for p in ("a", "b", "c") for i in range(4)]
    meta = [(p, "1", None) for p in ("a", "b", "c", "d")]
    frames = lambda s, m: (spark.createDataFrame(s, "pass string, place int, pair_id string, prompt_hash string"), spark.createDataFrame(m, "pass string, seed string, form string"))
    keys = ("seed", "form")
    voting.check_consistency(*frames(samples, meta[:3]), keys)
    moved = [(p, i ^ 1 if p == "b" else i, e, h) for p, i, e, h in samples]
    found = {(r["pass"], r["differs"]): r["n"] for r in voting.pass_differences(*frames(moved, [("a", "1", None), ("b", "1", "x"), ("c", "2", None), ("d", "1", None)]), keys).collect()}
    assert found == {("b", "samples"): 8, ("b", "form"): 1, ("c", "seed"): 1, ("d", "samples"): 4}
    with pytest.raises(ValueError, match="pass b differs in samples"):
        voting.check_consistency(*frames(moved, meta[:3]), keys)


def _land(spark, path, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _run(spark, folder, after=None):
    schema = spark.createDataFrame([], SCHEMA).schema
    found = run_incremental_latest(spark, f"{folder}/in", schema, ["pair_id", "model"], f"{folder}/state", f"{folder}/offsets", after=after)
    return sorted((r["pair_id"] or "", r["seq"], r["bucket"]) for r in found.collect())


def test_restarts_find_the_state(spark, folder):
    _land(spark, f"{folder}/in", ("E1", "m", 1, "wrong"), ("E2", "m", 2, "exact"), (None, "m", 3, "wrong"))
    first = _run(spark, folder)
    assert first == [("", 3, "wrong"), ("E1", 1, "wrong"), ("E2", 2, "exact")]
    assert _run(spark, folder) == first  # without new files
    _land(spark, f"{folder}/in", ("E1", "m", 5, "exact"), ("E2", "m", 6, "api-error"))
    assert _run(spark, folder) == [("", 3, "wrong"), ("E1", 5, "exact"), ("E2", 2, "exact")]


def test_a_failed_batch_is_taken_again(spark, folder):
    _land(spark, f"{folder}/in", ("E1", "m", 1, "wrong"))
    _run(spark, folder)
    _land(spark, f"{folder}/in", ("E1", "m", 2, "exact"), ("E3", "m", 3, "exact"))

    def fail(number, former, now):
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        _run(spark, folder, after=fail)
    assert _run(spark, folder) == [("E1", 2, "exact"), ("E3", 3, "exact")]


def _state(spark, folder, most_rows):
    return State(spark, folder, spark.createDataFrame([], SCHEMA).schema, ["pair_id", "model"], most_rows)


def test_parts_split_as_the_state_grows(spark, folder):
    state = _state(spark, folder, 10)
    rows = lambda low, high: spark.createDataFrame([(f"E{i}", "m", i, "wrong") for i in range(low, high)], SCHEMA)
    for number, (low, high) in enumerate([(0, 5), (5, 40), (40, 500)]):  # a hundred times its first size
        state.merge(rows(low, high), number)
        _, parts = state.table.parts()
        assert max(n for _, n in parts.values()) <= 10 and sum(n for _, n in parts.values()) == high
        assert sum(2.0 ** -len(p) for p in parts) == 1.0  # each key is in one part
    assert state.rows().count() == 500 and len(parts) > 50
    former, now = state.merge(rows(7, 8).withColumn("seq", F.lit(999).cast("long")), 3)
    # a key's batch reads and writes one part, however large the state is
    assert len(former) == len(now) == 1
    after = state.table.parts()[1]
    assert {p for p in parts if parts[p] != after[p]} == set(now)
    assert state.rows().where("pair_id = 'E7'").first()["seq"] == 999
    state.merge(rows(7, 8).withColumn("seq", F.lit(999).cast("long")), 3)  # the same batch again
    assert state.rows().count() == 500 and state.table.versions() == [2, 3]


def test_a_restart_in_the_middle_of_a_split(spark, folder, monkeypatch):
    state = _state(spark, folder, 4)
    rows = lambda n: spark.createDataFrame([(f"E{i}", "m", i, "wrong") for i in range(n)], SCHEMA)
    state.merge(rows(4), 0)

    def die(*_args, **_options):
        raise RuntimeError("died")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "commit", die)
        with pytest.raises(RuntimeError):
            state.merge(rows(30), 1)
    again = _state(spark, folder, 4)
    assert again.rows().count() == 4 and again.table.parts()[1].keys() == {""}
    again.merge(rows(30), 1)
    assert again.rows().count() == 30 and "" not in again.table.parts()[1]


def test_summaries_follow_corrections(spark, folder):
    """Equal to a recompute from the state after every batch; the totals' size doesn't depend on the state's."""
    import random

    draw = random.Random(4)
    schema = "pair_id string, model string, seq long, bucket string, response string, reasoning_tokens int"
    models = spark.createDataFrame([("m0",), ("m1",), ("m9",)], "model string")
    kinds = ["exact", "wrong", "api-error", "unparseable", "correct-swapped"]
    seq = 0
    for _ in range(4):
        rows = []
        for _ in range(60):
            seq += 1
            rows.append((f"E{draw.randrange(25)}", f"m{draw.randrange(2)}", seq, draw.choice(kinds), draw.choice([None, "", "a", "abc"]), draw.choice([None, 0, 5, 8])))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        kind = spark.createDataFrame([], schema).schema
        told = run_incremental_summary(spark, f"{folder}/in", kind, ["pair_id", "model"], f"{folder}/state", f"{folder}/offsets", models, most_rows=6)
        state = State(spark, f"{folder}/state", kind, ["pair_id", "model"]).rows()
        want = summary.model_summary(state, models)
        assert sorted(map(tuple, told.collect()), key=str) == sorted(map(tuple, want.select(*told.columns).collect()), key=str)
    totals = Totals(spark, f"{folder}/state/totals")
    assert totals.rows().count() <= 2 * (5 + 2 + 2) and len(totals.batches()) == 2
    assert totals.rows().where("n <= 0").isEmpty()


def test_scratch_folders_can_be_cleared(spark):
    from lawframe.session import clear_scratch, names_in, scratch_folder

    clear_scratch(spark)
    folders = [scratch_folder(spark, "test") for _ in range(2)]
    for path in folders:
        spark.range(3).write.parquet(path)
    assert clear_scratch(spark) == 2 and clear_scratch(spark) == 0
    assert all(names_in(spark, path) == [] for path in folders)


def test_tasks_of_a_written_corpus_are_bounded(spark, folder, monkeypatch):
    """A task writes a bounded number of rows, however many its part has; the parts stay whole."""
    monkeypatch.setattr("lawframe.sources.keyed.ROWS_A_TASK", 500)
    for part in (spark.range(5000), spark.range(4000, 6000)):
        io.write_corpus(part.select(F.col("id").cast("string").alias("story")), F.col("story"), folder, most_rows=4000)
    rows = io.corpus_table(spark, folder, 4000).rows()
    assert sorted(int(r["record_key"]) for r in rows.collect()) == list(range(6000))
    assert max(r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()) <= 1500


def test_lists_are_written_by_many_tasks(spark, monkeypatch, duck):
    """Digests are those of SQL, whatever the number of tasks that write the lists."""
    from helpers import SF, same_rows

    from lawframe.plans import registry

    monkeypatch.setattr("lawframe.plans.io_queries.LISTED_A_TASK", 40)
    same_rows(registry.QUERIES["content_digest"](spark, SF), duck, registry.ORACLES["content_digest"])
