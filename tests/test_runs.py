"""Invariants of stored runs and of incremental maintenance, on the example with small tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark import load_run, run_pipeline
from provspark.functions.naming import PROV_PREFIX, SAMPLE_ID, source_name
from provspark.operators import audit, lineage, maintain
from provspark.operators.encoders import ColumnEncoders, HashedText, OneHot, StandardScaler, WordCount, chain
from provspark.operators.network import Trainer, logistic, mean_loss, perceptron
from provspark.operators.split import SPLIT, TEST, TRAIN
from provspark.plans import complaints
from provspark.plans.run import retrain_without_rows, summary
from provspark.sources import artifacts, synth
from provspark.sources.artifacts import compact, export_csv, file_references, purge, runs

IDS = [1, 3, 5, 7, 11]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return str(tmp_path_factory.mktemp("runs"))


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    return synth.write_example(spark.range(60).coalesce(1), str(tmp_path_factory.mktemp("example")))


def encoders():
    return ColumnEncoders([
        ("subject", HashedText(8), ["title"]),
        ("text", HashedText(8), ["text"]),
        ("length", chain(WordCount(), StandardScaler()), ["title"]),
        ("country", OneHot(unknown="ignore"), ["country"]),
    ])


def execute(spark, root, paths, dataprep=complaints.dataprep, **options):
    options = {"trainer": Trainer(epochs=3), **options}
    return run_pipeline(
        spark, "example", paths, dataprep, encoders, complaints.extract_label, root=root, **options
    )


@pytest.fixture(scope="module")
def stored(spark, root, paths):
    return execute(spark, root, paths)


@pytest.fixture
def run(stored):
    return stored.branch()


def as_dict(df, value):
    return {r[SAMPLE_ID]: r[value] for r in df.select(SAMPLE_ID, value).collect()}


def test_artifacts_of_a_run(spark, run, paths):
    n = run.relational().count()
    facts = summary(run)
    assert facts["test_samples"] == -(-n // 5) and facts["train_samples"] == n - facts["test_samples"]
    assert facts["num_features"] == run.model().layers[0][0].shape[0]
    assert run.relational(TRAIN).columns == ["title", "text", "bank", "country", "sentiment", "is_premium"]
    mails, people = source_name(paths["mails_path"]), source_name(paths["customers_path"])
    origins = {r["output_column"]: r["sources"] for r in run.column_provenance().collect()}
    assert origins == {
        "title": [f"{mails}.mail_subject"], "text": [f"{mails}.mail_text"], "sentiment": [f"{mails}.mail_text"],
        "bank": [f"{people}.bank"], "country": [f"{people}.country"], "is_premium": [f"{people}.level"],
    }
    assert run.samples().select(SAMPLE_ID).distinct().count() == n
    assert run.matrix().count() == n and run.scores().count() == facts["test_samples"]
    assert run.samples().join(run.matrix(), [SAMPLE_ID, SPLIT]).count() == n


def test_provenance_is_sound(run, paths):
    """Source rows found through provenance give the output row again."""
    people = {i: line.split(",") for i, line in enumerate(_lines(paths["customers_path"]))}
    mails = {i: line.split(",") for i, line in enumerate(_lines(paths["mails_path"]))}
    prov_m, prov_p = run.prov_of("mails_path"), run.prov_of("customers_path")
    rows = run.samples().collect()
    for row in rows:
        person, mail = people[row[prov_p]], mails[row[prov_m]]
        assert person[1] == mail[1] and row["bank"] == person[2] and row["country"] == person[3]
        assert row["title"] == mail[3].lower() and row["text"] == mail[4].lower()
        assert row["is_premium"] == (person[4] == "premium")
    expected = sum(people_row[3] in ("UK", "DE", "FR") for people_row in people.values()) * 10
    assert len(rows) == expected


def _lines(folder):
    import glob

    (part,) = glob.glob(f"{folder}/part-*")
    return open(part).read().splitlines()


def test_runs_are_registered_and_reload(spark, root, run):
    loaded = load_run(spark, "example", run.run_id, root=root, branch=run.branch_name)
    assert loaded.version == 0 and np.array_equal(loaded.model().flat, run.model().flat)
    assert loaded.document["num_features"] == run.document["num_features"]
    assert runs(spark, root).where(F.col("run_id") == run.run_id).count() >= 1
    with pytest.raises(ValueError):
        load_run(spark, "example", "unknown", root=root)
    with pytest.raises(ValueError):
        load_run(spark, "example", run.run_id, version=99, root=root)


def test_provenance_queries(run, paths):
    assert lineage.output_columns(run, "mails_path", "mail_text") == ["sentiment", "text"]
    assert lineage.output_columns(run, paths["customers_path"], "level") == ["is_premium"]
    assert lineage.feature_ranges(run, ["title"]) == [(0, 8), (16, 17)]
    assert lineage.feature_ranges(run, ["country"]) == [(17, run.document["num_features"])]
    assert lineage.feature_ranges(run, ["bank"]) == []
    train = lineage.train_rows_originating_from(run, "customers_path", IDS).count()
    test = lineage.test_rows_originating_from(run, "customers_path", IDS).count()
    prov = run.prov_of("customers_path")
    assert train + test == run.samples().where(F.col(prov).isin(IDS)).count() > 0
    with pytest.raises(ValueError):
        run.prov_of("elsewhere")


def test_feature_deletion_touches_exactly_the_impact(run):
    after = maintain.delete_features(run, "mails_path", "mail_subject", "customers_path", IDS)
    prov = run.prov_of("customers_path")
    before = {r[SAMPLE_ID]: r.asDict() for r in run.samples().collect()}
    for row in after.samples().collect():
        old = before.pop(row[SAMPLE_ID])
        expected = {**old, "title": None} if row[prov] in IDS else old
        assert row.asDict() == expected
    assert not before
    ids = as_dict(run.samples(), prov)
    old, new = as_dict(run.matrix(), "features"), as_dict(after.matrix(), "features")
    assert old.keys() == new.keys()
    for key, vector in old.items():
        if ids[key] in IDS:
            vector = [0.0 if i < 8 or i == 16 else x for i, x in enumerate(vector)]
        assert new[key] == vector
    assert as_dict(after.matrix(), "label") == as_dict(run.matrix(), "label")


def test_feature_unlearning_by_hand(run):
    after = maintain.delete_features(run, "mails_path", "mail_subject", "customers_path", IDS)
    prov = run.prov_of("customers_path")
    rows = run.matrix(TRAIN).where(F.col(prov).isin(IDS)).collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    z = x.copy()
    z[:, 0:8] = 0
    z[:, 16] = 0
    model = run.model()
    expected = model.flat - (model.gradient_sum(z, y) - model.gradient_sum(x, y)) / len(y)
    assert np.allclose(after.model().flat, expected)


def test_deletions_repeat_commute_and_chain(run):
    twice = maintain.delete_features(
        maintain.delete_features(run, "mails_path", "mail_subject", "customers_path", [1, 3]),
        "mails_path", "mail_subject", "customers_path", [5, 7, 11],
    )
    swapped = maintain.delete_features(
        maintain.delete_features(run.branch(), "mails_path", "mail_subject", "customers_path", [11, 5, 7]),
        "mails_path", "mail_subject", "customers_path", [3, 1],
    )
    once = maintain.delete_features(run.branch(), "mails_path", "mail_subject", "customers_path", IDS)
    again = maintain.delete_features(once, "mails_path", "mail_subject", "customers_path", IDS)
    for other in (swapped, once, again):
        assert twice.samples().exceptAll(other.samples()).count() == 0
        assert as_dict(twice.matrix(), "features") == as_dict(other.matrix(), "features")
    assert (twice.version, once.version, again.version) == (2, 1, 2)
    assert np.allclose(again.model().flat, once.model().flat)  # nothing left to unlearn


def test_instance_deletion_equals_a_rerun_without_the_rows(spark, root, paths):
    first = execute(spark, root, paths, split="hash", trainer=None)
    maintained = maintain.delete_instances(first, "customers_path", IDS)
    alias = first.alias_of("customers_path")
    rerun = execute(
        spark, root, paths, retrain_without_rows(complaints.dataprep, alias, IDS), split="hash", trainer=None
    )
    assert maintained.samples().exceptAll(rerun.samples()).count() == 0
    assert rerun.samples().exceptAll(maintained.samples()).count() == 0
    assert as_dict(maintained.matrix(), "label") == as_dict(rerun.matrix(), "label")


def test_instance_unlearning_raises_the_loss_of_the_removed(spark, root, paths):
    base = execute(spark, root, paths, create_network=logistic, trainer=Trainer(epochs=5, learning_rate=0.05))
    prov = base.prov_of("customers_path")
    removed = base.matrix(TRAIN).where(F.col(prov).isin(IDS))
    before = mean_loss(removed, base.model()).first()["loss"]
    for rate in (0.1, 1.0, 10.0):
        after = maintain.delete_instances(base.branch(), "customers_path", IDS, rate=rate)
        assert mean_loss(removed, after.model()).first()["loss"] > before
    other = maintain.delete_instances(base.branch(), "customers_path", IDS, rate=0.1, sign=-1)
    assert mean_loss(removed, other.model()).first()["loss"] < before


def test_empty_and_unmatched_requests_change_nothing(spark, run):
    for ids in ([], [10**9], spark.createDataFrame([], "i long")):
        same = maintain.delete_features(run, "mails_path", "mail_subject", "customers_path", ids)
        assert np.array_equal(same.model().flat, run.model().flat)
        assert run.samples().exceptAll(same.samples()).count() == 0
        gone = maintain.delete_instances(run, "customers_path", ids)
        assert np.array_equal(gone.model().flat, run.model().flat)
        assert gone.matrix().count() == run.matrix().count()


def test_large_requests(spark, run, monkeypatch):
    """Beyond all size limits the same rows are found by shuffles."""
    from provspark.operators import frame, sizing

    expected = maintain.delete_instances(run.branch(), "customers_path", IDS).samples()
    monkeypatch.setattr(frame, "LITERAL_IDS", 1)
    monkeypatch.setattr(sizing.broadcast_if_small, "__defaults__", (None, 0))
    request = spark.createDataFrame([(i,) for i in IDS], "i long")
    slow = maintain.delete_instances(run, "customers_path", request).samples()
    assert expected.exceptAll(slow).count() == 0 == slow.exceptAll(expected).count()


def files_with(table, prov, ids):
    """Files that hold a row of the given source rows, by reading all of them."""
    df = table.spark.read.schema(table.schema).option("recursiveFileLookup", True).parquet(*[f"{table.root}/{r.file}" for r in table.files().collect()])
    return {r[0] for r in df.where(F.col(prov).isin(ids)).select(artifacts.relative_file()).distinct().collect()}


@pytest.mark.parametrize("literal, cluster_by", [(1000, None), (1, "customers_path")])
def test_only_files_with_hits_are_opened_and_replaced(spark, root, paths, monkeypatch, literal, cluster_by):
    """For short lists and for requests that are tables, clustered or not."""
    from provspark.operators import frame
    from provspark.sources import tables

    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        run = execute(spark, root, paths, trainer=None, cluster_by=cluster_by)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    prov = run.prov_of("customers_path")
    opened = []
    read = tables.FileTable._read
    monkeypatch.setattr(tables.FileTable, "_read", lambda self, files: opened.append({r.file for r in files}) or read(self, files))
    monkeypatch.setattr(frame, "LITERAL_IDS", literal)
    for ids in ([3], [1, 5, 7]):
        before = {name: {r.file for r in t.files().collect()} for name, t in run.tables.items()}
        hit = {name: files_with(t, prov, ids) for name, t in run.tables.items()}
        opened.clear()
        after = maintain.delete_instances(run, "customers_path", spark.createDataFrame([(i,) for i in ids], "i long"))
        assert set().union(*opened) == set().union(*hit.values())
        for name, table in after.tables.items():
            now = {r.file for r in table.files().collect()}
            assert before[name] - now == hit[name]
            assert not files_with(table, prov, ids)
        if cluster_by:
            assert len(hit["relational"]) <= len(ids) < len(before["relational"])
        run = after


def raw_texts(folder):
    """All text below a folder, whatever the format of its files."""
    import glob

    import pyarrow.parquet as pq

    out = []
    for name in glob.glob(f"{folder}/**/*", recursive=True):
        if name.endswith(".parquet") and os.path.isfile(name):
            out.append(str(pq.ParquetFile(name).read().to_pydict()))
        elif os.path.isfile(name):
            out.append(open(name, "rb").read().decode("utf-8", "replace"))
    return "\n".join(out)


def test_purge_leaves_no_deleted_text(spark, tmp_path, monkeypatch):
    from provspark.operators import storage

    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path / "shared"))
    paths = synth.write_example(spark.range(30).coalesce(1), str(tmp_path / "sources"))
    mails = PROV_PREFIX + source_name(paths["mails_path"])
    used = sorted(r[0] for r in complaints.dataprep(spark, **paths).df.select(mails).collect())
    (gone, emptied, *_), unique = used, lambda t: f"secret{t}"
    # Texts that occur once: write them into the source by hand, then run again.
    import glob

    (part,) = glob.glob(f"{paths['mails_path']}/part-*")
    lines = open(part).read().splitlines()
    for i in (gone, emptied):
        fields = lines[i].split(",")
        lines[i] = ",".join([*fields[:3], fields[3] + " " + unique(i), fields[4] + " body" + unique(i)])
    with open(part, "w") as file:
        file.write("\n".join(lines) + "\n")
    for name in glob.glob(f"{paths['mails_path']}/.*.crc"):
        os.unlink(name)
    run = execute(spark, str(tmp_path / "root2"), paths, trainer=None)
    other = run.branch("other")
    after = maintain.delete_features(maintain.delete_instances(run, "mails_path", [gone]), "mails_path", "mail_subject", "mails_path", [emptied])
    after = compact(after)
    for folder in ("root2", "shared"):
        assert unique(gone) in raw_texts(tmp_path / folder)
    expected = sorted(map(str, after.samples().collect()))
    purge(after)
    for folder in ("root2", "shared"):
        there = raw_texts(tmp_path / folder)
        assert unique(gone) not in there and f" {unique(emptied)}" not in there
    assert f"body{unique(emptied)}" in raw_texts(tmp_path / "root2")
    again = load_run(spark, "example", run.run_id, root=run.root)
    assert again.version == after.version and sorted(map(str, again.samples().collect())) == expected
    assert again.matrix().count() == again.samples().count() and again.model().flat.size and again.scores().count() > 0
    assert {r.versions for r in file_references(again).collect()} == {1}
    with pytest.raises(ValueError):
        load_run(spark, "example", run.run_id, root=run.root, branch=other.branch_name)
    latest = maintain.delete_instances(again, "mails_path", [emptied])
    assert latest.samples().count() == len(expected) - 1
    middle = compact(latest)
    purge(middle, keep=[again])
    for version, n in ((again.version, len(expected)), (middle.version, len(expected) - 1)):
        assert load_run(spark, "example", run.run_id, version=version, root=run.root).samples().count() == n
    with pytest.raises(ValueError):
        load_run(spark, "example", run.run_id, version=latest.version, root=run.root)


def test_purge_keeps_what_it_is_told_to(run):
    base = run.branch()
    kept = maintain.delete_instances(base, "customers_path", [1])
    after = maintain.delete_instances(kept, "customers_path", [3])
    counts = {r.file: r.versions for r in file_references(after).collect()}
    assert max(counts.values()) > 1


def test_batch_equals_the_calls_one_by_one(spark, run):
    asked = [("customers_path", i, "mails_path", "mail_subject") for i in (1, 3)]
    asked += [("mails_path", i, "customers_path", "country") for i in (0, 4, 13)]
    asked += [("customers_path", 3, "mails_path", "mail_text"), ("customers_path", 5, None, None), ("customers_path", None, None, None)]
    asked += [("mails_path", i, None, None) for i in (70, 10**9)]
    table = spark.createDataFrame(asked + asked[:3], "row_source string, row_id long, column_source string, column string")
    batch = maintain.delete_batch(run.branch(), table)
    single = run
    for source, i, column_source, column in asked:
        if i is None:
            continue
        if column is None:
            single = maintain.delete_instances(single, source, [i])
        else:
            single = maintain.delete_features(single, column_source, column, source, [i])
    assert batch.version == 1
    assert batch.samples().exceptAll(single.samples()).count() == 0 == single.samples().exceptAll(batch.samples()).count()
    assert as_dict(batch.matrix(), "features") == as_dict(single.matrix(), "features")
    assert as_dict(batch.scores(), "prediction") == as_dict(single.scores(), "prediction")
    bad = spark.createDataFrame([("customers_path", 1, "mails_path", "mail_subjekt")], table.schema)
    with pytest.raises(ValueError, match="mail_subjekt"):
        maintain.delete_batch(run, bad)
    empty = maintain.delete_batch(run.branch(), table.limit(0))
    assert empty.samples().count() == run.samples().count() and np.array_equal(empty.model().flat, run.model().flat)


def test_batch_unlearning_by_hand(spark, run):
    prov = run.prov_of("customers_path")
    request = [("customers_path", 1, "mails_path", "mail_subject"), ("customers_path", 3, None, None)]
    after = maintain.delete_batch(run, spark.createDataFrame(request, "row_source string, row_id long, column_source string, column string"))
    model = run.model()

    def data(i):
        rows = run.matrix(TRAIN).where(F.col(prov) == i).collect()
        return np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])

    people = [i for i in (1, 3) if len(data(i)[0])]
    expected = model.flat.copy()
    if 1 in people:
        x, y = data(1)
        z = x.copy()
        z[:, 0:8] = 0
        z[:, 16] = 0
        expected -= (model.gradient_sum(z, y) - model.gradient_sum(x, y)) / len(y)
    if 3 in people:
        x, y = data(3)
        expected += model.gradient_sum(x, y) / len(y)
    assert people and np.allclose(after.model().flat, expected)


def test_compaction_rescoring_export(spark, root, run, tmp_path):
    changed = maintain.delete_instances(
        maintain.delete_features(run, "mails_path", "mail_subject", "customers_path", [1, 3]), "customers_path", [5]
    )
    packed = compact(changed)
    assert changed.samples().exceptAll(packed.samples()).count() == 0
    assert as_dict(changed.matrix(), "features") == as_dict(packed.matrix(), "features")
    files = [{r.file for r in r_.relational_table.files().collect()} for r_ in (changed, packed)]
    assert not files[0] & files[1]
    fresh = maintain.rescore(changed)
    assert fresh.count() == changed.matrix(TEST).count()
    export_csv(changed.matrix(TRAIN), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == changed.matrix(TRAIN).count()


def test_two_deletions_on_one_base_are_both_in_effect(spark, root, run):
    one = maintain.delete_instances(run, "customers_path", [1])
    two = maintain.delete_instances(run, "customers_path", [3])
    assert (one.version, two.version) == (1, 2)
    prov = run.prov_of("customers_path")
    latest = load_run(spark, "example", run.run_id, root=root, branch=run.branch_name)
    assert latest.version == 2
    left = {r[0] for r in latest.samples().select(prov).distinct().collect()}
    assert left == {r[0] for r in run.samples().select(prov).distinct().collect()} - {1, 3}
    assert {r[0] for r in latest.matrix().select(prov).distinct().collect()} == left
    assert load_run(spark, "example", run.run_id, version=0, root=root, branch=run.branch_name).samples().count() == run.samples().count()


def test_deletions_at_the_same_time_are_all_in_effect(spark, root, run):
    from provspark.operators.storage import together

    together(*[lambda i=i: maintain.delete_instances(run, "customers_path", [i]) for i in IDS[:4]])
    latest = run.latest()
    assert latest.version == 4
    prov = run.prov_of("customers_path")
    assert not latest.samples().where(F.col(prov).isin(IDS[:4])).count()
    assert not latest.matrix().where(F.col(prov).isin(IDS[:4])).count()


def test_many_versions_are_looked_up_in_few_indexes(run, monkeypatch):
    from provspark.sources import tables

    monkeypatch.setattr(tables, "MOST_INDEXES", 2)
    prov, there, state = run.prov_of("customers_path"), {r[0] for r in run.samples().select(run.prov_of("customers_path")).distinct().collect()}, run
    for i in sorted(there)[:4]:
        state = maintain.delete_instances(state, "customers_path", [i])
        assert len(state.relational_table.index) <= 2
        there.discard(i)
        assert {r[0] for r in state.samples().select(prov).distinct().collect()} == there
        assert {r[0] for r in state.matrix().select(prov).distinct().collect()} == there
    assert len(compact(state).relational_table.index) == 1


def test_branches_do_not_see_each_other(run):
    other = run.branch()
    gone = maintain.delete_instances(run, "customers_path", [1])
    assert other.latest().samples().count() == run.samples().count() > gone.samples().count()


def test_exclusive_files(spark, tmp_path):
    from provspark.operators.storage import create_exclusive, together

    path = str(tmp_path / "a" / "one.json")
    assert sum(together(*[lambda i=i: create_exclusive(spark, path, str(i)) for i in range(8)])) == 1
    assert len(os.listdir(tmp_path / "a")) == 1


def test_fairness_and_usage(spark, run):
    scored = spark.createDataFrame(
        [("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("b", 1, 1), ("b", 1, 1), ("c", 0, 1)], "g string, label int, prediction int"
    )
    rates = {r["group"]: (r["positives"], r["fnr"]) for r in audit.false_negative_rates(scored, F.col("g")).collect()}
    assert rates == {"a": (2, 0.5), "b": (2, 0.0), "c": (0, None)}
    assert audit.equal_opportunity_gap(scored, F.col("g")).first()["gap"] == 0.5
    assert audit.accuracy(scored).first()["accuracy"] == pytest.approx(4 / 6)


def test_reserved_names_are_refused(spark, root, paths):
    def bad(spark, **p):
        return complaints.dataprep(spark, **p).rename({"title": "label"})

    with pytest.raises(ValueError, match="reserved"):
        execute(spark, root, paths, bad)


def test_perceptron_is_the_default(run):
    assert [w.shape for w, _ in run.model().layers] == [(run.document["num_features"], 64), (64, 1)]
    assert [w.shape for w, _ in perceptron(3).layers] == [(3, 64), (64, 1)]


def test_unknown_source_column_is_an_error(run, paths):
    with pytest.raises(ValueError, match="mail_subjekt"):
        maintain.delete_features(run, "mails_path", "mail_subjekt", "customers_path", [1])


def test_scores_of_deleted_samples_are_gone(run):
    alias = source_name(run.document["source_paths"]["mails_path"])
    ids = [r[0] for r in run.matrix(TEST).select(run.prov_of(alias)).distinct().limit(2).collect()]
    left = maintain.delete_instances(run, alias, ids)
    assert left.scores().count() == left.matrix(TEST).count() < run.scores().count()


def test_prediction_of_new_rows(spark, run):
    """The stored run gives its own test samples the scores it stored, and takes rows it has never seen."""
    rows = run.samples()
    done = run.predict(rows.select(SAMPLE_ID, SPLIT, *run.output_cols))
    stored = as_dict(run.scores(), "prediction")
    assert {k: v for k, v in as_dict(done, "prediction").items() if k in stored} == stored
    other = spark.createDataFrame([("a new title", "some text", "b", "XX", "positive", True)], "title string, text string, bank string, country string, sentiment string, is_premium boolean")
    (row,) = run.predict(other).collect()
    assert 0 < row.probability < 1 and row.title == "a new title"
    loaded = load_run(spark, "example", run.run_id, root=run.root, branch=run.branch_name)
    assert loaded.predict(other).first().probability == row.probability
    assert loaded.encoders(encoders()).width == run.document["num_features"]


def test_runs_with_wide_blocks(spark, root, paths):
    from provspark.operators.encoders import WideOneHot

    def wide(kind):
        parts = [("length", chain(WordCount(), StandardScaler()), ["title"]), ("bank", kind, ["bank"]), ("country", kind, ["country"])]
        return run_pipeline(
            spark, "wide", paths, complaints.dataprep, lambda: ColumnEncoders(parts), complaints.extract_label, root=root, trainer=Trainer(epochs=1),
            create_network=logistic,
        )

    sparse, dense = wide(WideOneHot(unknown="ignore")), wide(OneHot(unknown="ignore"))
    for change in (
        lambda r: maintain.delete_features(r, "customers_path", "bank", "customers_path", IDS), lambda r: maintain.delete_instances(r, "mails_path", [1, 2, 3]),
    ):
        a, b = change(sparse), change(dense)
        vectors = as_dict(b.matrix(), "features")
        for key, (positions, values) in as_dict(a.matrix(), "features").items():
            full = [0.0] * len(vectors[key])
            for p, v in zip(positions, values):
                full[p] = v
            assert full == vectors[key]
        assert np.allclose(a.model().flat, b.model().flat, atol=1e-6)
        sparse, dense = a, b
    assert sparse.version == 2 and np.allclose(
        [r.probability for r in sparse.predict(sparse.samples()).orderBy(SAMPLE_ID).collect()],
        [r.probability for r in dense.predict(dense.samples()).orderBy(SAMPLE_ID).collect()], atol=1e-6,
    )


def test_retraining_without_rows_of_an_unknown_source_is_an_error(spark, root, paths):
    with pytest.raises(ValueError, match="no scan of the preparation has the alias customer"):
        execute(spark, root, paths, retrain_without_rows(complaints.dataprep, "customer", IDS), trainer=None)


def test_index_is_sorted_as_numbers(spark, tmp_path):
    from provspark.sources import tables

    rows = spark.range(20, numPartitions=2).select(F.col("id").alias("__prov_b"), F.when(F.col("id") > 3, F.col("id") % 3).alias("__prov_a"))
    written = {n: tables.write_files(rows, str(tmp_path), n) for n in ("two", "one")}
    files, pairs, kinds = tables._listed(spark, str(tmp_path), written, {"one": (), "two": ()})
    assert dict(pairs.dtypes) == {"kind": "int", "id": "bigint", "place": "bigint"}
    assert kinds == [("one", "__prov_a"), ("one", "__prov_b"), ("two", "__prov_a"), ("two", "__prov_b")]
    assert sorted((f.table, f.rows) for f in files) == [("one", 10), ("one", 10), ("two", 10), ("two", 10)]
    named = {tuple(r) for r in tables._named(pairs, files, kinds).collect()}
    wanted = set()
    for name, w in written.items():
        read = spark.read.parquet(f"{tmp_path}/{w.folder}").withColumn("file", tables.relative_file())
        wanted |= {(name, c, r[c], r["file"]) for r in read.collect() for c in ("__prov_a", "__prov_b") if r[c] is not None}
    assert named == wanted
