import pytest
from pyspark.sql import functions as F

from provspark import join, track


def frame(spark, rows, schema, alias):
    df = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], f"{schema}, pos long")
    return track(df.drop("pos").limit(0), alias, F.lit(0)) if not rows else _tracked(df, alias)


def _tracked(df, alias):
    tracked = track(df, alias, F.col("pos"))
    return tracked.select(*[c for c in tracked.columns if c != "pos"])


@pytest.fixture
def people(spark):
    rows = [("a@x", "UK", "premium"), ("b@x", "DE", "standard"), (None, "FR", "standard"), ("a@x", "US", "premium")]
    return frame(spark, rows, "email string, country string, level string", "people")


@pytest.fixture
def mails(spark):
    rows = [("a@x", "hello"), ("c@x", "none"), (None, "lost"), ("b@x", "two words")]
    return frame(spark, rows, "email string, text string", "mails")


def rows(f, order):
    return [tuple(r) for r in f.df.orderBy(order).collect()]


def test_filters(people):
    assert people.filter(F.col("country") == "UK").count() == 1
    assert people.filter("level = 'premium'").count() == 2
    bound = people.filter("array_contains(:wanted, country)", wanted=["UK", "DE", "FR"])
    assert bound.count() == 3 and bound.prov_cols == ("__prov_people",)
    by_python = people.filter(lambda c: c.str.startswith("U"), columns=["country"])
    assert sorted(r[0] for r in by_python.provenance().collect()) == [0, 3]
    with pytest.raises(ValueError):
        people.filter(lambda c: c)


def test_project_overwrites_and_tracks(people):
    flagged = people.project("is_premium", ["level"], F.col("level") == "premium")
    both = flagged.project("tag", ["is_premium", "country"], "concat(country, is_premium)")
    assert both.col_prov["is_premium"] == {"people.level"}
    assert both.col_prov["tag"] == {"people.level", "people.country"}
    changed = people.project("country", ["country"], lambda s: s.str.lower(), returns="string")
    assert [r[1] for r in rows(changed, "__prov_people")] == ["uk", "de", "fr", "us"]
    with pytest.raises(ValueError):
        people.project("__prov_people", ["level"], F.lit(1))
    with pytest.raises(ValueError):
        people.project("x", ["level"], lambda s: s)
    with pytest.raises(KeyError):
        people.project("x", ["unknown"], F.lit(1))


def test_select_rename_views(people):
    some = people[["email", "country"]].rename({"country": "place"})
    assert some.columns == ["email", "place"] and some.col_prov["place"] == {"people.country"}
    assert some.data().columns == ["email", "place"]
    assert some.provenance().columns == ["__prov_people"]
    with pytest.raises(ValueError):
        people.rename({"country": "email"})


def test_explode_keeps_keys_unique(mails):
    words = mails.explode("word", ["text"], F.split("text", " "))
    assert words.pos_cols == ("__pos_0",) and words.col_prov["word"] == {"mails.text"}
    again = words.explode("letter", ["word"], F.split("word", ""))
    keyed = again.with_sample_id()
    assert keyed.select("sample_id").distinct().count() == keyed.count() == len("hello" "none" "lost" "two" "words")


def test_join_multiplies_duplicates_and_skips_nulls(people, mails):
    joined = join(mails, people, left_on="email", right_on="email")
    assert joined.columns == ["email", "text", "country", "level"]
    pairs = sorted(tuple(r) for r in joined.provenance().collect())
    assert pairs == [(0, 0), (0, 3), (3, 1)]
    assert joined.col_prov["email"] == {"mails.email", "people.email"}
    other = mails.join(people.rename({"email": "address", "country": "text"}), "email", "address")
    assert other.columns == ["email", "text", "address", "text_r", "level"]
    assert other.col_prov["text_r"] == {"people.country"} and other.col_prov["address"] == {"people.email"}
    both = people.join(people, ["email", "country"], ["email", "country"])
    assert both.columns == ["email", "country", "level", "level_r"] and both.count() == 3
    third = joined.join(people, "email", "email")
    assert third.prov_cols == ("__prov_mails", "__prov_people", "__prov_people_r")
    assert third.col_prov["level_r"] == {"people_r.level"}
    null_safe = mails.join(people, "email", "email", null_safe=True)
    assert sorted(tuple(r) for r in null_safe.provenance().collect()) == [(0, 0), (0, 3), (2, 2), (3, 1)]


def test_salted_join_is_the_same_join(people, mails):
    for null_safe in (False, True):
        plain = mails.join(people, "email", "email", null_safe=null_safe)
        salted = mails.join(people, "email", "email", null_safe=null_safe, salt=5)
        assert plain.df.columns == salted.df.columns
        assert plain.df.exceptAll(salted.df).count() == 0 == salted.df.exceptAll(plain.df).count()


def test_join_with_the_last_row_per_key(people, mails):
    joined = mails.join_latest(people, "email", "email")
    assert sorted(tuple(r) for r in joined.provenance().collect()) == [(0, 3), (3, 1)]


def test_self_join_gets_its_own_provenance(people):
    joined = people.join(people, "email", "email")
    assert joined.col_prov["level"] == {"people.level"} and joined.col_prov["level_r"] == {"people_r.level"}
    assert joined.col_prov["email"] == {"people.email", "people_r.email"}
    assert joined.prov_cols == ("__prov_people", "__prov_people_r")
    assert sorted(tuple(r) for r in joined.provenance().collect()) == [(0, 0), (0, 3), (1, 1), (3, 0), (3, 3)]


def test_rows_by_source_ids(spark, people):
    for ids in ([1, 3], spark.createDataFrame([(1,), (3,), (3,)], "i int"), range(1, 4, 2)):
        assert sorted(r[0] for r in people.originating_from("people", ids).provenance().collect()) == [1, 3]
        assert sorted(r[0] for r in people.not_originating_from("people", ids).provenance().collect()) == [0, 2]
    assert people.originating_from("people", []).count() == 0
    assert people.not_originating_from("people", []).count() == 4
    many = list(range(1, 5000))
    assert people.originating_from("people", many).count() == 3
    assert people.not_originating_from("people", many).count() == 1
    with pytest.raises(ValueError):
        people.originating_from("nobody", [1])


def test_hot_key_holds_a_third_of_the_rows(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    left = track(left, "left", F.col("id")).select("k")
    right = track(spark.range(30_000).select(F.col("id").alias("k2")), "right", F.col("k2"))
    expected = left.join(right, "k", "k2").count()
    assert expected == 30_000 == left.join(right, "k", "k2", salt=16).count()
    last = left.latest_by("k").df.where("k = 7").first()
    assert last["__prov_left"] == 29_997


def test_filter_reaches_the_scan_and_columns_are_pruned(spark, tmp_path):
    from provspark import read_parquet

    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 3 AS k", "'wide' AS pad").coalesce(1).write.parquet(path)
    narrow = read_parquet(spark, path, alias="t").filter("k = 1").project("d", ["id"], "id * 2")["d"]
    plan = narrow.df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,1)" in plan and "pad" not in plan.split("ReadSchema")[1]
    assert [r[0] for r in narrow.provenance().orderBy("__prov_t").limit(3).collect()] == [1, 4, 7]


def test_names_can_be_swapped(people):
    swapped = people.rename({"email": "country", "country": "email"})
    assert swapped.data().columns.count("email") == 1 and swapped.col_prov["email"] == people.col_prov["country"]
    row, before = swapped.df.first(), people.df.first()
    assert (row["email"], row["country"]) == (before["country"], before["email"])
    with pytest.raises(ValueError):
        people.rename({"country": "EMAIL"})


def test_names_that_differ_in_case_collide(people):
    other = people.rename({"country": "Country"})
    joined = people.join(other, "email", "email")
    assert joined.select("country", "Country_r").count() == joined.count()


def test_undeclared_columns_are_refused(people):
    with pytest.raises(ValueError, match="country"):
        people.project("both", ["email"], F.concat("email", "country"))


def test_null_ids_name_no_row(spark, people):
    prov = people.prov_cols[0]
    alias = prov[len("__prov_"):]
    for ids in ([0, None], spark.createDataFrame([(0,), (None,)], "id long"), [None, 0, *range(10**6, 10**6 + 2000)]):
        assert people.originating_from(alias, ids).count() == 1
        assert people.not_originating_from(alias, ids).count() == people.count() - 1


def test_last_row_per_key_sorts_nothing_wide(people):
    plan = people.latest_by("email").df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_salted_join_holds_no_copies_in_a_task(people, mails):
    plan = mails.join(people, "email", "email", salt=5).df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
