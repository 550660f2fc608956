import csv
import datetime
import io
import os
import random
import shutil
import zlib

import pytest
from pyspark.sql import functions as F

from provspark import read_csv, read_lines, read_parquet, read_tsv
from provspark.functions.naming import normalise_path, source_name, source_name_of
from provspark.functions.text import parse_date
from provspark.sources import synth
from provspark.sources.readers import FILE_BITS, file_registry, scans_without, write_tsv


@pytest.fixture
def small_splits(spark):
    """Make the scans cut files into splits of a few hundred bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_csv_positions_across_many_splits(spark, tmp_path, small_splits):
    path = tmp_path / "numbers.csv"
    path.write_text("".join(f"{i},{'x' * (i % 17)}\n" for i in range(2000)))
    frame = read_csv(spark, str(path), "n long, pad string", alias="numbers")
    assert frame.df.select(F.count_if(F.col("n") != F.col("__prov_numbers"))).first()[0] == 0
    assert frame.count() == len(frame) == 2000
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20


def test_csv_positions_in_a_folder_of_files(spark, write_lines, small_splits):
    path = write_lines(a=[f"a,{i}" for i in range(300)], b=[f"b,{i}" for i in range(500)], c=["c,0"])
    frame = read_csv(spark, path, "f string, n long", alias="s")
    ordinal = F.when(F.col("f") == "a", 0).when(F.col("f") == "b", 1).otherwise(2).cast("long")
    wrong = F.col("__prov_s") != F.col("n") + F.shiftleft(ordinal, FILE_BITS)
    assert frame.df.where(wrong).count() == 0
    assert frame.count() == 801


def test_parquet_positions_in_a_folder_of_files(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(0, 1000, 1, 5).write.parquet(path)
    rows = read_parquet(spark, path, alias="p").df.collect()
    ordinals = {row["id"] // 200 for row in rows}
    assert ordinals == set(range(5))
    assert all(row["__prov_p"] == (row["id"] // 200 << FILE_BITS) + row["id"] % 200 for row in rows)


def test_null_tokens_types_and_ragged_lines(spark, write_lines):
    path = write_lines(x=["1,NA,", "2,DE,7", "3", "4,'q',8"])
    rows = read_csv(spark, path, "id long, country string, n int", alias="x").data().orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, None, None), (2, "DE", 7), (3, None, None), (4, "'q'", 8)]
    kept = read_csv(spark, path, ["id", "country", "n"], na_values=(), alias="x").data().orderBy("id").collect()
    assert tuple(kept[0]) == ("1", "NA", "")


def test_quoted_fields(spark, write_lines):
    path = write_lines(x=['"a, b","say ""yes"""'])
    assert tuple(read_csv(spark, path, ["p", "q"]).data().first()) == ("a, b", 'say "yes"')


def test_misfit_value_raises(spark, write_lines):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv(spark, write_lines(x=["one"]), "id long").count()


def test_lines_with_a_wrong_field_count(spark, write_lines):
    frame = read_lines(spark, write_lines(x=["a,b ", " c", "d,e,f"]), ["p", "q"], alias="x")
    rows = frame.df.orderBy("__prov_x").collect()
    assert [tuple(r) for r in rows] == [("a", "b", False, None, 0), ("c", None, True, " c", 1), ("d", "e", True, "d,e,f", 2)]
    wrong = frame.filter("_field_count_error").select("_line")
    assert wrong.count() == 2 and wrong.col_prov == {"_line": frozenset({"x._line"})}


def test_records_over_several_lines(spark, write_lines):
    path = write_lines(x=["1,one", '2,"two', 'lines"', "3,three"])
    rows = read_csv(spark, path, "id long, t string", alias="x").df.orderBy("__prov_x").collect()
    assert [tuple(r) for r in rows] == [(1, "one", 0), (2, "two\nlines", 1), (3, "three", 2)]


def as_csv(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_across_splits(spark, tmp_path, small_splits, end):
    """Records of all lengths, some longer than many splits, against Python's CSV reader."""
    draw = random.Random(4)
    pieces = ["a", '"', ",", "\n", "\r\n", "word ", '""', "é", "\n\n", '",', ',"', " "]
    files = {}
    for name in ("b", "a", "c"):
        texts = ["".join(draw.choice(pieces) for _ in range(draw.choice([0, 1, 3, 10, 40, 400, 3000]) if draw.random() < 0.1 else draw.randint(0, 12))) for _ in range(150)]
        files[name] = [[name, str(i), t] for i, t in enumerate(texts)]
        (tmp_path / f"{name}.csv").write_bytes(as_csv(files[name], end).encode())
    frame = read_csv(spark, str(tmp_path), ["f", "n", "t"], alias="x", na_values=())
    found = {r["__prov_x"]: [r.f, r.n, r.t] for r in frame.df.collect()}
    expected = {(k << FILE_BITS) + i: row for k, name in enumerate(sorted(files)) for i, row in enumerate(files[name])}
    assert found == expected
    assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 20


def test_quotes_inside_plain_fields(spark, write_lines):
    path = write_lines(x=['1,a"b', '2,5" x 3"', '3,"q"', '4,"a""', 'b"', "", '5,"""x"""', '6,""', "7, \"y"])
    rows = read_csv(spark, path, "id long, t string", alias="x", na_values=()).df.orderBy("__prov_x").collect()
    assert [tuple(r) for r in rows] == [
        (1, 'a"b', 0), (2, '5" x 3"', 1), (3, "q", 2), (4, 'a"\nb', 3), (5, '"x"', 4), (6, "", 5), (7, ' "y', 6),
    ]


def test_a_quote_that_is_never_closed_is_an_error(spark, write_lines):
    with pytest.raises(ValueError, match="ends inside a quoted field"):
        read_csv(spark, write_lines(x=["1,one", '2,"two', "3,three"]), "id long, t string")


def test_header_with_line_breaks(spark, write_lines):
    path = write_lines(x=['id,"a', 'title"', '1,"x', 'y"', "2,z"])
    rows = read_csv(spark, path, "id long, t string", alias="x", header=True).df.orderBy("__prov_x").collect()
    assert [tuple(r) for r in rows] == [(1, "x\ny", 0), (2, "z", 1)]


def test_no_lines_landed_are_left(spark, write_lines, monkeypatch, tmp_path):
    from provspark.operators import storage

    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path / "shared"))
    read_csv(spark, write_lines(x=["1,a"]), "id long, t string")
    assert not [n for n in os.listdir(tmp_path / "shared" / "provspark") if n.startswith("lines-")]


@pytest.mark.parametrize("kind", ["csv", "lines", "parquet"])
def test_row_ids_stay_when_files_come(spark, tmp_path, kind):
    folder = tmp_path / "source"

    def add(name):
        if kind == "parquet":
            spark.createDataFrame([(name, str(i)) for i in range(5)], "f string, n string").coalesce(1).write.parquet(str(tmp_path / "new"))
            folder.mkdir(exist_ok=True)
            (part,) = (tmp_path / "new").glob("part-*")
            part.rename(folder / f"{name}.parquet")
            shutil.rmtree(tmp_path / "new")
        else:
            folder.mkdir(exist_ok=True)
            (folder / f"{name}.csv").write_text("".join(f"{name},{i}\n" for i in range(5)))

    def ids():
        with file_registry(str(tmp_path / "registry")):
            frame = {
                "csv": lambda: read_csv(spark, str(folder), ["f", "n"], alias="x"),
                "lines": lambda: read_lines(spark, str(folder), ["f", "n"], alias="x"),
                "parquet": lambda: read_parquet(spark, str(folder), alias="x"),
            }[kind]()
        return {(r.f, r.n): r["__prov_x"] for r in frame.df.collect()}

    add("m")
    first = ids()
    assert sorted(first.values()) == list(range(5))
    add("z")
    add("b")
    second = ids()
    assert {k: second[k] for k in first} == first and len(set(second.values())) == 15
    (name,) = folder.glob("b.*")
    name.rename(folder / name.name.replace("b.", "zz."))
    add("a")
    third = ids()
    assert {k: v for k, v in third.items() if k[0] in "mz"} == {k: v for k, v in second.items() if k[0] in "mz"}
    assert len(set(third.values())) == 20
    assert third == ids()


def test_registry_of_two_scans_at_the_same_time(spark, tmp_path):
    from provspark.operators.storage import together
    from provspark.sources.readers import registered_files

    found = together(*[lambda i=i: registered_files(spark, str(tmp_path), "x", ["a", f"b{i}"]) for i in range(4)])
    last = registered_files(spark, str(tmp_path), "x", [])
    assert sorted(last.values()) == list(range(5))
    assert all(one[f] == last[f] for one in found for f in one)


def test_too_many_fields_raise(spark, write_lines):
    with pytest.raises(Exception, match="more than 2 fields, from: EXTRA"):
        read_csv(spark, write_lines(x=["1,a", "2,b,EXTRA"]), "id long, t string").count()


def test_scans_can_leave_rows_out(spark, write_lines):
    path = write_lines(x=["a,old", "a,new", "b,only"])
    with scans_without("x", [1]):
        reduced = read_csv(spark, path, ["k", "v"], alias="x")
    assert {tuple(r) for r in reduced.latest_by("k").df.collect()} == {("a", "old", 0), ("b", "only", 2)}
    assert {r.v for r in read_csv(spark, path, ["k", "v"], alias="x").latest_by("k").df.collect()} == {"new", "only"}


def test_tsv_keeps_every_character(spark, tmp_path):
    data = [("a\tb\nc\\n\r\\", 1), (None, 2), ("", None), ("\\N", 4), ("a\x01b\\\\t\\\t", 5)]
    write_tsv(spark.createDataFrame(data, "s string, n int"), str(tmp_path / "t"))
    back = read_tsv(spark, str(tmp_path / "t"), "s string, n int").collect()
    assert {tuple(r) for r in back} == set(data)


def test_source_names(spark):
    assert source_name("data/customers.csv") == hex(zlib.crc32(b"data/customers.csv"))
    assert source_name("./data//customers.csv") == source_name("data/customers.csv")
    assert normalise_path("hdfs://nn:1/a//b/") == "hdfs://nn:1/a/b"
    paths = [f"p/{i}" for i in range(200)]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", source_name_of(F.col("p")).alias("n"))
    assert all(row["n"] == source_name(row["p"]) for row in df.collect())


def test_dates(spark):
    df = spark.createDataFrame([("2024-06-15",), ("15.06.2024",), (None,)], "s string")
    parsed = [r[0] for r in df.select(parse_date(F.col("s"), ["dd.MM.yyyy"])).collect()]
    assert parsed == [datetime.datetime(2024, 6, 15)] * 2 + [None]
    bad = spark.createDataFrame([("soon",)], "s string")
    assert bad.select(parse_date(F.col("s"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="unparsable date: soon"):
        bad.select(parse_date(F.col("s"))).collect()


def test_synthetic_tables_do_not_depend_on_the_layout(spark):
    one = synth.customers(spark.range(0, 3000, 1, 1))
    many = synth.customers(spark.range(0, 3000, 1, 13).repartition(7))
    assert one.exceptAll(many).count() == 0
    stats = one.agg(
        F.avg(F.col("country").isin("UK", "DE", "FR").cast("int")), F.avg((F.col("level") == "premium").cast("int"))
    ).first()
    assert 0.72 < stats[0] < 0.78 and 0.08 < stats[1] < 0.12
    mails = synth.mails(one)
    facts = mails.agg(
        F.count("*"), F.countDistinct("mail_id"), F.min("raw_date"), F.max("raw_date"),
        F.avg(F.col("mail_subject").rlike("^(Urgent|Please|Complaint)").cast("int")),
        F.count_if(F.col("mail_subject").rlike("credit card is [0-9]{16}$")),
    ).first()
    assert facts[0] == facts[1] == 30000
    assert facts[2] >= "2022-08-01" and facts[3] <= "2024-06-15"
    assert 0.38 < facts[4] < 0.42 and facts[5] > 0


def test_parts_of_a_folder_are_one_file(spark, tmp_path):
    for folder, files in (("a", ('1,"x\ny"\n2,z\n', "3,u\n")), ("b", ("4,v\n", '5,"\n"\n'))):
        (tmp_path / folder).mkdir()
        for i, text in enumerate(files):
            (tmp_path / folder / f"part-{i}.csv").write_text(text)
    scanned = read_csv(spark, f"{tmp_path}/*", "n long, t string", alias="s", na_values=(), parts=True)
    found = {r["n"]: (r["__prov_s"], r["t"]) for r in scanned.df.collect()}
    assert found == {1: (0, "x\ny"), 2: (1, "z"), 3: (2, "u"), 4: (1 << 40, "v"), 5: ((1 << 40) + 1, "\n")}
    with pytest.raises(ValueError, match="header"):
        read_csv(spark, str(tmp_path), ["n", "t"], header=True, parts=True)


def test_csv_of_a_language_is_written_by_several_tasks(spark, tmp_path):
    from provspark.plans import suite

    rows = [(i, f"{i}:" + "ab\nc " * 20, ["de", "en"][i % 2], 1) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suite, "new_folder", lambda s, kind: made.append(f"{tmp_path}/csv") or made[-1])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            done = suite.q_csv_breaks(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(f"{made[0]}/lang=de") if f.endswith(".csv")]) > 1
    assert {r.doc_id: r.prov_documents for r in done} == {i: ((i % 2) << 40) + i // 2 for i in range(400)}
