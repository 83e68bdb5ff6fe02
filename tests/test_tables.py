"""Loading, cleaning, validation and profiling of small traffic tables with answers worked out by hand."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowguard.functions.constants import FLOW_FEATURES
from flowguard.operators import analytics, cleaning, profiling
from flowguard.sources import documents, flow_files, stores

DAY_1 = """ Destination Port, Flow Duration, Total Fwd Packets,Flow Bytes/s, Label
80,100,2,2000,BENIGN
443,200,4,4000,DDoS
80,150,3,inf,BENIGN
22,10,1,100,PortScan
443,300,5,,DDoS
80,100,2,2000,BENIGN
"""
DAY_2 = """ Destination Port, Flow Duration, Total Fwd Packets,Flow Bytes/s, Label
80,120,3,3000,BENIGN
21,5,1,50,PortScan
"""


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("days")
    (folder / "day1.csv").write_text(DAY_1)
    (folder / "day2.csv").write_text(DAY_2)
    (folder / "note.txt").write_text("not data")
    (folder / "deep").mkdir()
    (folder / "deep" / "day3.csv").write_text(DAY_2)
    return str(folder)


@pytest.fixture(scope="module")
def merged(spark, days):
    return flow_files.load_merged(spark, flow_files.scan_directory(spark, days))


def test_scan(spark, days, tmp_path):
    assert len(flow_files.scan_directory(spark, days)) == 2
    assert len(flow_files.find_csv_files(spark, days)) == 3
    with pytest.raises(ValueError):
        flow_files.find_csv_files(spark, f"{days}/note.txt")
    with pytest.raises(FileNotFoundError):
        flow_files.scan_directory(spark, str(tmp_path))


def test_strict_merge(merged):
    assert merged.columns == ["Destination Port", "Flow Duration", "Total Fwd Packets", "Flow Bytes/s", "Label"]
    assert merged.count() == 8


def test_mismatched_headers(spark):
    a, b = spark.createDataFrame([(1, 2), (3, 4)], "colA int, colB int"), spark.createDataFrame([(1, 2), (3, 4)], "colA int, colC int")
    with pytest.raises(ValueError, match="colB"):
        flow_files.strict_union([a, b])
    loose = flow_files.loose_union([a, b])
    assert loose.count() == 4 and loose.columns == ["colA", "colB", "colC"]


def test_raw_report(merged):
    numbers = cleaning.coerce_numbers(merged, "Label")
    report = {r["metric"]: r["value"] for r in profiling.validation_summary(numbers).collect()}
    assert report["duplicate_rows_count"] == 1 and report["infinite_values_count"] == 1
    assert report["missing_values_count"] == 1 and report["total_rows"] == 8


def test_cleaning(merged):
    cleaned = cleaning.clean_flows(merged)
    assert cleaned.count() == 7
    repaired = cleaned.where(F.col("`Flow Duration`").isin(150.0, 300.0)).select("`Flow Bytes/s`").collect()
    assert [r[0] for r in repaired] == [2000.0, 2000.0]
    assert {r["class"]: r["rows"] for r in profiling.class_distribution(cleaned, "Label").collect()} == {"BENIGN": 3, "DDoS": 2, "PortScan": 2}
    again = cleaning.clean_flows(cleaned)
    assert sorted(again.collect()) == sorted(cleaned.collect())


def test_all_null_column_and_strategies(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), (None, None)], "a double, b double")
    assert {tuple(r) for r in cleaning.impute(df, "median").collect()} == {(0.0, 1.0), (0.0, 4.0), (0.0, 2.5)}
    assert {tuple(r) for r in cleaning.impute(df, "other").collect()} == {(0.0, 1.0), (0.0, 4.0), (0.0, 0.0)}
    with pytest.raises(ValueError):
        cleaning.impute(df, "other", strict=True).collect()


def test_names_and_labels(spark):
    df = spark.createDataFrame([(" x ", 1)], " label string, n int")
    named = cleaning.strip_names(df)
    assert cleaning.resolve_label(named, "LABEL") == "label"
    with pytest.raises(ValueError):
        cleaning.resolve_label(named, "class", required=True)
    assert profiling.duplicate_names([" a", "a", "b"]) == ["a"]
    assert cleaning.metadata_columns(df.withColumn("_src", F.lit(1))) == (["_src"], ["label", "n"])


def test_align(spark):
    record = {"Destination Port": 80, "Total Length of Fwd Packets": 500, "Fwd Packet Length Max": 100, "Bwd Packet Length Max": 80, "Flow Bytes/s": 900}
    df = spark.createDataFrame([tuple(record.values()) + ("extra", float("nan"))] * 10, [*record, "other", "Idle Std"])
    aligned = cleaning.align_features(df)
    assert aligned.columns == FLOW_FEATURES
    row = aligned.first().asDict()
    assert {k: row[k] for k in record} == {k: float(v) for k, v in record.items()}
    assert sum(v == 0.0 for v in row.values()) == 15
    with pytest.raises(ValueError):
        cleaning.align_features(df.where("false"))


def test_request_defaults(spark):
    row = cleaning.fill_request_defaults(spark.createDataFrame([(None, 5.0)], "`Destination Port` double, `Flow Bytes/s` double")).first()
    assert row["Destination Port"] == 80.0 and row["Flow Bytes/s"] == 5.0 and row["Init_Win_bytes_forward"] == 8192.0


def test_duplicate_columns_need_every_row(spark):
    rows = [(float(i), float(i), float(i) if i != 9 else -1.0, None if i == 3 else float(i), i) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int")
    assert profiling.duplicate_columns(df) == [("a", "b"), ("a", "e")]


def test_profiles_of_awkward_columns(spark):
    df = spark.createDataFrame([(1.0, None, "x"), (1.0, None, "3"), (1.0, None, "3")], "one double, empty double, text string")
    flags = {r["feature"]: (r["is_constant"], r["is_low_variance"]) for r in profiling.constant_columns(df).collect()}
    assert flags == {"one": (True, False), "empty": (True, False), "text": (False, False)}
    stats = {r["feature"]: r for r in profiling.feature_statistics(df, ["one", "empty"]).collect()}
    assert stats["empty"]["mean"] == 0.0 and stats["one"]["p50"] == 1.0
    boxes = {r["feature"]: r["outliers"] for r in profiling.iqr_outliers(df, ["one", "empty"]).collect()}
    assert boxes == {"one": 0, "empty": 0}
    assert profiling.mixed_text(df).collect()[0]["invalid"] == 1
    empty = profiling.validation_summary(df.where("false")).first()
    assert "empty" in empty["metric"]


def test_sample_size_and_types(spark, merged):
    assert flow_files.first_rows(merged, 3).count() == 3 and flow_files.first_rows(merged).count() == 8
    assert profiling.column_types(merged).count() == 5


def test_written_tables(spark, merged, tmp_path):
    flow_files.write_table(merged.select("Label").withColumn("split", F.when(F.col("Label") == "DDoS", "test").otherwise("train")), str(tmp_path / "t"), ["split"])
    train, test = flow_files.load_split(spark, str(tmp_path / "t"))
    assert train.count() == 6 and test.count() == 2
    flow_files.write_summaries({"classes": profiling.class_distribution(merged, "Label")}, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s/classes")).count() == 3
    table = spark.createDataFrame([("a", {"BENIGN": 1.0})], "Attack_Type string, Class_Probabilities map<string,double>")
    flow_files.write_predictions(table, str(tmp_path / "p"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "p")).first()["Class_Probabilities"] == '{"BENIGN":1.0}'
    flow_files.write_json(table, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_density_integrates_to_one(spark):
    df = spark.range(2000).select((F.col("id") % 97).cast("double").alias("v"))
    curve = profiling.density(df, ["v"], points=200).orderBy("point").collect()
    area = sum((b["x"] - a["x"]) * (a["density"] + b["density"]) / 2 for a, b in zip(curve, curve[1:]))
    assert 0.85 < area <= 1.01



def test_folders_with_dots_and_repeated_headers(spark, tmp_path):
    folder = tmp_path / "raw.v2" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("x, y\n1,2\n")
    (tmp_path / "raw.v2" / "b.csv").write_text("x, y\n3,4\n")
    root = str(tmp_path / "raw.v2")
    assert len(flow_files.scan_directory(spark, root)) == 1
    found = flow_files.find_csv_files(spark, root)
    assert len(found) == 2
    assert sorted(tuple(r) for r in flow_files.load_merged(spark, found).collect()) == [("1", "2"), ("3", "4")]
    (folder / "c.csv").write_text('"x",y, x\n1,2,3\n')
    assert profiling.duplicate_names(flow_files.header_of(spark, str(folder / "c.csv"))) == ["x"]
    with pytest.raises(ValueError):
        flow_files.load_merged(spark, flow_files.find_csv_files(spark, root))
    with pytest.raises(FileNotFoundError):
        flow_files.find_csv_files(spark, str(tmp_path / "absent"))


def test_trend_keeps_every_point_and_the_latest_on_request(spark):
    rows = spark.range(150).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as timestamp", "'BENIGN' as attack_type")
    assert analytics.trend(rows, datetime(2024, 9, 1)).count() == 150
    latest = [r["time"] for r in analytics.trend(rows, datetime(2024, 9, 1), points=2).collect()]
    assert latest == ["2024-05-28", "2024-05-29"]


def test_headers_of_many_files_by_one_job(spark, tmp_path):
    """Thousands of small files, some odd names, an empty one, and large files whose later blocks begin with data."""
    for i in range(2000):
        (tmp_path / f"f {i}%20.csv").write_text("\ufeffa,b\n1,2\n" if i % 3 else 'b,"c, d"\n3,4\n')
    (tmp_path / "empty.csv").write_text("")  # listings leave empty files out
    (tmp_path / "large.csv").write_text("x,y\n" + "7,8\n" * 400_000)
    files = flow_files.scan_directory(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    opened = []
    plain = flow_files.header_of
    flow_files.header_of = lambda session, f: opened.append(f) or plain(session, f)
    try:
        found = flow_files.headers_of(spark, files)
    finally:
        flow_files.header_of = plain
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {h: len(f) for h, f in found.items()} == {("a", "b"): 1333, ("b", "c, d"): 667, ("x", "y"): 1}
    assert sorted(f for some in found.values() for f in some) == files
    assert len(opened) <= 1  # at most the large one


@pytest.mark.parametrize("width", [17, 64, 1000, 100_000])
def test_one_document_read_in_ranges(spark, tmp_path, width):
    """Commas, brackets, quotes and escapes inside strings, nested values, and ranges that begin anywhere."""
    odd = ['a,b', 'x\\y', 'he said "no, {never}"', "[,]", "é,ü", "", "\\", '",', "1}"]
    document = {"whitelist": odd, "empty": [], "one": {"k,1": {"v": odd, "n": [1, {"z": 2.5}]}, 'q"': {"v": [], "n": []}}, "none": {}, "flat": [1, True, None, -2.5e3, [1, 2]],
                "history": [{"a": i, "s": odd[i % len(odd)], "t": [{"u": odd}]} for i in range(60)], "scalar": 5, "last": "text, [ more"}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=2 if width % 2 else None, ensure_ascii=width == 64))
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, str(width if "max" in key else 0))
    try:
        found = documents.entries(spark, str(tmp_path / "a.json"))
        tasks = found.rdd.getNumPartitions()
        rows = found.collect()
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
    assert tasks > 4 or width > 1000
    for member, value in document.items():
        mine = [r["text"] for r in rows if r["member"] == member]
        if isinstance(value, list):
            assert sorted(json.dumps(json.loads(t)) for t in mine) == sorted(map(json.dumps, value)), member
        elif isinstance(value, dict):
            assert {k: v for t in mine for k, v in json.loads("{" + t + "}").items()} == value, member
        else:
            assert not mine


def test_documents_are_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f'"10.0.0.{i % 7}"',) for i in range(20)], "text string")
    stores.write_document({"whitelist": rows, "blacklist": rows.limit(0), "known_malicious_ips": spark.createDataFrame([('"1.2.3.4": {"category": "x, y", "threat_score": 9}',)], "text string")},
                          str(tmp_path / "d"), ("known_malicious_ips",))
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))
    assert {k: len(v) for k, v in json.loads(text).items()} == {"whitelist": 20, "blacklist": 0, "known_malicious_ips": 1}
    back = stores.read_indicators(spark, str(tmp_path / "d")).collect()
    assert sorted(r["ip"] for r in back) == sorted(["1.2.3.4", *[f"10.0.0.{i % 7}" for i in range(20)]])
    assert [(r["category"], r["threat_score"]) for r in back if r["list_type"] == "malicious_ip"] == [("x, y", 9)]
