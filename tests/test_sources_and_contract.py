import csv
import json
import os

import pytest
from conftest import person, write_lines
from pyspark.sql import functions as F

from rosterlens import fixed_values as fv
from rosterlens.operators import contract
from rosterlens.sources import candidates as src, tables, vectors
from rosterlens.sources.lines import first_lines, split_lines, with_number
from rosterlens.sources.scratch import Scratch, materialise, scratch_root


def ids(df):
    return sorted(r["candidate_id"] for r in df.collect())


def test_tolerant_lines(spark, tmp_path):
    path = write_lines(tmp_path / "c.jsonl", [
        person(1), "", "   ", "{broken", person(2, years_of_experience="many"),
        person(3, candidate_id=""), {"candidate_id": None}, person(4)])
    df = src.read_jsonl(spark, path)
    assert ids(src.with_id(df)) == ["CAND_0000001", "CAND_0000002", "CAND_0000004"]
    assert [r["value"] for r in src.rejected_lines(spark, path).collect()] == ["{broken"]
    # the limit counts raw lines, blank and broken ones included
    assert ids(src.with_id(src.read_jsonl(spark, path, limit=5))) == ["CAND_0000001", "CAND_0000002"]


def test_other_signals_field(spark, tmp_path):
    record = person(1)
    record["platform_signals"] = record.pop("signals")
    path = write_lines(tmp_path / "c.jsonl", [record])
    row = src.read_jsonl(spark, path, "platform_signals").first()
    assert row["signals"]["notice_period_days"] == 30
    assert row["signals"]["skill_assessment_scores"] == {"NLP": 90.0, "React": 50.0}


def test_strict_lines(spark, tmp_path):
    good = write_lines(tmp_path / "good.jsonl", [person(1), "", person(2)])
    assert ids(src.read_jsonl_strict(spark, good)) == ["CAND_0000001", "CAND_0000002"]
    assert ids(src.read_jsonl_strict(spark, good, limit=2)) == ["CAND_0000001"]
    bad = write_lines(tmp_path / "bad.jsonl", [person(1), "{broken"])
    with pytest.raises(Exception):
        src.read_jsonl_strict(spark, bad).collect()


def test_uploads_and_arrays(spark, tmp_path):
    array = tmp_path / "a.json"
    array.write_text("\n " + json.dumps([person(1), person(2)], indent=1))
    lines = write_lines(tmp_path / "b.jsonl", [person(3)])
    assert ids(src.read_upload(spark, str(array))) == ["CAND_0000001", "CAND_0000002"]
    assert ids(src.read_upload(spark, lines)) == ["CAND_0000003"]
    assert src.read_json_array(spark, str(tmp_path / "missing.json")).count() == 0


def test_role_files_and_vectors(spark, tmp_path):
    (tmp_path / "jd").mkdir()
    (tmp_path / "jd" / "one.txt").write_text("Role: A\n\nbody")
    assert tables.read_jobs(spark, str(tmp_path / "jd")).first()["text"] == "Role: A\n\nbody"
    assert vectors.read_vectors(spark, str(tmp_path / "none")) is None
    long_id = "CAND_" + "9" * 30
    rows = [(long_id, [0.0, 2.0]), (long_id, [2.0, 0.0]), ("b", [3.0, 4.0])]
    vectors.write_vectors(spark.createDataFrame(rows, "id STRING, vector ARRAY<DOUBLE>"),
                          [0.0, 1.0], str(tmp_path / "v"))
    artifact = vectors.read_vectors(spark, str(tmp_path / "v"))
    assert artifact.query == (0.0, 1.0)
    near = {r["candidate_id"]: r["dense"] for r in artifact.similarities().collect()}
    assert near[long_id] == pytest.approx(1.0) and near["b"] == pytest.approx(0.8)
    artifact.vectors.write.parquet(str(tmp_path / "half" / "vectors"))
    with pytest.raises(ValueError, match="no query vector"):
        vectors.read_vectors(spark, str(tmp_path / "half"))


def test_scan_limit_counts_lines_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, name in enumerate(("a.txt", "b c.txt", "d.txt")):
        (tmp_path / "in" / name).write_text(
            "".join(f"{n}-{i}\n" if i % 3 else "\n" for i in range(50)))
    every = [f"{n}-{i}" if i % 3 else "" for n in range(3) for i in range(50)]
    for limit in (0, 1, 49, 50, 51, 149, 150, 500):
        got = first_lines(spark, str(tmp_path / "in"), limit)
        assert sorted(r["value"] for r in got.collect()) == sorted(every[:limit])


def test_lines_are_numbered_without_a_sort(spark, tmp_path):
    wide = tmp_path / "wide"
    spark.range(20000).select(F.concat(F.lit("line "), "id").alias("value")).repartitionByRange(
        7, "value").sortWithinPartitions("value").write.text(str(wide))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")   # many splits a file
        numbered = with_number(split_lines(spark, str(wide)).where("value not like '%7'"), "n")
        rows = [r["value"] for r in numbered.orderBy("n").select("value").collect()]
        numbers = [r["n"] for r in numbered.select("n").collect()]
        assert split_lines(spark, str(wide)).select("_file", "_begin").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lines = [x for f in sorted(wide.glob("part*")) for x in f.read_text().splitlines()]
    assert rows == [x for x in lines if not x.endswith("7")]
    assert sorted(numbers) == list(range(1, len(rows) + 1))
    text = numbered._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "Sort" not in text


def test_scratch_follows_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialise(spark.range(5))
    assert df.count() == 5 and df._jdf.inputFiles()[0].startswith(
        "file://" if "://" in df._jdf.inputFiles()[0] else "file:")


def ranked(spark, n=100):
    return spark.range(1, n + 1).select(
        F.format_string("CAND_%07d", F.col("id")).alias("candidate_id"), F.col("id").cast("int").alias("rank"),
        (1.0 - F.col("id") / 1000.0).alias("score"), F.lit('said "so", twice').alias("reasoning"))


def test_csv_round_trip_is_valid(spark, tmp_path):
    tables.write_ranked_csv(ranked(spark), str(tmp_path / "out"), 100)
    parts = list((tmp_path / "out").glob("part-*.csv"))
    assert len(parts) == 1
    assert parts[0].read_text().splitlines()[:2] == [
        "candidate_id,rank,score,reasoning", 'CAND_0000001,1,0.9990,"said ""so"", twice"']
    header, rows = contract.read_rows(spark, str(parts[0]))
    assert header == list(fv.RANKED_COLUMNS)
    assert rows.where("row = 2").first()["cells"] == ["CAND_0000001", "1", "0.9990", 'said "so", twice']
    assert contract.violations(rows, header).count() == 0
    assert tables.read_ranked_csv(spark, str(tmp_path / "out")).count() == 100


def rules(spark, lines, n):
    rows = spark.createDataFrame([(i + 2, c) for i, c in enumerate(lines)],
                                 "row BIGINT, cells ARRAY<STRING>")
    found = [(r["rule"], r["row"]) for r in contract.violations(rows, None, n).collect()]
    return sorted(found, key=str)


def line(i, rank=None, score="0.5", reason="r"):
    return [f"CAND_{i:07d}", str(i if rank is None else rank), score, reason]


@pytest.mark.parametrize("lines,want", [
    ([line(1), line(2)], []),
    ([line(1)], [("rank_missing", None), ("row_count", None)]),
    ([line(1), line(2)[:3]], [("cell_count", 3), ("rank_missing", None)]),
    ([["", "1", "0.5", ""], line(2)], [("id_required", 2)]),
    # a malformed id still takes part in the order rules
    ([["CAND_1", "1", "0.5", ""], line(2)], [("id_format", 2), ("tie_break", 2)]),
    ([["CAND_1", "1", "0.6", ""], line(2)], [("id_format", 2)]),
    ([line(1), line(1, 2)], [("id_duplicate", 3)]),
    ([line(1), line(2, "02")], [("rank_integer", 3), ("rank_missing", None)]),
    ([line(1), line(2, 3)], [("rank_missing", None), ("rank_range", 3)]),
    ([line(1), line(2, 1)], [("rank_duplicate", 3), ("rank_missing", None)]),
    ([line(1, score="high"), line(2)], [("score_float", 2)]),
    ([line(1, score="0.4"), line(2)], [("score_order", 2)]),
    ([line(2, 1), line(1, 2)], [("tie_break", 2)]),
])
def test_each_rule(spark, lines, want):
    assert rules(spark, lines, 2) == sorted(want, key=str)


def test_header_rule(spark):
    rows = spark.createDataFrame([(2, line(1))], "row BIGINT, cells ARRAY<STRING>")
    found = contract.violations(rows, ["candidate_id", "rank", "reasoning", "score"], 1).collect()
    assert [(r["rule"], r["row"]) for r in found] == [("header", 1)]


def test_csv_cells_with_odd_quotes(spark):
    given = ['"abc,def', '"a"b,c', 'a"b,c', '"a""b', '"",x', '"a" ,"b"x"y', '"']
    lines = spark.createDataFrame(list(enumerate(given)), "i int, line string")
    got = [r[0] for r in lines.orderBy("i").select(contract.csv_cells(F.col("line"))).collect()]
    assert got == [next(csv.reader([x])) for x in given]


def test_csv_cells_keep_an_empty_first_cell_and_long_quoted_ones(spark):
    long_cell = '"' + "a,\"\"b" * 20_000 + '"'
    lines = spark.createDataFrame([(0, ",1,0.5,x"), (1, f"{long_cell},2,,"), (2, "")],
                                  "i int, line string")
    got = [r[0] for r in lines.orderBy("i").select(contract.csv_cells(F.col("line"))).collect()]
    assert got[0] == ["", "1", "0.5", "x"] and got[2] == [""]
    assert got[1] == ["a,\"b" * 20_000, "2", "", ""]


def test_scores_must_be_plain_numbers(spark):
    rows = spark.createDataFrame([(i + 2, ["CAND_000000%d" % i, str(i + 1), s, "x"]) for i, s in
                                  enumerate(("0.5d", "1f", "nan", "0.4"))],
                                 "row long, cells array<string>")
    found = {(r["rule"], r["row"]) for r in contract.violations(rows, None, 4).collect()}
    assert ("score_float", 2) in found and ("score_float", 3) in found
    assert not {x for x in found if x[0] in ("score_order", "tie_break")}


def test_lines_that_only_look_like_json_are_rejected(spark, tmp_path):
    good = '{"candidate_id":"A0","profile":{"years_of_experience":"7"}}'
    bad = ['{"candidate_id":"A1"} trailing', '{"candidate_id":"A2"}{"candidate_id":"A3"}',
           "{'candidate_id':'A4'}"]
    path = write_lines(tmp_path / "odd.jsonl", [good, *bad])
    got = src.read_jsonl(spark, path).collect()
    assert [(r["candidate_id"], r["profile"]["years_of_experience"]) for r in got] == [("A0", 7.0)]
    assert {r[0] for r in src.rejected_lines(spark, path).collect()} == set(bad)
    path = write_lines(tmp_path / "one.jsonl", [good])
    row = src.read_jsonl_strict(spark, path).first()
    assert row["profile"]["years_of_experience"] == 7.0
    for i, line in enumerate(bad):
        path = write_lines(tmp_path / f"bad{i}.jsonl", [line])
        with pytest.raises(Exception):
            src.read_jsonl_strict(spark, path).collect()


def files_in(folder):
    path = str(folder).removeprefix("file:")
    return sum(len(names) for _, _, names in os.walk(path))


def test_scratch_goes_with_its_run(spark):
    with Scratch(spark) as scratch:
        first = scratch.keep(spark.range(1000))
        second = scratch.keep(first.groupBy((F.col("id") % 7).alias("k")).count())
        both = files_in(scratch.folder)
        scratch.drop(first)
        assert 0 < files_in(scratch.folder) < both
        assert second.agg(F.sum("count")).first()[0] == 1000
        left = materialise(second)
    assert files_in(scratch.folder) == 0 and left.count() == 7
    with pytest.raises(ZeroDivisionError):
        with Scratch(spark) as scratch:
            scratch.keep(spark.range(10))
            1 / 0
    assert files_in(scratch.folder) == 0
