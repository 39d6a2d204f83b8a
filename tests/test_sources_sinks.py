"""Sources, sinks and the profile job (FIXTURES F5-F7), written to pytest's scratch folder."""

import json

import random

import pytest
from pyspark.sql import functions as F

from tidemark import sinks
from tidemark.plans.profile import run_profile
from tidemark.sources import infer_types, list_members, nullify_markers, read_headed_table, require_source, require_table


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_headed_table_skips_title_row(spark, tmp_path):
    folder = tmp_path / "census"
    folder.mkdir()
    _write(folder / "a.csv", "Census export 2024\nid,Fecha Ingreso,valor\n1,2024-01-01,3.5\n2,,NA\n")
    _write(folder / "b.csv", "Another title\nid,Fecha Ingreso,valor\n3,2024-01-03,4\n")
    df = read_headed_table(spark, str(folder), header_row=1)
    assert df.columns == ["id", "Fecha Ingreso", "valor"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("1", "2024-01-01", "3.5"), ("2", None, "NA"), ("3", "2024-01-03", "4")]
    typed = infer_types(nullify_markers(df))
    assert dict(typed.dtypes) == {"id": "bigint", "Fecha Ingreso": "timestamp_ntz", "valor": "double"}


def test_require_source_and_member(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Missing"):
        require_source(spark, str(tmp_path / "nope.parquet"), "Place it first.")
    with pytest.raises(ValueError, match="No table named 'CENSO'"):
        require_table(["HOME", "SALAS"], "CENSO", "book")
    assert require_table(["HOME", "CENSO"], "CENSO") == ("CENSO", ["HOME"])


def test_parquet_round_trip_and_mixed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "valor long, texto string")
    path = sinks.write_identified(df, str(tmp_path / "plain.parquet"))
    back = spark.read.parquet(path)
    assert sorted(back.collect()) == sorted(df.collect()) and back.dtypes == df.dtypes
    mixed = spark.createDataFrame([(1,), (2,), (None,)], "triage long")
    out = sinks.write_identified(mixed, str(tmp_path / "mixed.parquet"), mixed_columns=["triage"])
    got = spark.read.parquet(out)
    assert got.dtypes == [("triage", "string")]
    assert sorted(r.triage for r in got.collect() if r.triage) == ["1", "2"]
    assert mixed.dtypes == [("triage", "bigint")]


def test_csv_json_fingerprint_manifest(spark, tmp_path):
    df = spark.createDataFrame([(4, float("nan"))], "filas long, ratio double")
    csv_path = sinks.write_evidence_csv(df, str(tmp_path / "dims.csv"))
    assert spark.read.option("header", True).csv(csv_path).first().filas == "4"
    json_path = sinks.write_report_json(df, str(tmp_path / "report.json"))
    lines = [ln for p in (tmp_path / "report.json").glob("part-*.json") for ln in p.read_text().splitlines() if ln]
    assert [json.loads(ln) for ln in lines] == [{"filas": 4, "ratio": None}]
    prints = sinks.fingerprint_files(spark, csv_path).collect()
    assert prints and all(len(r.sha256) == 64 for r in prints)
    manifest = {r.path: r for r in sinks.evidence_manifest(spark, [csv_path, json_path, str(tmp_path / "missing.csv")]).collect()}
    assert manifest[csv_path].exists and manifest[json_path].exists and not manifest[str(tmp_path / "missing.csv")].exists


def test_list_members(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert sorted(r.name for r in list_members(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_run_profile_end_to_end(spark, tmp_path, quality_small):
    src = str(tmp_path / "src.parquet")
    quality_small.write.parquet(src)
    tables = run_profile(spark, src, str(tmp_path / "out"), key="row_key")
    summary = {r.check: r for r in tables["validation_summary"].collect()}
    assert summary["null values"].affected == "6"
    manifest = spark.read.option("header", True).csv(str(tmp_path / "out/tables/manifest.csv"))
    assert manifest.where(F.col("exists") == "false").count() == 0
    meta = spark.read.json(str(tmp_path / "out/metrics/ingestion_metadata.json")).first()
    assert meta.rows == 4 and meta.null_cells == 6


def test_profile_approx_mode_runs_every_table(quality_small):
    import datetime as dt

    from tidemark.plans.profile import profile

    tables = profile(quality_small, key="row_key", as_of=dt.datetime(2026, 1, 1), approx=True)
    assert len(tables) == 29
    for name, table in tables.items():
        table.collect()
    ids = {r.column for r in tables["identifiers"].collect()}
    assert {"id_paciente", "fecha_ingreso", "fecha_salida"} <= ids


def test_headed_text_keeps_every_cell_or_fails(spark, tmp_path):
    folder = tmp_path / "ragged"
    folder.mkdir()
    _write(folder / "a.csv", "title\na,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="a.csv"):
        read_headed_table(spark, str(folder)).collect()
    other = tmp_path / "other"
    other.mkdir()
    _write(other / "a.csv", "title\na,b\n1,2\n")
    _write(other / "b.csv", "title\na,b,c\n1,2,3\n")
    with pytest.raises(Exception, match="b.csv"):
        read_headed_table(spark, str(other)).collect()


def test_headed_text_multi_line_header_and_empty_table(spark, tmp_path):
    folder = tmp_path / "multi"
    folder.mkdir()
    _write(folder / "a.csv", 'title\n"long\nname",b\n"x\ny",2\n')
    df = read_headed_table(spark, str(folder))
    assert df.columns == ["long\nname", "b"] and [tuple(r) for r in df.collect()] == [("x\ny", "2")]
    empty = spark.createDataFrame([], "a string, b long")
    sinks.write_headed_text(empty, str(tmp_path / "empty"), title="Nothing")
    back = read_headed_table(spark, str(tmp_path / "empty"))
    assert back.columns == ["a", "b"] and back.count() == 0


def test_types_are_read_from_how_values_are_written(spark):
    rows = [("001", "Y", "2D", "1", "1.50", "true", "2024-01-03T10:00:00-05:00"), ("01", "n", "3F", "-20", ".5", "false", "2024-01-04")]
    df = spark.createDataFrame(rows, "code string, yn string, hexish string, whole string, number string, flag string, at string")
    typed = infer_types(df)
    assert dict(typed.dtypes) == {
        "code": "string", "yn": "string", "hexish": "string", "whole": "bigint", "number": "double", "flag": "boolean", "at": "timestamp_ntz",
    }
    first = typed.orderBy("code").first()
    assert first.code == "001" and str(first["at"]) == "2024-01-03 15:00:00"


def test_large_files_are_hashed_in_blocks_and_folders_found(spark, tmp_path):
    import hashlib

    path = tmp_path / "big.bin"
    path.write_bytes(b"abc" * 50_000)
    got = sinks.fingerprint_files(spark, str(path), whole=1000).first()
    assert got.sha256 == hashlib.sha256(b"abc" * 50_000).hexdigest()
    spark.range(6).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(str(tmp_path / "parts"))
    seen = {r.path: r.exists for r in sinks.evidence_manifest(spark, [str(tmp_path / "parts"), str(tmp_path / "gone")]).collect()}
    assert seen == {str(tmp_path / "parts"): True, str(tmp_path / "gone"): False}


def _csv_with_line_feeds(path, rows, title):
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(title + "\n")
        csv.writer(f, lineterminator="\n").writerows([["a", "b", "c"], *rows])


def test_headed_text_is_read_in_ranges(spark, tmp_path):
    rng = random.Random(3)
    pieces = ["x", "ü", '"', "\n", ",", " ", "\r\n", '""', "\n\n", "long " * 5]
    wants = []
    for k in range(3):
        rows = [[str(i), "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))), "end"] for i in range(60)]
        rows[5][1], rows[6][1] = '"quoted"', "\n"
        _csv_with_line_feeds(tmp_path / f"f{k}.csv", rows, 'The "title" of 5" things' if k else "Title")
        wants += [tuple(r) for r in rows]
    for span in (64, 177, 1 << 20):
        df = read_headed_table(spark, str(tmp_path), span=span)
        got = [tuple(r) for r in df.collect()]
        assert sorted(got) == sorted(wants), span
    assert read_headed_table(spark, str(tmp_path), span=64).rdd.getNumPartitions() > 50


def test_headed_text_with_stray_quotes_is_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title\na,b\n" + "".join(f'{i},a 5" pipe\n' for i in range(99)))
    got = [tuple(r) for r in read_headed_table(spark, str(tmp_path), span=50).collect()]
    assert sorted(got) == sorted((str(i), 'a 5" pipe') for i in range(99))


@pytest.mark.parametrize("encoding", ["latin-1", "cp1251"])  # split in ranges, and read whole
def test_headed_text_in_another_encoding(spark, tmp_path, encoding):
    word = "ñ" if encoding == "latin-1" else "Ж"
    (tmp_path / "a.csv").write_bytes(f"T{word}tulo\na,b\n1,{word}\n2,x\n".encode(encoding))
    assert sorted(tuple(r) for r in read_headed_table(spark, str(tmp_path), encoding=encoding, span=8).collect()) == [("1", word), ("2", "x")]
