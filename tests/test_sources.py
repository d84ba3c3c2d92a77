import json
import time

import pytest

from demand_engine.plans import source_queries
from demand_engine.sources import ledger, tables


def write(folder, name, text):
    (folder / name).write_bytes(text.encode("latin-1"))


def test_missing_and_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ledger.read_movements(spark, str(tmp_path / "nowhere"))
    write(tmp_path, "otro.csv", "a;b\n")
    with pytest.raises(FileNotFoundError):
        ledger.read_movements(spark, str(tmp_path))


def test_layouts_are_united_by_name(spark, tmp_path):
    write(tmp_path, "Movimientos_a.csv", "Fecha;código; salida ;entrada;documento;número\n2023-01-01;P001;100.0;0;Venta;1\nx;P001;mal;;Guía;2\n")
    write(tmp_path, "Movimientos_b.csv", "Código,Salida,Fecha,Bodega\r\nP002,5,2023-01-08,Única\r\n")
    write(tmp_path, "Movimientos_backup.csv", "Código;Salida\nP003;1\n")
    write(tmp_path, "movimientos_c.csv", "Código;Salida\nP004;1\n")
    rows = {(r["sku"], r["numero"]): r for r in ledger.read_movements(spark, str(tmp_path)).collect()}
    assert set(rows) == {("P001", "1"), ("P001", "2"), ("P002", None)}
    assert rows[("P001", "1")]["salida"] == 100.0 and rows[("P001", "2")]["salida"] == 0.0
    assert rows[("P001", "2")]["fecha"] is None and rows[("P001", "2")]["documento"] == "Guía"
    assert rows[("P002", None)]["bodega"] == "Única" and rows[("P002", None)]["archivo"] == "Movimientos_b.csv"


def test_alias_yields_to_the_canonical_header():
    assert ledger.canonical_headers(["salida", " Salida", "código"]) == ["salida", "Salida", "Código"]


def test_validation_log_and_preview(spark, tmp_path):
    write(tmp_path, "Movimientos_1.csv", "Código;Fecha;Documento;Entrada;Salida\nA;2023-01-01;" + "d" * 40 + ";1;2\nB;2023-01-02;v;3;4\n\n")
    write(tmp_path, "Movimientos_2.csv", "Código;Entrada\nA;1\n")
    write(tmp_path, "otros.csv", "fecha,entrada,salida\n1,2,3\n")
    rows = {r["file"]: (r["valid_name"], r["missing"], r["valid"]) for r in ledger.validate_ingest(spark, str(tmp_path)).collect()}
    assert rows == {"Movimientos_1.csv": (True, [], True), "Movimientos_2.csv": (True, ["fecha", "salida"], False),
                    "otros.csv": (False, [], False)}
    counts = ledger.count_rows(spark, str(tmp_path)).where("filename like 'Mov%'")
    first = ledger.ingest_log(counts, None, "2024-01-01 00:00:00")
    second = ledger.ingest_log(counts, first, "2024-01-02 00:00:00").collect()
    assert [(r["filename"], r["rows"], r["replaced"]) for r in second] == [
        ("Movimientos_1.csv", 2, True), ("Movimientos_2.csv", 1, True), ("Movimientos_1.csv", 2, False), ("Movimientos_2.csv", 1, False)]
    shown, total = ledger.preview(spark, str(tmp_path / "Movimientos_1.csv"), 1)
    assert shown.collect()[0].asDict() == {"codigo": "A", "fecha": "2023-01-01", "doc": "d" * 30, "entrada": "1", "salida": "2"}
    assert total.first().asDict() == {"total_rows": 2, "has_required": True}


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("ñandú", 1.5), ("b", None)], "t string, v double")
    tables.write_table(df, str(tmp_path / "t"), "csv")
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "t"), "t string, v double").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    f = spark.createDataFrame([("CP 01", 3, 1.5, 1.0, 2.0)], "sku string, h int, prediction double, lower double, upper double")
    tables.write_forecast_long(f, str(tmp_path / "f"))
    assert tuple(tables.read_forecast_long(spark, str(tmp_path / "f")).first()) == ("CP01", 3, 1.5, 1.0, 2.0)


def test_nested_report(spark):
    doc = {"grupo_1": {"A": {"algoritmo_ganador": "Ridge", "hiperparametros_ganador": {"alpha": 1.0},
                             "metricas_test": {"R2": 0.5, "MAE": 1, "RMSE": 2, "MAPE": -3},
                             "comparativa": {"Ridge": {"R2_CV": 0.5}, "XGBoost": {"R2": 0.4}}},
                       "B": {"error": "Sin datos"}}}
    rows = {r["sku"]: r for r in tables.flatten_model_report(tables.report_rows(spark.createDataFrame([(json.dumps(doc),)], "value string"))).collect()}
    assert (rows["A"]["ganador"], rows["A"]["mape"], rows["A"]["r2_XGBoost"], rows["A"]["r2_RandomForest"]) == ("Ridge", None, 0.4, None)
    assert rows["B"]["ganador"] == "—"


@pytest.mark.parametrize("name", ["Movimientos_2024 copia.csv", "Movimientos_100%.csv", "Movimientos_año+1.csv"])
def test_file_names_of_any_kind(spark, tmp_path, name):
    write(tmp_path, name, "Fecha;Código;Salida;Entrada\n2023-01-01;P001;3;0\n")
    rows = ledger.read_movements(spark, str(tmp_path)).collect()
    assert [(r["archivo"], r["sku"], r["salida"]) for r in rows] == [(name, "P001", 3.0)]


def test_many_files_of_several_layouts(spark, tmp_path):
    heads = ["Fecha;Código;Salida;Entrada\n2023-01-0{d};P{i};{i};0\n", "entrada,salida,código,Fecha,Extra\n0,{i},P{i},2023-01-0{d},x\n",
             '"Código";"Salida"\n\n"P;{i}";{i}\n']
    for i in range(5000):
        write(tmp_path, f"Movimientos_{i:04d}.csv", heads[i % 3].format(i=i, d=1 + i % 9))
    rows = {r["archivo"]: r for r in ledger.read_movements(spark, str(tmp_path)).collect()}
    assert len(rows) == 5000
    for i in range(5000):
        r = rows[f"Movimientos_{i:04d}.csv"]
        assert (r["sku"], r["salida"]) == (f"P;{i}" if i % 3 == 2 else f"P{i}", float(i)) and (r["fecha"] is None) == (i % 3 == 2)


def test_a_file_system_only_spark_knows(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.default.link./store", f"file://{tmp_path}")
    write(tmp_path, "Movimientos_a.csv", "Fecha;Código;Salida;Entrada\n2023-01-01;P001;3;0\n2023-01-02;P002;4;0\n")
    rows = ledger.read_movements(spark, "viewfs:///store").collect()
    assert sorted((r["sku"], r["salida"], r["archivo"]) for r in rows) == [("P001", 3.0, "Movimientos_a.csv"), ("P002", 4.0, "Movimientos_a.csv")]
    assert [r["valid"] for r in ledger.validate_ingest(spark, "viewfs:///store").collect()] == [True]
    assert [r["codigo"] for r in ledger.preview(spark, "viewfs:///store/Movimientos_a.csv")[0].collect()] == ["P001", "P002"]


def test_a_stated_header_saves_the_look(spark, tmp_path):
    write(tmp_path, "Movimientos_a.csv", "Fecha;código;Salida;Entrada\n2023-01-01;P001;3;0\n")
    write(tmp_path, "Movimientos_a_backup.csv", "Fecha;código;Salida;Entrada\n2023-01-01;P009;3;0\n")
    df = ledger.read_movements(spark, str(tmp_path), "Fecha;código;Salida;Entrada")
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["sku"], r["salida"], r["archivo"]) for r in df.collect()] == [("P001", 3.0, "Movimientos_a.csv")]


def test_headers_are_found_without_a_sort(spark, tmp_path):
    write(tmp_path, "Movimientos_a.csv", "\n  \nFecha;Código\n2023-01-01;P001\n")
    first = ledger.first_lines(spark, str(tmp_path), "csv$")
    assert [r["header"] for r in first.collect()] == ["Fecha;Código"]
    assert "Sort" not in first._jdf.queryExecution().executedPlan().toString()


def test_preview_of_a_folder_of_parts_is_in_order(spark, tmp_path):
    df = spark.range(0, 400, 1, 7).selectExpr("cast(id as string) AS sku", "cast(NULL as date) AS fecha", "1.0D AS entrada", "2.0D AS salida")
    ledger.write_movements(df.orderBy("sku"), str(tmp_path / "Movimientos_p.csv"))
    shown, total = ledger.preview(spark, str(tmp_path / "Movimientos_p.csv"), 120)
    assert [r["codigo"] for r in shown.collect()] == sorted(map(str, range(400)))[:120] and total.first()["total_rows"] == 400


def test_paths_are_looked_into_once_a_file_not_once_a_line(spark, tmp_path):
    write(tmp_path, "Movimientos_ñ 1+%.csv", " \n\n Fecha;Código;año\n" + "2023-01-01;P001;1\n" * 50)
    write(tmp_path, "notas.txt", "Fecha;Código\n")
    first = ledger.first_lines(spark, str(tmp_path), "csv$")
    text = first._jdf.queryExecution().executedPlan().toString()
    assert [(r["file"], r["header"]) for r in first.collect()] == [("Movimientos_ñ 1+%.csv", " Fecha;Código;año")]
    assert "regexp_extract" not in text[text.index("Exchange"):] and "RLIKE" not in text[text.index("Exchange"):]
    counts = ledger.count_rows(spark, str(tmp_path))
    text = counts._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in text[text.rindex("- Exchange"):]
    assert {r["filename"]: r["rows"] for r in counts.collect()} == {"Movimientos_ñ 1+%.csv": 50, "": 0}


def test_ledgers_of_queries_are_compressed_and_leave_no_shuffle_files(spark, tmp_path):
    def shuffled():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(i).getName()) for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(key, None), shuffled()
    rows = [(f"P{i % 7}", f"2023-01-{1 + i % 28:02d}", "Guía; de \"remisión\"", float(i), 2.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "sku string, fecha string, documento string, entrada double, salida double").repartition(3, "sku")
    source_queries.write_ledger(df, str(tmp_path / "Movimientos_a.csv"))
    assert spark.conf.get(key, None) == before
    for _ in range(100):  # they are removed in the background
        if not (left := shuffled() - files):
            break
        time.sleep(0.1)
    assert not left
    parts = sorted(p.name for p in (tmp_path / "Movimientos_a.csv").glob("part-*"))
    assert parts and all(p.endswith(".csv.gz") for p in parts)
    ledger.write_movements(df, str(tmp_path / "Movimientos_b.csv"))  # as text, which stays the default
    assert list((tmp_path / "Movimientos_b.csv").glob("part-*.csv"))
    ledger.write_movements(df.drop("salida"), str(tmp_path / "Movimientos_c.csv"), compression="gzip")
    got = {r["file"]: (r["missing"], r["valid"]) for r in ledger.validate_ingest(spark, str(tmp_path)).collect()}
    assert got == {"Movimientos_a.csv": ([], True), "Movimientos_b.csv": ([], True), "Movimientos_c.csv": (["salida"], False)}
    assert {r["filename"]: r["rows"] for r in ledger.count_rows(spark, str(tmp_path)).collect()} == {f"Movimientos_{x}.csv": 2000 for x in "abc"}
    read = ledger.read_movements(spark, str(tmp_path)).select("archivo", "sku", "fecha", "documento", "entrada", "salida")
    rows_of = lambda x: sorted(tuple(r)[1:] for r in read.where(f"archivo = 'Movimientos_{x}.csv'").collect())
    assert rows_of("a") == rows_of("b") and len(rows_of("a")) == 2000 and rows_of("a")[0][2] == "Guía; de \"remisión\""
