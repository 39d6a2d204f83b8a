"""Column shape, text and categories on the FIXTURES goldens."""

from tidemark import operators as O
from tidemark.functions.text import fold_value, normalize_name

K = "row_key"


def _by(df, col="column"):
    return {r[col]: r for r in df.collect()}


def test_empty_constant_golden(quality_small):
    e = _by(O.empty_constant_columns(quality_small, K))
    assert e["vacia"].is_empty and not e["vacia"].single_value
    assert e["constante"].single_value and e["constante"].dominant_over_95
    assert e["constante"].dominant_pct == 100.0
    flagged = {r.column for r in O.flagged_columns(O.empty_constant_columns(quality_small, K)).collect()}
    assert flagged == {"vacia", "constante"}


def test_type_profile_mixed(quality_small):
    t = _by(O.type_profile(quality_small, K))
    assert t["mixto"].mixed
    assert t["numero"].all_types == "float" and not t["numero"].mixed
    assert t["vacia"].all_types == ""


def test_identifier_candidates_golden(quality_small):
    ids = _by(O.identifier_candidates(quality_small, K))
    assert {"id_paciente", "fecha_ingreso", "fecha_salida", "numero", "mixto"} <= set(ids)
    assert ids["id_paciente"].name_match and ids["id_paciente"].nulls == 1
    assert ids["fecha_salida"].name_match  # "id" is inside "salida"
    approx = _by(O.identifier_candidates(quality_small, K, approx=True))
    assert set(approx) == set(ids)


def test_text_problems_golden(quality_small):
    t = _by(O.text_problems(quality_small, K))
    texto = t["texto"]
    assert (texto.leading_spaces, texto.trailing_spaces, texto.double_spaces) == (2, 2, 1)
    assert (texto.spelling_groups, texto.empty_strings, texto.only_spaces, texto.non_printable) == (1, 0, 1, 0)
    assert t["categoria"].spelling_groups == 1
    nulls = O.textual_nulls(quality_small, K).collect()
    assert [(r.column, r.token, r["count"]) for r in nulls] == [("texto", "SIN DATO", 1)]


def test_trailing_space_on_last_line_counts(spark):
    df = spark.createDataFrame([("a\nb ",), ("a\tb",), ("x ",)], "v string")
    t = O.text_problems(df).first()
    assert t.trailing_spaces == 1
    assert t.non_printable == 3  # newline, tab, no-break space


def test_categories_golden(quality_small):
    summary = _by(O.category_summary(quality_small, K))
    assert "categoria" in summary and summary["vacia"].categories == 0 and summary["vacia"].top_category is None
    freq = [r for r in O.category_frequencies(quality_small, K).collect() if r.column == "categoria"]
    assert [r.category for r in sorted(freq, key=lambda r: r.rank)] == ["Dos", "Uno", "uno", "Úno"]
    eq = {(r.column, r.key): r for r in O.equivalent_categories(quality_small, K).collect()}
    assert eq[("categoria", "uno")].variants == "Uno | uno | Úno"
    assert eq[("categoria", "uno")].variant_count == 3
    assert eq[("texto", "a")].variant_count == 2


def test_names_fold_and_normalize():
    assert fold_value("  Ñandú\tÁrbol  ") == "nandu arbol"
    assert normalize_name("  Fecha Á") == "fecha_a"
    assert normalize_name("Símbolo #%") == "simbolo"
    assert normalize_name("###") == "columna"


def test_normalize_columns_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  Fecha Á", "Fecha A", "Símbolo #%"])
    renamed, mapping = O.normalize_columns(df)
    assert renamed.columns == ["fecha_a", "fecha_a__2", "simbolo"]
    assert [tuple(r) for r in renamed.collect()] == [(1, 2, 3)]
    m = {r.normalized_name: r.original_name for r in mapping.collect()}
    assert m == {"fecha_a": "  Fecha Á", "fecha_a__2": "Fecha A", "simbolo": "Símbolo #%"}
    assert O.values_preserved(df, renamed).first().preserved


def test_classify_variables(quality_small):
    c = _by(O.classify_variables(quality_small, K))
    assert c["id_paciente"].proposed_group == "identificacion"
    assert c["fecha_salida"].alternative_groups == "temporales | salida"
    assert c["numero"].proposed_group == "otras" and c["numero"].needs_review


def test_empty_constant_approx_agrees_on_small_data(quality_small):
    exact = {r.column: tuple(r) for r in O.empty_constant_columns(quality_small, K).collect()}
    approx = {r.column: tuple(r) for r in O.empty_constant_columns(quality_small, K, approx=True).collect()}
    assert exact == approx


def test_type_profile_variant_mixed(spark):
    df = spark.createDataFrame([(0, "1"), (1, '"dos"'), (2, "3"), (3, None)], "k long, j string")
    v = df.select("k", __import__("pyspark.sql.functions", fromlist=["parse_json"]).parse_json("j").alias("mixto"))
    t = {r.column: r for r in O.type_profile(v, "k").collect()}
    assert t["mixto"].all_types == "int, str" and t["mixto"].mixed and t["mixto"].is_object


def test_folding_holds_a_piece_of_a_batch():
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    from tidemark.functions import text

    values = [None, "", " É  é x\x1cy ", "ΟΔΟΣ ΣΑΣ", "İstanbul ﬁ", "한글 ①", "ạ́b", "😀 Z"]
    assert text.fold_array(pa.array(values)).to_pylist() == text.fold_series(pd.Series(values, dtype=object)).tolist()
    assert text.fold_array(pa.array([], pa.string())).to_pylist() == []
    many = pa.array(["Ü" * 4000] * 3000)  # 12 million characters
    tracemalloc.start()
    folded = text._fold_udf.func(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert folded.to_pylist() == ["u" * 4000] * 3000 and peak < 4 * text.PIECE
