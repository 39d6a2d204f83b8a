import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="tidemark-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def quality_small(spark):
    rows = [
        (0, "001", "A", None, " A", "1", "Uno", 0.0, "2024-01-01", "2024-01-02"),
        (1, "002", "A", None, "a ", "dos", "uno", 1.0, "mal", "2024-01-02"),
        (2, "002", "A", None, "SIN DATO", "3", "Úno", 2.0, "2024-01-03", "2024-01-01"),
        (3, None, "A", None, "  ", None, "Dos", 100.0, "2024-01-04", "2024-01-04"),
    ]
    schema = (
        "row_key long, id_paciente string, constante string, vacia string, texto string, mixto string, "
        "categoria string, numero double, fecha_ingreso string, fecha_salida string"
    )
    return spark.createDataFrame(rows, schema)
