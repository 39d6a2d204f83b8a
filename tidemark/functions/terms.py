"""Fixed values.

These word lists, tokens and patterns must equal the values the profiled
study fixed, so results agree; they are stated here once, in natural order.
Every operator takes them as overridable arguments with these defaults.
"""

from __future__ import annotations

# --- fixed values: text that stands for a missing value (compared after fold + upper)
TEXT_NULL_TOKENS = (
    "NA",
    "N/A",
    "NULL",
    "NONE",
    "SIN DATO",
    "NO APLICA",
    "VACIO",
    "-",
    "--",
    ".",
    "NO REGISTRA",
)

# --- fixed values: name fragments that suggest an identifier (substring match)
IDENTIFIER_TERMS = (
    "id",
    "identificacion",
    "documento",
    "episodio",
    "admision",
    "ingreso",
    "historia",
    "paciente",
    "consecutivo",
)

# --- fixed values: name tokens that suggest a date (whole-token match)
DATE_TERMS = (
    "fecha",
    "hora",
    "ingreso",
    "egreso",
    "salida",
    "triage",
    "atencion",
    "admision",
    "hospitalizacion",
)
EXPLICIT_DATE_WORDS = ("fecha", "hora")
DATE_NAME_EXCLUSIONS = (
    "clase",
    "estado",
    "meta",
    "orden",
    "tiempo",
    "total",
    "hrs",
    "dias",
)

# --- fixed values: start/end name fragments of a plausible time interval
TEMPORAL_START_TERMS = ("ingreso", "admision", "triage", "inicio", "solicitud", "conducta")
TEMPORAL_END_TERMS = ("salida", "egreso", "fin", "realizacion", "conducta")

# --- fixed values: ordered variable groups and their name fragments
VARIABLE_GROUPS = (
    ("identificacion", IDENTIFIER_TERMS),
    ("demograficas", ("edad", "sexo", "genero", "residencia", "municipio")),
    ("clinicas", ("antecedente", "sintoma", "signo", "clinico")),
    ("triage", ("triage",)),
    ("diagnostico", ("diagnostico", "cie")),
    ("especialidad", ("especialidad", "servicio")),
    ("administrativas", ("eps", "asegurador", "autorizacion", "administrativo")),
    ("temporales", DATE_TERMS),
    ("ubicacion_o_cama", ("ubicacion", "cama", "sala", "piso")),
    ("ocupacion", ("ocupacion", "capacidad")),
    ("conducta", ("conducta", "destino")),
    ("salida", ("salida", "egreso", "alta")),
)
OTHER_GROUP = "otras"
CLASSIFICATION_CRITERION = "name and type match, programmed"

# --- fixed values: default name for a column whose normalised name is empty
EMPTY_COLUMN_NAME = "columna"

# --- fixed values: pandas' default missing-value markers applied by its readers
DEFAULT_NA_MARKERS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- fixed values: patterns
# ASCII whitespace, written out so that Java and RE2 read it alike.
WS = "[ \\t\\n\\x0B\\f\\r]"
DIGITS_ONLY = "^[0-9]+\\z"
ALNUM_ID = "^[A-Za-z0-9._-]+\\z"
DATE_OR_TIME_HINT = "(?:[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4})|(?:[0-9]{1,2}:[0-9]{2})"
NON_PRINTABLE = "[\\p{C}\\p{Z}&&[^ ]]"

# --- fixed values: profile thresholds
IDENTIFIER_MIN_UNIQUENESS = 95.0
IDENTIFIER_MIN_PATTERN = 80.0
LOW_VARIABILITY_MAX_UNIQUE = 5
DOMINANT_SHARE = 95.0
MAX_CATEGORIES = 50
MAX_CARDINALITY_PCT = 20.0
TOP_CATEGORIES = 10
DATE_CONTENT_THRESHOLD = 80.0
EARLIEST_DATE = "1900-01-01"
EXAMPLE_LIMIT = 20
IQR_FACTOR = 1.5
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
