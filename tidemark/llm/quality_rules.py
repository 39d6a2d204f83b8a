"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged on its own; lines that break a rule are removed,
and a document that loses too much of its words that way is rejected. Document
counts (symbols, repeated lines, words in repeated windows) are reported beside
it, and a document also fails on too few or too often repeated words.

Line rules, on a line with at least one word (w words):

* punctuation: fewer than 3 words and no closing punctuation, or 5 words and more
  with an exclamation mark for every other word;
* navigation: at least 3 separators, one for every 4 words or more;
* boilerplate: at most 12 words with a site phrase (log-in, cookies, rights), in four languages;
* clutter: more than 3 symbols for 10 words;
* stutter: at least 4 words, more than half of them equal to the word before.

Results for odd input: null and empty texts have no words, fail and are not kept;
blank lines stay and count for nothing; repeated rows are judged each on its own;
the input columns are passed on inside the struct ``row``, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, words

MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words
MAX_LOST = 30  # percent of words
WINDOW = 8

# Fixed values of the line rules (patterns are read alike by Java and RE2).
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·>"
CLOSED = r"[.!?:;,…。！？\"'”’»)\]]$"
# Site phrases in English, German, French and Spanish; letters beyond ASCII in both cases.
PHRASES = (
    r"(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|enable javascript|sign (in|up)|log in"
    r"|click here|read more|share (this|on)|subscribe|skip to (main )?content|powered by|back to top"
    r"|alle rechte vorbehalten|datenschutz|impressum|javascript aktivieren|jetzt anmelden|hier klicken|weiterlesen|nach oben"
    r"|tous droits r[éÉ]serv[éÉ]s|confidentialit[éÉ]|mentions l[éÉ]gales|activer javascript|se connecter|cliquez ici|lire la suite|haut de page"
    r"|todos los derechos reservados|pol[íÍ]tica de privacidad|aviso legal|activar javascript|iniciar sesi[óÓ]n|haga clic|leer m[áÁ]s|volver arriba)"
)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _lines(text: Column) -> Column:
    """Each line with its words squeezed to single spaces and their number."""
    squeezed = F.transform(F.split(text, "\n"), lambda raw: F.struct(raw.alias("raw"), F.trim(F.regexp_replace(raw, SPACE, " ")).alias("s")))
    return F.transform(
        squeezed,
        lambda x: F.struct(x["raw"].alias("raw"), x["s"].alias("s"), F.when(x["s"] == "", 0).otherwise(F.length(x["s"]) - F.length(F.replace(x["s"], F.lit(" "), F.lit(""))) + 1).alias("w")),
    )


def _breaks(line: Column) -> Column:
    s, w = line["s"], line["w"]
    punctuation = ((w < 3) & ~s.rlike(CLOSED)) | ((w >= 5) & (_count_of(s, "!") * 2 > w))
    separators = _count_of(s, SEPARATORS)
    navigation = (separators >= 3) & (separators * 4 >= w)
    boilerplate = (w <= 12) & s.rlike(PHRASES)
    clutter = _count_of(s, SYMBOLS) * 10 > w * 3
    parts = F.split(s, " ")
    again = F.zip_with(parts, F.slice(parts, F.lit(2), F.greatest(w - 1, F.lit(0))), lambda a, b: a == b)
    stutter = (w >= 4) & (F.size(F.filter(again, lambda x: x)) * 2 > w)
    return (w > 0) & (punctuation | navigation | clutter | boilerplate | stutter)


def assess(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, max_lost: int = MAX_LOST) -> DataFrame:
    """One row per row: ``row`` (the input columns), ``clean_text`` (the lines that pass), counts, ``base_failed`` and ``kept``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.struct("*").alias("row"), text.alias("text"), words(F.col(text_col)).alias("words"), _lines(text).alias("lines"))
    full = F.filter("lines", lambda x: x["w"] > 0)
    counted = cut.select(
        "row",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.transform(full, lambda x: x["raw"]).alias("written"),
        F.filter("lines", lambda x: ~_breaks(x)).alias("passed"),
        _window_hashes().alias("hashes"),
    )
    # A text whose window hashes are all different has no repeated window. Only the others
    # are looked at by the windows' words, so equal hashes of different words change nothing.
    sorted_windows = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _sorted_windows())
    windows = counted.select("row", "n_words", "word_chars", "n_symbols", "written", "passed", sorted_windows.alias("windows"))
    measured = windows.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("written") - F.size(F.array_distinct("written"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.array_join(F.transform("passed", lambda x: x["raw"]), "\n").alias("clean_text"),
        F.aggregate("passed", F.lit(0).cast("long"), lambda n, x: n + x["w"]).alias("kept_words"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated)
    judged = measured.withColumn("base_failed", failed)
    lost = (F.col("n_words") - F.col("kept_words")) * 100 > F.col("n_words") * max_lost
    return judged.withColumn("kept", ~F.col("base_failed") & ~lost)


def _window_hashes() -> Column:
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))
    return F.when(F.size("words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _sorted_windows() -> Column:
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    return F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("g"), i.alias("at"))))


def _covered() -> Column:
    """Words inside windows that occur twice or more."""
    w = F.col("windows")
    same = lambda a, b: F.get(w, a)["g"].eqNullSafe(F.get(w, b)["g"])
    again = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    starts = F.array_sort(F.transform(again, lambda k: F.get(w, k)["at"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, at: F.struct((at + WINDOW).alias("end"), (acc["n"] + at + WINDOW - F.greatest(acc["end"], at)).alias("n")),
        lambda acc: acc["n"],
    )
