"""Secret scans, in DataFrame functions only: patterns, and a randomness battery.

Base kinds, found left to right without overlap in every text: assignments to a
password-like name, access keys, hexadecimal runs (see ``BASE``).

Battery. Every run of 16 and more letters, digits and ``+/_-`` outside the base
spans is a candidate, and so is every part of 16 and more letters and digits between
the joints of such a run (a key at the end of a path). Each is put into the smallest
alphabet that holds it (``ENCODINGS``); none is left out for how it looks. Its
characters' places in that alphabet of K are tested:

* chi-squared against a uniform alphabet. Under uniformity it has mean K-1; for
  text in that alphabet it grows by (n-1) times K * sum(q^2) - 1, where sum(q^2) is
  the chance that two characters of running text agree. So the same statistic gives
  two tail probabilities: of being so large if random, and so small if text.
* runs above and below the alphabet's middle (Wald-Wolfowitz), and
* lag-1 serial correlation; each two-sided under randomness.
* breaks: neighbours of two kinds (small letter, capital, digit), but for a capital
  before a small letter. Words, names and paths have one in ``BREAKS`` neighbours at
  most, so many of them are unlikely for text.

The tests of randomness are combined (Fisher, six degrees of freedom): a run whose
combined probability is under ``RANDOM_ALPHA`` is structured and no secret. Of the
others, those are reported whose text probability (chi-squared and breaks, combined
by Fisher with four degrees of freedom) passes a Benjamini-Hochberg cut-off at
``FALSE_RATE`` over all candidates of the table, drawn apart by groups of
alphabets and in bands of length, since small alphabets and short runs tell text and
keys apart less well. The cut-offs come from a histogram of at most groups x bands x
levels rows.
A part inside a reported run is not told again.

Results for odd input: null and empty texts have no spans; a text may hold any
number of spans; repeated rows are scanned each on its own; an empty table has no
cut-offs and no spans; the input columns are passed on inside the struct ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import durable, let, running

# The base kinds in order, with their patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "random")

RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
_DIGITS, _LOW, _CAP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters and digits from the smallest alphabet up, the chance that two characters of running text in it agree, and its group:
#: letters of one case or digits alone (0), both (1), letters of both cases (2).
CORES = (
    ("", 0.5, 0),
    (_DIGITS, 0.12, 0),
    (_DIGITS + "abcdef", 0.12, 1),
    (_DIGITS + "ABCDEF", 0.12, 1),
    (_LOW, 0.065, 0),
    (_CAP, 0.065, 0),
    (_CAP + "234567", 0.065, 1),
    (_DIGITS + _LOW, 0.065, 1),
    (_DIGITS + _CAP, 0.065, 1),
    (_CAP + _LOW, 0.06, 2),
    (_DIGITS + _CAP + _LOW, 0.06, 2),
)
GROUPS = 3
JOINTS = ("", "+/", "-_", "+/-_")
#: Every core with every set of joints: characters, agreement and group; a run's is ``core * len(JOINTS) + joints``.
ENCODINGS = tuple((core + joints, agree, group) for core, agree, group in CORES for joints in JOINTS)
PART = r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+"
BREAK = r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[0-9]|(?<=[0-9])[A-Za-z]"
BREAKS = 0.25
BANDS = (16, 20, 24, 32, 48)
RANDOM_ALPHA = 0.005
FALSE_RATE = 0.05
LEVELS = 400  # text probabilities are counted in steps of a factor exp(1/10)
MASK = "[SECRET]"


def _matches(text: Column, pattern: str) -> Column:
    """All matches from left to right: ``start``, ``end`` (code points) and ``found``."""
    steps = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("long"), hit.alias("found")),
    )
    item = "struct<start:int,end:int,found:string>"
    placed = running(
        F.filter(steps, lambda x: x["found"].isNotNull()),
        F.lit(0),
        lambda at, x: at + x["gap"] + x["long"],
        lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["long"]).alias("end"), x["found"].alias("found")),
        item,
    )
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{item}>"))


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _encoding(run: Column) -> Column:
    """Index into ENCODINGS of the smallest alphabet that holds the run."""
    body = F.regexp_replace(run, "=+$", "")
    core = F.coalesce(*(F.when(~body.rlike(f"[^{chars}+/_-]"), k) for k, (chars, _, _) in enumerate(CORES)))
    joints = F.when(body.rlike("[+/]"), 1).otherwise(0) + F.when(body.rlike("[_-]"), 2).otherwise(0)
    return core * len(JOINTS) + joints


def _parts(run: Column) -> Column:
    """The runs of letters and digits between the joints of a run, as candidates of their own."""
    return F.transform(
        F.when(run["found"].rlike("[+/_-]"), _matches(run["found"], PART)),
        lambda m: F.struct((run["start"] + m["start"]).alias("start"), (run["start"] + m["end"]).alias("end"), m["found"].alias("found")),
    )


def _tail(z: Column) -> Column:
    """The normal upper tail (Abramowitz and Stegun 26.2.17, error under 1e-7)."""

    def upper(t: Column) -> Column:
        return t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))

    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    beyond = let(1.0 / (1.0 + 0.2316419 * F.abs(z)), upper) * density
    return F.greatest(let(beyond, lambda u: F.when(z >= 0, u).otherwise(1 - u)), F.lit(1e-300))


def _pick(enc: Column, values: list) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), enc)


def _tested(candidates: Column) -> Column:
    """Candidates with ``n``, ``p_random`` and ``p_text``; ``candidates`` have start, end, found and enc."""
    placed = F.transform(
        candidates,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            c["enc"].alias("enc"),
            F.regexp_count(c["found"], F.lit(BREAK)).cast("double").alias("breaks"),
            _pick(c["enc"], [len(chars) or 1 for chars, _, _ in ENCODINGS]).cast("double").alias("k"),
            _pick(c["enc"], [max(0.0, len(chars) * agree - 1) for chars, agree, _ in ENCODINGS]).alias("excess"),
            F.transform(
                F.split(F.regexp_replace(c["found"], "=+$", ""), ""),
                lambda ch: F.instr(_pick(c["enc"], [chars for chars, _, _ in ENCODINGS]), ch) - 1,
            ).alias("x"),
        ),
    )
    summed = F.transform(
        placed,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            c["enc"].alias("enc"),
            c["breaks"].alias("breaks"),
            c["k"].alias("k"),
            c["excess"].alias("excess"),
            F.size(c["x"]).cast("double").alias("n"),
            # Squares of the counts of the symbols that occur.
            F.aggregate(F.transform(F.array_distinct(c["x"]), lambda v: F.size(F.filter(c["x"], lambda y: y == v))), F.lit(0.0), lambda acc, m: acc + m.cast("double") * m).alias("squares"),
            F.aggregate(
                F.transform(c["x"], lambda v: v * 2 >= c["k"]),
                F.struct(F.lit(None).cast("boolean").alias("last"), F.lit(0.0).alias("runs")),
                lambda acc, up: F.struct(up.alias("last"), (acc["runs"] + F.when(acc["last"].eqNullSafe(up), 0.0).otherwise(1.0)).alias("runs")),
                lambda acc: acc["runs"],
            ).alias("runs"),
            F.aggregate(
                c["x"],
                F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum")),
                lambda acc, v: F.struct((v - (c["k"] - 1) / 2).alias("last"), (acc["sum"] + acc["last"] * (v - (c["k"] - 1) / 2)).alias("sum")),
                lambda acc: acc["sum"],
            ).alias("lagged"),
        ),
    )

    def deviations(c: Column) -> Column:
        """How far, in standard deviations: agreement beyond chance, runs, correlation, agreement short of text, breaks."""
        n, k = c["n"], c["k"]
        chi = k / n * c["squares"] - n
        return let(
            chi,
            lambda chi: F.array(
                (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n),
                F.abs((c["runs"] - 1 - (n - 1) / 2) / (F.sqrt(n - 1) / 2)),
                F.abs(c["lagged"] / ((k * k - 1) / 12 * F.sqrt(n - 1))),
                ((k - 1) + (n - 1) * c["excess"] - chi) / F.sqrt(2 * (k - 1) + 4 * (n - 1) * c["excess"]),
                (c["breaks"] - 0.5 - (n - 1) * BREAKS) / F.sqrt((n - 1) * BREAKS * (1 - BREAKS)),
            ),
        )

    def scores(c: Column) -> Column:
        logs = F.transform(F.transform(deviations(c), _tail), lambda p: -F.log(p))
        # The second and third test are two-sided.
        sums = let(logs, lambda g: F.struct((g[0] + g[1] + g[2] - 2 * math.log(2)).alias("half"), (g[3] + g[4]).alias("both")))
        return let(
            sums,
            lambda x: F.struct(
                c["start"].alias("start"),
                c["end"].alias("end"),
                c["enc"].alias("enc"),
                c["n"].alias("n"),
                (F.exp(-x["half"]) * (1 + x["half"] + x["half"] * x["half"] / 2)).alias("p_random"),
                (F.exp(-x["both"]) * (1 + x["both"])).alias("p_text"),
            ),
        )

    def banded(c: Column) -> Column:
        band = F.lit(0)
        for b, least in enumerate(BANDS):
            band = F.when(c["n"] >= least, b).otherwise(band)
        band = _pick(c["enc"], [group for _, _, group in ENCODINGS]) * len(BANDS) + band
        level = F.least(F.floor(-F.log(F.greatest(c["p_text"], F.lit(1e-300))) * 10), F.lit(LEVELS)).cast("int")
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), (c["p_random"] >= RANDOM_ALPHA).alias("even"), c["p_random"].alias("p_random"), c["p_text"].alias("p_text"), band.alias("band"), level.alias("level"))

    return F.transform(F.transform(summed, scores), banded)


def scan(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Per row: ``row`` (the input columns, or those of ``carry``), ``text``, ``base`` (spans in order) and ``tested`` (candidate runs)."""
    row = F.struct(*(carry if carry is not None else docs.columns))
    found = docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "row",
        "text",
        F.filter(_matches(F.col("text"), ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        F.filter(_matches(F.col("text"), ACCESS), lambda m: F.length(m["found"]) >= ACCESS_LEAST).alias("access"),
        _matches(F.col("text"), HEX).alias("hex"),
        _matches(F.col("text"), RUN).alias("runs"),
    )
    whole = F.transform("runs", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found")))
    parts = F.flatten(F.transform("runs", lambda m: F.coalesce(_parts(m), F.filter(F.array(m), lambda x: F.lit(False)))))
    based = found.select(
        "row",
        "text",
        F.array_sort(F.concat(_spans(F.col("assign"), 0), _spans(F.col("access"), 1), _spans(F.col("hex"), 2))).alias("base"),
        F.concat(whole, parts).alias("runs"),
    )
    encoded = F.transform(_apart(F.col("runs"), F.col("base")), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), _encoding(m["found"]).alias("enc")))
    return based.select("row", "text", "base", _tested(encoded).alias("tested"))


def _apart(runs: Column, base: Column) -> Column:
    """The runs that overlap no base span: none that begins before and reaches in, none that begins inside."""
    kind = "struct<start:int,run:int,end:int,found:string,hit:boolean>"
    joint = F.array_sort(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("run"), b["end"].alias("end"), F.lit("").alias("found"), F.lit(False).alias("hit"))),
            F.transform(runs, lambda m: F.struct(m["start"].alias("start"), F.lit(1).alias("run"), m["end"].alias("end"), m["found"].alias("found"), F.lit(False).alias("hit"))),
        )
    )

    def marked(x: Column, hit: Column) -> Column:
        return F.struct(x["start"], x["run"], x["end"], x["found"], (x["hit"] | hit).alias("hit"))

    far = F.lit(2**31 - 1)
    forward = running(joint, F.lit(0), lambda end, x: F.when(x["run"] == 0, F.greatest(end, x["end"])).otherwise(end), lambda end, x: marked(x, end > x["start"]), kind)
    both = running(F.reverse(forward), far, lambda start, x: F.when(x["run"] == 0, F.least(start, x["start"])).otherwise(start), lambda start, x: marked(x, start < x["end"]), kind)
    free = F.transform(F.filter(both, lambda x: (x["run"] == 1) & ~x["hit"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))
    return F.when((F.size(base) > 0) & (F.size(runs) > 0), free).otherwise(runs)


def cutoffs(scanned: DataFrame, rate: float = FALSE_RATE) -> dict[int, int]:
    """Least level reported per band (of a group of alphabets, and of length): Benjamini-Hochberg on the histogram of text probabilities."""
    runs = scanned.select(F.explode("tested").alias("t")).select("t.band", "t.level", "t.even")
    counts = runs.groupBy("band", "level").agg(F.count("*").alias("n"), F.count(F.when(F.col("even"), 1)).alias("n_even"))
    down = Window.partitionBy("band").orderBy(F.col("level").desc())
    whole = Window.partitionBy("band")
    ranked = counts.select("band", "level", F.sum("n_even").over(down).alias("reported"), F.sum("n").over(whole).alias("all"))
    passing = ranked.where(F.col("all") * F.exp(-F.col("level") / 10.0) <= rate * F.col("reported"))
    return {r["band"]: r["level"] for r in passing.groupBy("band").agg(F.min("level").alias("level")).collect()}  # a row per band


def find_secrets(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] | None = None, rate: float = FALSE_RATE, with_text: bool = True) -> DataFrame:
    """Per row: ``row``, ``text`` (if asked for) and ``spans``: ``start``, ``kind`` (index into KINDS), ``end``, in order of start and kind.

    Texts are scanned and tested once: the candidates are kept in the shared checkpoint
    folder while the cut-offs are counted.
    """
    scanned = scan(docs, text_col, carry)
    scanned = durable(scanned if with_text else scanned.drop("text"))
    return _with_spans(scanned, cutoffs(scanned, rate))


def _with_spans(scanned: DataFrame, least: dict[int, int]) -> DataFrame:
    bands = _levels(least)

    def reported(t: Column) -> Column:
        return t["even"] & F.coalesce(t["level"] >= F.get(bands, t["band"]), F.lit(False))

    def outer(xs: Column) -> Column:
        # A part goes with the reported run that it is in, which stands before it in this order.
        kind = "struct<start:int,end:int,inside:boolean>"
        placed = F.array_sort(F.transform(xs, lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("back"))))
        seen = running(placed, F.lit(-1), lambda end, x: F.greatest(end, -x["back"]), lambda end, x: F.struct(x["start"], -x["back"], end >= -x["back"]), kind)
        return F.filter(seen, lambda x: ~x["inside"])

    random = _spans(outer(F.filter("tested", reported)), KINDS.index("random"))
    text = ["text"] if "text" in scanned.columns else []
    return scanned.select("row", *text, F.array_sort(F.concat("base", random)).alias("spans"))


def _levels(least: dict[int, int]) -> Column:
    """The least level of every band, null where nothing is reported."""
    return F.array(*(F.lit(least.get(b)).cast("int") for b in range(GROUPS * len(BANDS))))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _pick(x["kind"], list(KINDS)), x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``MASK``; overlapping spans become one."""
    gap = "struct<at:int,start:int>"

    def pieces(gaps: Column) -> Column:
        # A position in a long text costs a walk to it, so the text is cut in two steps.
        width = F.ceil(F.sqrt(F.size(gaps))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(gaps) - 1, width), lambda i: let(F.slice(gaps, i + 1, width), piece))

    def piece(gaps: Column) -> Column:
        first, last = F.get(gaps, F.lit(0)), F.element_at(gaps, -1)
        return let(F.substr(text, first["at"] + 1, last["start"] - first["at"]), lambda part: F.array_join(F.transform(gaps, lambda g: F.concat(F.substr(part, g["at"] - first["at"] + 1, g["start"] - g["at"]), F.lit(MASK))), ""))

    # What stands before each span; a span that begins inside an earlier one has nothing before it.
    before = running(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]), lambda at, x: F.struct(at, x["start"]), gap)
    rest = F.substr(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1)
    cut = let(F.filter(before, lambda g: g["start"] >= g["at"]), lambda gaps: F.concat(F.array_join(pieces(gaps), ""), rest))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
