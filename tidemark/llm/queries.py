"""The thin ``opN_*`` queries: each applies one operator to its whole table and
derives the contract's columns from the operator's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, filter_audit, importance, mixing, ngram_lm, page_text, preference, quality_rules, secrets, sharding, simhash, token_counts
from tidemark.llm.common import read

TOKENIZER = "word_bpe_49k.json"
LONG_DOCUMENT = 2048


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the base kinds and what the randomness battery adds."""
    found = secrets.find_secrets(read(spark, sf_dir, "documents"), carry=("doc_id",), with_text=False)
    base = F.filter("spans", lambda x: x["kind"] < secrets.KINDS.index("random"))

    def of(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    out = found.select("doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), "items")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of the documents not held out."""
    docs = read(spark, sf_dir, "documents")
    found = ngram_lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    return found.withColumnRenamed("id", "doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the line rules for every document."""
    found = quality_rules.assess(read(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels not held out."""

    def held_out(column: str):
        return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0

    docs = read(spark, sf_dir, "documents")
    ranker = preference.train(docs, read(spark, sf_dir, "labels"), held_out("id"))
    scored = preference.score(docs, ranker)
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= preference.THRESHOLD).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    mixed, targets = mixing.mix(read(spark, sf_dir, "documents"), F.array("source"))
    # Each document of this table counts for one source.
    of = mixed.withColumn("key", F.get("members", F.lit(0))).join(mixing.small(targets.select("key", "source_size", "target")), "key", "left")
    return of.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


#: The conversation that every run adds, and its text, which looks like the marks of a template.
MARKED_ID, MARKED_TEXT = -7, "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and trainable text of every conversation, read back from its examples."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = [F.struct(F.lit(MARKED_ID).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(MARKED_TEXT).alias("text")) for k, role in enumerate(("user", "assistant"))]
    marked = spark.range(1).select(F.inline(F.array(*two)))
    examples = chat.expand(turns.unionByName(marked))
    per = examples.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("text"))).alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", chat.loss_text().alias("loss"))))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    read_back = per.select("conv_id", chat.read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = page_text.extract(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public word BPE tokenizer."""
    import public_tokenizers

    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LONG_DOCUMENT).alias("over_limit"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source under each of their orders."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, equal texts together."""
    docs = read(spark, sf_dir, "documents")
    found = sharding.assign(docs, sharding.plan_shards(docs, sharding.SHARDS))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by importance weights towards the benchmark, and the scores of all."""
    found = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_decontaminate": op3_decontaminate,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_quality_rules": op5_quality_rules,
    "op6_preference": op6_preference,
    "op7_mixing": op7_mixing,
    "op8_chat": op8_chat,
    "op9_page_text": op9_page_text,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_sharding": op12_sharding,
    "op13_importance": op13_importance,
}

#: The words of a text after lower-casing A-Z, as in decontaminate.tokens.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_SPACED = r"[^\x20\x09-\x0D]+"


def _quality_sql() -> str:
    """The line rules in SQL: lines with their squeezed text and words, the words of those that pass, repeated windows."""
    many = "length(s) - length(translate(s, '{}', ''))".format
    stutter = "len(list_filter(range(1, w), lambda i: string_split(s, ' ')[i] = string_split(s, ' ')[i + 1])) * 2 > w"
    closed, phrases = (x.replace("'", "''") for x in (quality_rules.CLOSED, quality_rules.PHRASES))
    breaks = f"""(w < 3 AND NOT regexp_matches(s, '{closed}')) OR (w >= 5 AND ({many('!')}) * 2 > w)
         OR (({many(quality_rules.SEPARATORS)}) >= 3 AND ({many(quality_rules.SEPARATORS)}) * 4 >= w)
         OR (w <= 12 AND regexp_matches(s, '{phrases}')) OR ({many(quality_rules.SYMBOLS)}) * 10 > w * 3 OR (w >= 4 AND {stutter})"""
    window = quality_rules.WINDOW
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS words FROM documents),
lines AS (
  SELECT r, raw, s, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END AS w
  FROM (SELECT r, raw, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM (SELECT r, unnest(string_split(t, chr(10))) AS raw FROM texts) AS a) AS b),
judged AS (SELECT r, raw, w, {breaks} AS broken FROM lines WHERE w > 0),
per AS (SELECT r, count(*) - count(DISTINCT raw) AS n_dup_lines, coalesce(sum(w) FILTER (NOT broken), 0) AS kept_words FROM judged GROUP BY r),
places AS (
  SELECT r, i, array_to_string(words[i:i + {window - 1}], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - {window - 2})) AS i FROM texts) AS c),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM places) AS d WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {window})) AS p FROM again) AS e GROUP BY r),
base AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0) AS kept_words
  FROM texts LEFT JOIN per USING (r) LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words - kept_words) * 100 <= n_words * {quality_rules.MAX_LOST} AS kept FROM failed"""


def _chat_sql() -> str:
    """Turns and losses from the conversations themselves, and the lengths that the template and its escapes make."""

    def escaped(column: str, table) -> str:
        return " + ".join([f"length({column})", *(f"length({column}) - length(replace({column}, {_sql_text(c)}, ''))" for c, _ in table)])

    frame = len(chat.HEAD) + len(chat.MID) + len(chat.TAIL)
    marked = _sql_text(MARKED_TEXT)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({MARKED_ID}, 0, 'user', {marked}), ({MARKED_ID}, 1, 'assistant', {marked})),
placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         sum({frame} + {escaped('role', chat.IN_ROLE)} + {escaped('text', chat.IN_TEXT)}) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
per AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS lines,
         coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{chat.TARGET}'), '') AS loss,
         sum(upto) FILTER (role = '{chat.TARGET}' OR k = n) AS formatted
  FROM placed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars
FROM per"""


def _sql_text(x: str) -> str:
    """A DuckDB text literal; line feeds as chr(10)."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


ORACLES: dict[str, str] = {
    "op5_quality_rules": _quality_sql(),
    "op8_chat": _chat_sql(),
    "op3_decontaminate": f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0) AS a),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (SELECT DISTINCT n FROM windows) AS s) AS b),
found AS (SELECT DISTINCT r, i, n, item_id FROM places JOIN windows USING (n, gram)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) AS c GROUP BY r),
of AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) AS d GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM texts LEFT JOIN hit USING (r) LEFT JOIN of USING (r)""",
    "op11_filter_audit": """
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step, bits FROM orders),
texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
masks AS (
  SELECT part, coalesce(quality, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > first_id)::INT AS mask
  FROM texts LEFT JOIN (
    SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) AS l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
counted AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before, mask, n, good, toxic
  FROM steps, cells),
per AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN mask & (coalesce(before, 0)::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & coalesce(before, 0)::INT <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM per""",
    "op13_importance": f"""
WITH RECURSIVE crc(k, value) AS (
  SELECT 0, range(256) UNION ALL
  SELECT k + 1, list_transform(value, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FROM crc WHERE k < 8),
steps AS (SELECT value FROM crc WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, 0 AS target, doc_id, {_WORDS} AS w FROM documents
  UNION ALL SELECT -row_number() OVER (), 1, NULL, {_WORDS} FROM benchmark),
runs AS (SELECT r, target, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (SELECT unnest([1, 2, 3]) AS n) AS s),
features AS (SELECT r, target, array_to_string(w[i:i + n - 1], ' ') AS f FROM runs),
bytes AS (
  SELECT f, list_transform(range(0, octet_length(encode(f))), lambda k: ('0x' || substr(hex(encode(f)), CAST(2 * k + 1 AS INT), 2))::BIGINT) AS b
  FROM (SELECT DISTINCT f FROM features) AS d),
buckets AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(value[CAST(xor(c, x) & 255 AS INT) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM bytes, steps),
held AS (SELECT r, target, bucket, count(*) AS n FROM features JOIN buckets USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t FROM held GROUP BY bucket),
whole AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM sums, whole),
weighed AS (SELECT r, sum(n) AS n_features, sum(n * g) AS weight FROM held JOIN gain USING (bucket) WHERE target = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE target = 0),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS place, count(*) OVER () AS may FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * may // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)""",
}
