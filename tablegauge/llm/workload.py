"""The registered queries of the training-data operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import chatformat, decontaminate, divergence, linededup, lmscore, mixing, passages, pii, qualityrules, simhash, tokenstore, urlrules, whitening
from tablegauge.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    """Register fn(spark, folder) under `name`; sql is the equivalent statement, if there is one."""

    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(ready(spark), folder)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def ready(spark: SparkSession) -> SparkSession:
    # long texts: Python gets batches of bounded bytes, not only of bounded rows
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return prepare(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


WORDS_1 = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(LOWER.format("text"))
OP1_SQL = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') item, {WORDS_1} w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) n FROM items WHERE len(w) > 0),
runs AS (SELECT DISTINCT item, n, array_to_string(w[t:t + n - 1], ' ') run
         FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) t FROM sized)),
lengths AS (SELECT DISTINCT n FROM sized),
docs AS (SELECT doc_id, {WORDS_1} w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) t FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, p.n, t, item FROM (SELECT doc_id, n, t, array_to_string(w[t:t + n - 1], ' ') run FROM places) p
         JOIN runs r ON p.run = r.run AND p.n = r.n),
covered AS (SELECT doc_id, count(DISTINCT x) n_hit FROM (SELECT doc_id, unnest(range(t, t + n)) x FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


TRIMMED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP2_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
lines AS (SELECT doc_id, i, line, {LOWER.format(TRIMMED)} k FROM (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) i FROM split)),
often AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, i, line, o.k IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN often o USING (k))
SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, folder, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_token_store")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return tokenstore.stored(table(spark, folder, "documents"), tokenizer_file())


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_lm_score")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return lmscore.scores(table(spark, folder, "documents"))


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = qualityrules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_url_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge(table(spark, folder, "pages"))


@query("op7_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"), doc_id="doc_id")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, CAST(len({SPACE_WORDS.format("coalesce(text, '')")}) AS BIGINT) size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) weight FROM s),
o AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight ratio, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source) k,
      CAST(coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) capped, CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) gone,
      CAST(sum(source_size) OVER () AS BIGINT) total, CAST(sum(weight) OVER () AS BIGINT) weights
      FROM w WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT first(CAST(total - capped AS DOUBLE) / CAST(weights - gone AS DOUBLE) ORDER BY k) share FROM o
          WHERE ratio >= CAST(total - capped AS DOUBLE) / CAST(weights - gone AS DOUBLE)),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size < share * weight THEN CAST(3 * source_size AS DOUBLE) ELSE share * weight END target
      FROM w, share),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END rate,
      CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(text))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) taken
FROM r
"""


@query("op9_mix", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.takes(table(spark, folder, "documents"))
    return taken.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_passages")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return passages.duplicate_passages(table(spark, folder, "documents"))


@query("op11_whiten")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, folder, "embeddings"))
    shares = F.array(*[F.lit(float(e)) for e in model.explained]) if model else F.array().cast("array<double>")
    each = rows.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        "whitened", shares[F.col("at")].alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


# texts with a control string in them, escaped ones as well, get one character for each
CONTROLS = chatformat.CONTROL.replace("'", "''")
OP12_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(t) + len(regexp_extract_all(t, '{CONTROLS}')) + CASE r WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5
                 ELSE 20 + length(r) + len(regexp_extract_all(r, '{CONTROLS}')) END chars FROM turns)
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) loss_sha256,
       CAST(sum(chars) AS BIGINT) formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op12_chat_format", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    chats = table(spark, folder, "conversations")
    # a conversation whose texts look like the template
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    parts = chatformat.format_chats(chats.select("conv_id", "turn", "role", "text").unionByName(own))
    return chatformat.digests(parts).withColumnRenamed("conv", "conv_id")


TERMS = r"regexp_extract_all({0}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')".format(LOWER.format("text"))
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source, {TERMS} w FROM documents),
t AS (SELECT r, lang, source, unnest(w) term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
sized AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
v AS (SELECT lang, count(*) v FROM kept GROUP BY 1),
own AS (SELECT s.lang, s.source, term, coalesce(n, 0) n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2)) // (total + 2 * v) p
        FROM sized s JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, sum(n) total FROM c GROUP BY 1),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) q
      FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) f
          FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0) f FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM own JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(row_number() OVER o AS INTEGER) AS rank
FROM items WINDOW o AS (PARTITION BY lang, source, part ORDER BY f DESC, item) QUALIFY part = 'pair' OR rank <= 10
"""


@query("op13_divergence", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))
