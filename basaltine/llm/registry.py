"""The subpackage's queries by name, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.llm import exact_dedup as exact
from basaltine.llm import chat, license_scan, mixing, pieces, quality_rules, simhash, surrogates, token_counts, toxicity, words
from basaltine.llm import pipeline as corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, and the verdicts of the base rules and of the current policy."""
    led = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~quality_rules.passes("base")
    return led.select(
        "doc_id", *quality_rules.MEASURES, "failed", base.alias("base_failed"), quality_rules.passes(quality_rules.CURRENT).alias("kept")
    )


QUERIES["op4_quality_rules"] = op4_quality_rules
ORACLES["op4_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT DISTINCT doc_id, i + k AS place FROM r, unnest([0, 1, 2]) AS u(k)),
c AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
              + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
              + CASE WHEN 10 * n_exclaims > 5 * n_words THEN 16 ELSE 0 END
              + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM b
"""


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op6_source_mix"] = op6_source_mix
ORACLES["op6_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
-- sources fill up in the order of bound / weight
f AS (SELECT *, 2.0::DOUBLE * source_size AS bound, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS k FROM w),
c AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per FROM f),
l AS (SELECT min_by(per, k) AS per FROM c WHERE weight * per <= bound),
t AS (SELECT c.source, source_size, least(bound, weight * l.per)::DOUBLE AS target FROM c, l),
r AS (SELECT d.*, length(bin(size)) AS x, source_size, target, floor(target / source_size)::BIGINT AS whole,
             (target / source_size - floor(target / source_size)) * source_size AS need,
             (('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- inclusion is in proportion to x, and certain for the classes of large x that would be over 1
k AS (SELECT source, x, need, sum(size) AS words FROM r GROUP BY ALL),
e AS (SELECT source, x, (need - coalesce(sum(words) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(x * words) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM k WHERE need > 0),
v AS (SELECT source, max(x) AS top, max_by(c, x) AS c FROM e WHERE c * x <= 1 GROUP BY source),
i AS (SELECT r.*, CASE WHEN need > 0 THEN CASE WHEN x > top THEN 1 ELSE least(v.c * x, 1) END ELSE 0 END::DOUBLE AS p FROM r LEFT JOIN v ON r.source IS NOT DISTINCT FROM v.source),
q AS (SELECT *, CASE WHEN p = 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) * (1 - p) / p END::DOUBLE AS odds FROM i),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN p > 0 AND before + size / 2.0 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document."""
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES["op8_exact_dedup"] = op8_exact_dedup
ORACLES["op8_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


QUERIES["op5_simhash_near_dedup"] = op5_simhash_near_dedup


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document under the public byte-level vocabulary."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op7_token_counts"] = op7_token_counts


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document: how many, a digest of their ids, and whether decoding gives the text again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", words.whole("text").alias("text"))
    both = pieces.decode_documents(pieces.encode_documents(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.lower(F.lpad(F.hex(F.xxhash64("ids")), 16, "0")).alias("ids_digest"),
        F.octet_length("decoded").cast("long").alias("decoded_bytes"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


QUERIES["op2_sentencepiece"] = op2_sentencepiece


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over the documents."""
    return corpus.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
if corpus.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus.ORACLE_SQL

#: A conversation that says the template's own marks, beside those of the table.
PLANTED = r"\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from the formatted text."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = PLANTED.replace("\\", "\\\\")
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    out = chat.format_conversations(table.unionByName(extra))
    out = out.select("conv", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES["op10_chat_formatting"] = op10_chat_formatting
ORACLES["op10_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(replace(text, '\', '\\')) + len(string_split(text, '</turn>')) - 1
                + length(array_to_string(regexp_extract_all(text, '#{3,}'), '')) - 2 * len(regexp_extract_all(text, '#{3,}')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + escaped + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices in every document."""
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    notices = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in license_scan.TEMPLATES.items())
    return rf"""
WITH t AS (SELECT * FROM (VALUES {notices}) AS v(license, notice)),
tw AS (SELECT license, regexp_extract_all(lower(notice), '[\p{{L}}\p{{N}}]+(?:[.''-][\p{{L}}\p{{N}}]+)*') AS w FROM t),
ts AS (SELECT license, len(w) - 4 AS m, i - 1 AS o, array_to_string(w[i:i + 4], ' ') AS s FROM tw, unnest(range(1, len(w) - 3)) AS u(i)),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+(?:[.''-][\p{{L}}\p{{N}}]+)*') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS s FROM dw, unnest(range(1, len(w) - 3)) AS u(i)),
hit AS (SELECT DISTINCT doc_id, license, m, p - o AS first, greatest(2, m // 4) AS slack FROM ds JOIN ts USING (s)),
n AS (SELECT hit.doc_id, hit.license, first, hit.m, count(DISTINCT ds.s) AS c
      FROM hit JOIN ds ON ds.doc_id = hit.doc_id AND ds.p BETWEEN first - slack AND first + hit.m - 1 + slack
      JOIN ts ON ts.license = hit.license AND ts.s = ds.s GROUP BY ALL),
d AS (SELECT license, count(DISTINCT s) AS m FROM ts GROUP BY license),
short AS (SELECT doc_id, license, i - 1 AS first FROM dw, unnest(range(1, len(w) + 1)) AS u(i), (SELECT license, w AS notice FROM tw WHERE len(w) < 5)
          WHERE w[i:i + len(notice) - 1] = notice)
SELECT doc_id, license, max(c / d.m) AS containment, min(greatest(first, 0))::BIGINT AS first_word, count(DISTINCT greatest(first, 0)) AS places
FROM n JOIN d USING (license) WHERE c / d.m >= 0.8 GROUP BY doc_id, license
UNION ALL SELECT doc_id, license, 1.0::DOUBLE, min(first)::BIGINT, count(*) FROM short GROUP BY doc_id, license
"""


QUERIES["op1_license_scan"] = op1_license_scan
ORACLES["op1_license_scan"] = _license_sql()


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, key="surrogates-1").select("doc_id", "text", "n_entities", "kinds")


QUERIES["op9_pii_surrogates"] = op9_pii_surrogates


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; the model learns only from labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    sample = toxicity.labelled_sample(docs, _table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.toxicity(docs, toxicity.fit(*sample))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans")
    )


QUERIES["op3_toxicity"] = op3_toxicity
