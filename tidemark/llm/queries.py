"""The training-data queries p3, p7, p8, p9 with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, table
from .leakage import leaked
from .nearest import nearest_join
from .packing import pack
from .stuffing import calibrated, function_words, stuffed_pages, text_measures, word_frequencies
from .tokens import token_counts


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    usable = table(spark, d, "equity_samples").where("sample_mid IS NOT NULL")
    return nearest_join(table(spark, d, "fills"), usable, "run_id", "ts", "fill_id", "sample_ts", "sample_id", 3_000_000_000)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).where("sample_id IS NOT NULL").select("fill_id", "sample_id")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every fill, with -1 for what it lacks."""
    n = _nearest(spark, d)
    return n.select("run_id", *[F.coalesce(c, F.lit(-1).cast("bigint")).alias(c) for c in ("ts", "fill_id", "sample_id", "distance")])


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialize(token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return pack(sizes, "doc_id", "n_tokens", table(spark, d, "container_specs"), "spec_id", "capacity_tokens").select(
        "container_id", F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity").cast("int").alias("capacity_tokens"), "doc_id", "piece_no",
        F.col("from_unit").alias("token_from"), F.col("n_units").alias("n_tokens"),
    )


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of container: containers, tokens in them, and the unused share."""
    bins = p7_packed(spark, d).groupBy("container_id", "spec_id", "capacity_tokens").agg(F.sum("n_tokens").alias("used"))
    return bins.groupBy("spec_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.round(1 - F.sum("used") / F.sum("capacity_tokens"), 6).alias("unused")
    )


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must keep to, counted: documents that are missing, come in a wrong number of pieces or with tokens missing or doubled, containers that are overfull or of an unknown kind."""
    docs, specs = table(spark, d, "documents"), table(spark, d, "container_specs")
    packed = materialize(p7_packed(spark, d))
    top = specs.agg(F.max("capacity_tokens")).first()[0]
    sizes = token_counts(docs, "doc_id", "text")
    got = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_from") + F.col("n_tokens")).alias("end"))
    want = sizes.join(got, "doc_id", "full").select(F.greatest(F.ceil(F.col("n_tokens") / top), F.lit(1)).alias("due"), "n_tokens", "pieces", "tokens", "end")
    one = want.agg(
        F.count("n_tokens").alias("n_docs"), F.count_if(F.col("pieces").isNull() | F.col("n_tokens").isNull()).alias("n_missing"), F.count_if(F.col("pieces") != F.col("due")).alias("n_split_wrong"),
        F.count_if((F.col("tokens") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens"))).alias("n_tokens_wrong"),
    )
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.max("capacity_tokens").alias("room"), F.countDistinct("spec_id", "capacity_tokens").alias("kinds"))
    known = packed.select("spec_id", "capacity_tokens").distinct().join(specs.select("spec_id", "capacity_tokens"), ["spec_id", "capacity_tokens"], "left_anti").count()
    two = bins.agg(F.count_if((F.col("used") > F.col("room")) | (F.col("kinds") > 1)).alias("n_overfull")).first()[0]
    return one.withColumns({"n_overfull": F.lit(two).cast("bigint"), "n_unknown_kinds": F.lit(known).cast("bigint")})


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d)


def _stuffed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    known = function_words(materialize(word_frequencies(docs, "text", "lang")))
    measures = materialize(text_measures(docs, "doc_id", "text", "lang", known))
    return stuffed_pages(measures, calibrated(measures))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _stuffed(spark, d).select("doc_id")


def p9_measures(spark: SparkSession, d: str) -> DataFrame:
    return _stuffed(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of words, pairs and lines of every text as it stands, links and mark-up included."""
    m = text_measures(table(spark, d, "documents"), "doc_id", "text", "lang", markup=False)
    return m.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("top_word", "top_pair", "same_lines")])


QUERIES = {f.__name__: f for f in (p3_found, p3_pairs, p7_packed, p7_fill, p7_invariants, p8_found, p8_report, p9_found, p9_measures, p9_shares)}

_P3 = """s AS (SELECT run_id, sample_ts, min(sample_id) AS sample_id FROM equity_samples WHERE sample_ts IS NOT NULL AND sample_mid IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL),
f AS (SELECT DISTINCT run_id, ts, fill_id FROM fills),
c AS (SELECT f.*, s.sample_id, abs(s.sample_ts - f.ts) AS distance, row_number() OVER (PARTITION BY f.run_id, f.ts, f.fill_id ORDER BY abs(s.sample_ts - f.ts), s.sample_ts) AS k
  FROM f LEFT JOIN s ON s.run_id = f.run_id AND s.sample_ts BETWEEN f.ts - 3000000000 AND f.ts + 3000000000)"""
_P8 = """it AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
ir AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 15], ' ') AS r, FROM (SELECT item_id, w, unnest(range(1, len(w) - 14)) AS p FROM it)),
dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 15], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 14)) AS p FROM dt))"""
_P9_WORD = "(?:[a-z0-9_]|[^\\x00-\\x7F])"
_P9 = f"""t AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(ws[2:] || [NULL]) AS v FROM (SELECT doc_id, regexp_extract_all(s, '{_P9_WORD}+') AS ws FROM t) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
a AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, count(*) AS c FROM w GROUP BY doc_id, w) GROUP BY doc_id),
b AS (SELECT doc_id, max(c) AS top2 FROM (SELECT doc_id, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY doc_id, w, v) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS k, count(DISTINCT r) AS d FROM (SELECT doc_id, regexp_extract(unnest(string_split(s, chr(10))), '(?s)(?:{_P9_WORD}|\\x01).*') AS r FROM t) WHERE r <> '' GROUP BY doc_id)"""

ORACLES = {
    "p7_invariants": "SELECT count(*) AS n_docs, 0::BIGINT AS n_missing, 0::BIGINT AS n_split_wrong, 0::BIGINT AS n_tokens_wrong, 0::BIGINT AS n_overfull, 0::BIGINT AS n_unknown_kinds FROM documents",
    "p9_shares": f"""WITH {_P9} SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(round((top - 1) / n, 6), 0) AS top_word, coalesce(round(2 * (top2 - 1) / n, 6), 0) AS top_pair,
  coalesce(round((k - d) / k, 6), 0) AS same_lines FROM t LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "p3_found": f"WITH {_P3} SELECT fill_id, sample_id FROM c WHERE k = 1 AND sample_id IS NOT NULL",
    "p3_pairs": f"WITH {_P3} SELECT run_id, coalesce(ts, -1) AS ts, fill_id, coalesce(sample_id, -1) AS sample_id, coalesce(CASE WHEN sample_id IS NOT NULL THEN distance END, -1) AS distance FROM c WHERE k = 1",
    "p8_report": f"WITH {_P8} SELECT doc_id, item_id, count(*) AS n_runs FROM ir JOIN dr USING (r) GROUP BY doc_id, item_id",
    "p8_found": f"WITH {_P8} SELECT DISTINCT doc_id, item_id FROM ir JOIN dr USING (r)",
}
