"""Operator 2: quality rules by host (DataFrame functions only).

Rules are evaluated per document, failures are counted per host, every host's failure rate is shrunk towards the mean
of all hosts by a beta prior fitted to the hosts' rates (method of moments), and the host's verdict is joined back: a
document stays if it passes the base rules and its host's shrunk rate stays below the limit.

Windows of three words are equal if two rounds of 64-bit hashes (of the words, then of the three hashes) are: two
different windows of one text are taken for equal with a chance of some 2^-64 for each pair.

Defined results: a null text is an empty text (no words, base rule failed); a null host is a host of its own; a null id
stays null; rows that repeat count each, for themselves and for their host; ties can't matter, as no rule orders rows;
with one host, or hosts whose rates do not differ more than chance, the prior is as strong as PRIOR_MAX documents; a text
of any length is read whole, in its own task's memory; an empty table gives an empty result. Other columns, of any name,
pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, WORD, read, row_of, small_side, spool, table_bytes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: The host rules' further limits, per document: symbols per 100 word characters; repeated lines per 100 lines; characters a word.
MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT, WORD_CHARS = 10, 30, (2, 25)
#: A host is rejected at this shrunk rate of failing documents.
MAX_HOST_RATE = 0.7
PRIOR_MIN, PRIOR_MAX = 2.0, 1e6


def features(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Repeated three-word windows: hash every window, sort (hash, place) within the document, keep the places whose
    neighbour has the same hash, and add up what the windows at these places cover. Linear but for the sort; nothing
    is shuffled.
    """
    text = F.coalesce(text, F.lit(""))
    out = docs.select(*keep, text.alias("_t"))
    lines = F.filter(F.split("_t", "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    out = out.select("*", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"), lines.alias("_l"))
    out = out.select(
        *[c for c in out.columns if c not in ("_t", "_l", "_w")],
        F.size("_w").cast("long").alias("_n"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("_sym"),
        F.size("_l").cast("long").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("_dup"),
        F.when(F.size("_w") >= 4, F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - 3), lambda i: F.struct(F.xxhash64(F.col("_h")[i], F.col("_h")[i + 1], F.col("_h")[i + 2]).alias("h"), i.alias("i")))
    out = out.withColumn("_s", F.when(F.col("_h").isNotNull(), F.sort_array(windows)))
    again = F.filter("_s", lambda x, k: ((k > 0) & (F.get("_s", k - 1)["h"] == x["h"])) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])
    return out.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("_rep")).drop("_h", "_s", "_p")


def base_failed() -> Column:
    return (F.col("_n") < MIN_WORDS) | (100 * F.col("_rep") > MAX_REPEAT_PCT * F.col("_n"))


def rule_failed() -> Column:
    """A document counts against its host if it fails the base rules or one of the host rules."""
    return base_failed() | (100 * F.col("_sym") > MAX_SYMBOL_PCT * F.col("_chars")) | (100 * F.col("_dup") > MAX_DUP_LINE_PCT * F.col("_lines")) | (F.col("_chars") < WORD_CHARS[0] * F.col("_n")) | (F.col("_chars") > WORD_CHARS[1] * F.col("_n"))


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """counts: _host, _hnul, host_docs, host_failures. Adds host_rate, shrunk by the beta prior, and host_ok.

    Moments over hosts weighted by documents: m the pooled rate, v the weighted variance of the rates less what
    binomial noise alone makes; strength a + b = m (1 - m) / v - 1, held within [PRIOR_MIN, PRIOR_MAX]."""
    rate = F.col("host_failures") / F.col("host_docs")
    docs, failures, hosts, squares = counts.agg(F.sum("host_docs"), F.sum("host_failures"), F.count("*"), F.sum(rate * F.col("host_failures"))).first()
    m = failures / docs if docs else 0.0
    v = squares / docs - m * m - m * (1 - m) * hosts / docs if docs else 0.0
    k = min(max(m * (1 - m) / v - 1, PRIOR_MIN), PRIOR_MAX) if v > 0 else PRIOR_MAX
    shrunk = (F.col("host_failures") + F.lit(m * k)) / (F.col("host_docs") + F.lit(k))
    return counts.select("_host", "_hnul", "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk < max_rate).alias("host_ok"))


def with_verdicts(facts: DataFrame, verdicts: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """facts with their hosts' verdicts. Few hosts are broadcast. Of many, the largest (at most `limit`, as each holds
    more than its share of the documents) are broadcast, so no hot host is one task's, and the rest are joined by
    shuffle."""
    keys = ["_host", "_hnul"]
    hosts, _ = table_bytes(verdicts)
    if hosts <= limit:
        return facts.join(small_side(verdicts, limit), keys)
    docs = verdicts.agg(F.sum("host_docs")).first()[0]
    hot = F.col("host_docs") > max(1, docs // limit)
    large, small = F.broadcast(verdicts.where(hot)), verdicts.where(~hot)
    return facts.join(large, keys).unionByName(facts.join(F.broadcast(verdicts.where(hot).select(*keys)), keys, "left_anti").join(small, keys))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE, carry: bool = False) -> DataFrame:
    """Per row: its id (or, with carry, all its columns as the struct _row), the counts, base_failed, the host's
    figures and kept. The counts are worked out once and written; host table and result both read them."""
    keep = [(row_of(docs) if carry else F.col(id_col)).alias("_row"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"), F.col(host_col).isNull().cast("int").alias("_hnul")]
    facts = spool(features(docs, F.col(text_col), keep), "facts")
    counts = spool(facts.groupBy("_host", "_hnul").agg(F.count("*").alias("host_docs"), F.sum(rule_failed().cast("long")).alias("host_failures")), "hosts")
    return with_verdicts(facts, host_verdicts(counts, max_rate)).select(
        "_row", F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_sym").alias("n_symbols"), F.col("_dup").alias("n_dup_lines"),
        F.col("_rep").alias("n_repeat_words"), base_failed().alias("base_failed"), (~base_failed() & F.col("host_ok")).alias("kept"), "host_docs", "host_failures", "host_rate",
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' rows that stay, with docs' columns."""
    return judge(docs, carry=True, **options).where("kept").select("_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents"))
    return out.select(F.col("_row").alias("doc_id"), *[c for c in out.columns if c not in ("_row", "host_rate")], F.round("host_rate", 6).alias("host_rate"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, source IS NULL AS hnul, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
m AS (SELECT r, i FROM g WHERE (r, g) IN (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1)),
n AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM m) GROUP BY r),
f AS (SELECT d.r, doc_id, host, hnul, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l) AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN n ON d.r = n.r),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f),
c AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words AS failed FROM b),
h AS (SELECT host, hnul, count(*)::BIGINT AS host_docs, sum(failed::INT)::BIGINT AS host_failures FROM c GROUP BY ALL),
p AS (SELECT sum(host_failures)::DOUBLE / sum(host_docs) AS m, count(*)::DOUBLE AS nh, sum(host_docs)::DOUBLE AS nd,
    sum((host_failures::DOUBLE / host_docs) * host_failures) AS q FROM h),
v AS (SELECT m, q / nd - m * m - m * (1 - m) * nh / nd AS v FROM p),
k AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1e6) ELSE 1e6 END AS k FROM v),
z AS (SELECT h.*, (host_failures + m * k) / (host_docs + k) AS host_rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_rate < 0.7) AS kept,
    host_docs, host_failures, round(host_rate, 6) AS host_rate
FROM c JOIN z ON c.host = z.host AND c.hnul = z.hnul
"""
