"""Registered queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.session import lean

from . import decontaminate, divergence, exact_dedup, html_templates, license_scan, mixing, ordinal, quality_rules, simhash, spelling, token_counts, url_filter, warc
from .common import scratch_path, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents by the ordinal model of the label table."""
    return ordinal.classify(_table(spark, sf_dir, "documents"), ordinal.grades_of(_table(spark, sf_dir, "labels")))


def op2_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, site templates removed."""
    return html_templates.main_text(_table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of those within two bits."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Verdict, host and path of the URL rules.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of rules and model on the URLs of all pages."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES, url_filter.labelled_urls(spark))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back: responses with their payloads, revisits by headers alone."""
    path = scratch_path(spark, "warc")
    warc.write(warc.records(_table(spark, sf_dir, "pages")), path)
    full = warc.read(spark, path).where("record_type = 'response'")
    heads = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    digest = warc.base32(F.sha1("payload"))
    out = full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to").union(
        heads.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
    return out.withColumns({"page_id": warc.page_id(F.col("record_id")), "refers_to": warc.page_id(F.col("refers_to"))}).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wordings in all documents: matched words, coverage of the wording, and spans."""
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.license_table(spark))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a window of ten words of a benchmark item."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document."""
    import public_tokenizers

    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rule ledger of all documents under two policies, the rule that alone rejects a document, and the ablation of that rule."""
    ledger = written(quality_rules.ledger(_table(spark, sf_dir, "documents")), "ledger")
    base = F.col("failed_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE))) != 0
    rows = quality_rules.apply_policy(ledger).withColumns({"base_failed": base, "only_rule": quality_rules.only_rule()})
    # Broadcast: a row for each rule of the policy.
    ablated = F.broadcast(quality_rules.ablation(ledger).withColumnRenamed("rule", "only_rule"))
    return rows.join(ablated, "only_rule", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits", "only_rule", "n_rejected", "n_only_this", "n_kept_without"
    )


#: Shares of the languages that the mixture is to have.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of domains: documents with a row in ``labels``, and their language."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading rates of all documents such that expected language totals match ``TARGETS``."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, domain_labels(docs, _table(spark, sf_dir, "labels")), TARGETS)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its neighbours' number, its form and its root."""
    return spelling.variants(_table(lean(spark), sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the words of every source are from those of the others of its language, and the terms it has most beyond them."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, the one of its equals that stays, and how many they are."""
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_html_templates, op3_simhash, op4_url_filter, op5_warc, op6_license_scan, op7_decontaminate, op8_token_counts, op9_quality_rules, op10_mixing, op11_spelling_variants, op12_source_divergence, op13_exact_dedup)}


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, list_slice(w, i, least(i + 9, len(w))) AS g
      FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT DISTINCT len(g) AS n FROM p),
x AS (SELECT rid, i, list_slice(w, i, i + n - 1) AS g, n FROM d, n, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
h AS (SELECT DISTINCT rid, i, n, item_id FROM x JOIN p USING (g)),
o AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, j FROM h, unnest(range(i, i + n)) AS t(j)) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN o USING (rid) LEFT JOIN m USING (rid)
"""

#: The measurements and rules of the ledger in DuckDB SQL, over a table ``{docs}``; shared with the pipeline's oracle.
MEASURED = r"""
{name}w AS (SELECT *, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM {docs}),
{name}g AS (SELECT rid, i, list_slice(w, i, i + 7) AS g FROM {name}w, unnest(range(1, len(w) - 6)) AS t(i) WHERE len(w) >= 8),
{name}r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM {name}g), range(8) AS t(k)
       WHERE c > 1 GROUP BY rid),
{name}m AS (SELECT x.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
       length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
       length(regexp_replace(coalesce(text, ''), '[^!?]', '', 'g'))::BIGINT AS n_marks
       FROM {name}w x LEFT JOIN {name}r USING (rid)),
{name}f AS (SELECT *, ({bits})::BIGINT AS failed_bits FROM {name}m)
"""


def measured_sql(docs: str, name: str) -> str:
    bits = " | ".join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, (_, c) in enumerate(quality_rules.RULES))
    return MEASURED.replace("{bits}", bits).replace("{docs}", docs).replace("{name}", name)


_RULE_BITS = ", ".join(f"('{r}', {quality_rules.BIT[r]})" for r in quality_rules.POLICIES[quality_rules.DEFAULT])
_OP9 = f"""
WITH {measured_sql('documents', 'q')},
v AS (SELECT * FROM (VALUES {_RULE_BITS}) AS t(only_rule, b)),
p AS (SELECT *, failed_bits & {quality_rules.mask(quality_rules.DEFAULT)} AS left_bits FROM qf),
a AS (SELECT only_rule, count(*) FILTER (left_bits & b <> 0) AS n_rejected, count(*) FILTER (left_bits = b) AS n_only_this,
       count(*) FILTER (left_bits = left_bits & b) AS n_kept_without FROM p, v GROUP BY only_rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & {quality_rules.mask(quality_rules.BASE)} <> 0 AS base_failed,
       failed_bits & {quality_rules.mask(quality_rules.DEFAULT)} = 0 AS kept, failed_bits,
       v.only_rule, n_rejected, n_only_this, n_kept_without
FROM p LEFT JOIN v ON left_bits = b LEFT JOIN a ON v.only_rule = a.only_rule
"""


_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)"
_OP5 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS sha, min(page_id) OVER (PARTITION BY b) AS low FROM p),
c AS (SELECT DISTINCT sha, ('0x' || substr(sha, 5 * g + 1, 5))::BIGINT AS v, g, s FROM h, range(8) AS t(g), unnest([15, 10, 5, 0]) AS u(s)),
d AS (SELECT sha, string_agg({_BASE32}, '' ORDER BY g, s DESC) AS payload_digest FROM c GROUP BY sha)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> low THEN low END AS refers_to
FROM h JOIN d USING (sha)
"""


#: The checksum is CRC-32 with its usual polynomial, by a table of 256 entries.
_OP11 = r"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i)) AS t),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
      WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT doc_id, run, n, t, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM r, c),
h AS (SELECT run, n, coalesce(xor(list_reduce(bytes, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]), 4294967295::BIGINT), 4294967295), 1) AS h FROM b),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS s FROM v, unnest(range(length(word))) AS u(k)),
l AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.k = b.k AND a.s = b.s AND length(a.word) = length(b.word) AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.s = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.s = v.word),
m AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM l GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM v LEFT JOIN m USING (word)),
p AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT p.word, f.form, step + 1 FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(root, step) AS root FROM p GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
z AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS n_all FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n_all) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v FROM z),
p AS (SELECT lang, source, term, n, (1 + (1000000000 * (n + 5)) // (total + 5 * v))::BIGINT AS p, (1 + (1000000000 * (n_all + 5)) // (lang_total + 5 * v))::BIGINT AS q FROM s),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""

_OP13 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY doc_id DESC NULLS LAST, rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": _OP5, "op7_decontaminate": _OP7, "op9_quality_rules": _OP9, "op11_spelling_variants": _OP11, "op12_source_divergence": _OP12, "op13_exact_dedup": _OP13}
