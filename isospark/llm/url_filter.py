"""Operator 4, URL filters (DataFrame functions only): rules over host and path, then a model.

The rule that fits and is longest decides; where none fits, a logistic regression on hashed
character n-grams of host and path does, trained from a small labelled URL table.  Training is
one expression over that table in one row: a fold of gradient steps over an array of factors.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of the n-grams of hosts, and of those of paths after them.
HOST_BUCKETS, PATH_BUCKETS = 3584, 512
BUCKETS = HOST_BUCKETS + PATH_BUCKETS
GRAMS = (3, 4, 5)
#: The rate of a step falls from epoch to epoch; weights shrink a little at each, by the share that was best in
#: five-fold cross-validation on the table.
EPOCHS, RATE, SHRINK = 15, 1.5, 2e-4
#: Probability from which a URL is blocked: at it, cross-validation on the table allows 95 % of its other sites.
CUT = 0.55
#: Rows of a labelled table that are fitted to at most, as they are folded in one task; more are sampled by a hash.
MAX_LABELLED = 2000

#: The small labelled table: URLs of well-known sites, by two headings; none is of a given page table.
LABELLED = Path(__file__).with_name("labelled_urls.txt")


def labelled_table() -> list[tuple[str, int]]:
    """URLs and labels (1: unwanted) of ``LABELLED``; lines that begin with ``#`` head the URLs of a label."""
    rows, label = [], None
    for line in LABELLED.read_text(encoding="utf-8").splitlines():
        if line.startswith("#"):
            label = int(line.startswith("# unwanted"))
        elif line:
            rows.append((line, label))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` (A-Z lower-cased) and the path up to ``?`` or ``#``; both empty without one."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as ``host + path``, and its verdict; null where none fits.

    ``rules`` are (verdict, host, path).  Longest first, so the first that fits decides; of equally
    long ones, which then have the same text, the first given.
    """
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def grams(host: Column, path: Column) -> Column:
    """Hashed character n-grams of host and path, each with its ends marked; repeats included.

    A leading ``www.`` and the registry's ending of a host are left out: in a small table they tell
    where its sites happen to lie, not what they are.
    """
    name = F.regexp_replace(host, r"^www\.|(\.(co|ac|gov|org|com))?\.[a-z]+$", "")

    def of(text: Column, kind: str, n: int) -> Column:
        first, size = (0, HOST_BUCKETS) if kind == "h" else (HOST_BUCKETS, PATH_BUCKETS)
        marked = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
        last = F.length(marked) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: (F.pmod(F.xxhash64(F.substring(marked, i, F.lit(n)), F.lit(kind)), F.lit(size)) + first).cast("int"))

    return F.concat(*[of(text, kind, n) for text, kind in ((name, "h"), (path, "p")) for n in GRAMS])


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", epochs: int = EPOCHS) -> list[float]:
    """Weights of the buckets and, last, the bias, from a table of URLs and 0/1 labels.

    Null labels are left out; an empty table gives zero weights.  Of a table of more than ``MAX_LABELLED``
    rows those with the least hashes of their URLs are used.
    """
    host, path = host_and_path(F.col(url_col))
    labelled = labelled.where(F.col(label_col).isNotNull()).orderBy(F.xxhash64(url_col), url_col, label_col).limit(MAX_LABELLED)
    rows = labelled.select(grams(host, path).alias("g"), F.col(label_col).cast("double").alias("y"), F.xxhash64(url_col).alias("o"))
    rows = rows.withColumn("i", F.row_number().over(Window.orderBy("o", "y")) - 1)
    # Weights are a sum of rows, so each step changes one row's factor; what rows have in common is
    # joined once, by bucket, and the fold is over an array of as many factors as there are rows.
    parts = rows.select("i", F.size("g").alias("m"), F.explode("g").alias("b")).groupBy("i", "m", "b").agg(F.count("*").alias("c"))
    parts = parts.select("i", "b", (F.col("c") / F.sqrt(F.col("m").cast("double"))).alias("v"))
    sql = f"""
        WITH pairs AS (
          SELECT a.i, b.i AS j, a.v * b.v AS k FROM {{parts}} a JOIN {{parts}} b ON a.b = b.b
          UNION ALL SELECT i, explode(sequence(0, (SELECT max(i) FROM {{rows}}))) AS j, 1D AS k FROM {{rows}}),
        grid AS (SELECT i, j, sum(k) AS k FROM pairs GROUP BY i, j),
        near AS (SELECT i, transform(sort_array(collect_list(struct(j, k))), x -> x.k) AS ks FROM grid GROUP BY i),
        held AS (SELECT sort_array(collect_list(struct(i, y, ks))) AS rows FROM near JOIN {{rows}} USING (i))
        SELECT aggregate(flatten(transform(sequence(0, {epochs - 1}), n -> transform(rows, r -> struct(r.i AS i, r.y AS y, r.ks AS ks, {RATE} / (1 + n / 4D) AS rate)))), array_repeat(0D, size(rows)), (f, r) ->
          get(transform(
            array(r.rate * (r.y - 1 / (1 + exp(-aggregate(zip_with(f, r.ks, (a, b) -> a * b), 0D, (s, z) -> s + z))))),
            e -> transform(f, (a, j) -> CASE WHEN j = r.i THEN a * {1 - SHRINK} + e ELSE a * {1 - SHRINK} END)), 0)) AS f
        FROM held
    """
    spark = labelled.sparkSession
    factors = spark.sql(sql, parts=parts, rows=rows.select("i", "y")).select(F.posexplode("f").alias("i", "f"))
    weights = [0.0] * (BUCKETS + 1)
    for r in parts.join(factors, "i").groupBy("b").agg(F.sum(F.col("v") * F.col("f")).alias("w")).collect():  # at most BUCKETS rows
        weights[r.b] = r.w
    weights[-1] = factors.agg(F.coalesce(F.sum("f"), F.lit(0.0))).first()[0]
    return weights


def probability(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's probability that a URL is unwanted."""
    table = F.from_json(F.lit(json.dumps(weights[:-1])), "array<double>")
    g = grams(host, path)
    total = F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return 1 / (1 + F.exp(-(F.lit(weights[-1]) + total / F.sqrt(F.greatest(F.size(g), F.lit(1)).cast("double")))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_table(), "url string, label int")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", cut: float = CUT) -> DataFrame:
    """``(id_col, host, path, rule, verdict, score)``, one row per row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path; no rule fits it and the model
    judges the empty strings.  Of rules of one length that fit the first given decides; a URL is judged
    whole, however long; repeated rows are judged alike.  Null and repeated ids keep a row each, further columns are not read,
    an empty table gives none.
    """
    weights = [round(w, 9) for w in train(labelled)]
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = probability(F.col("host"), F.col("path"), weights)
    rows = parts.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("v"), score.alias("score"))
    return rows.select(id_col, "host", "path", "rule", F.coalesce("v", F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score")
