"""Operator 10, mixing sources to target weights by soft membership (DataFrame functions only).

1. A multinomial naive Bayes classifier is fitted to a labelled table: word buckets are counted
   per domain, and smoothed log-odds become one constant array per domain.
2. Every document gets posteriors over the domains: its words' log-likelihoods are summed and
   tempered to the evidence of ``EVIDENCE`` (average) words, so membership stays soft in long texts.
3. Nonnegative rates ``r_i`` (how often a document is read) are fitted by projected gradient
   steps on the squared gap between the expected domain totals ``sum_i r_i t_i p_ik`` and the
   targets.  A step needs only K totals and a K x K matrix, summed over all documents in one
   aggregate; a rate is a function of the posteriors and the steps so far, so rates are never
   stored between steps, and nothing grows on the driver.
"""

from __future__ import annotations

import json
import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

BUCKETS = 4096
#: Labelled rows used for fitting at most, chosen by a hash of the id.
FIT_ROWS = 4000
#: Words whose evidence a posterior weighs at most.
EVIDENCE = 4
STEPS = 200
TOLERANCE = 1e-6
#: Lengths of plain steps that are tried, in units of the one that always gains.
LENGTHS = (1, 4, 16, 64)
#: The rates rest when the best of the tries takes less than this share off the squared gap.
RESTING = 1e-4


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _constant(values: list[float]) -> Column:
    """A constant array, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", fit_rows: int = FIT_ROWS) -> tuple[list[list[float]], list[float]]:
    """Log-likelihoods of the buckets per domain, and log priors.

    ``labelled(id_col, domain_col)`` names rows of ``docs``; at most ``fit_rows`` of it are used, and of
    several rows of ``docs`` with one id the text with the least hash.  Rows with another or a null
    domain are left out; a domain without rows gets the smoothed uniform distribution.
    """
    rows = labelled.where(F.col(domain_col).isin(domains)).select(F.col(id_col).alias("i"), F.col(domain_col).alias("d"))
    few = rows.orderBy(F.xxhash64("i"), "i", "d").limit(fit_rows)
    # Broadcast: ``limit`` bounds the side, and texts are only read where a row is chosen.
    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(few), "i")
    chosen = cut(found.groupBy("i", "d").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("least")).select("d", "least.t"))
    counts = chosen.select("d", F.explode(words(F.col("t"))).alias("w")).groupBy("d", bucket(F.col("w")).alias("b")).count()
    per = {(r.d, r.b): r["count"] for r in counts.collect()}  # at most domains x BUCKETS rows
    n = {r.d: r["count"] for r in chosen.groupBy("d").count().collect()}
    logs = []
    for d in domains:
        c = [per.get((d, b), 0) + 0.5 for b in range(BUCKETS)]
        total = math.log(sum(c))
        logs.append([round(math.log(x) - total, 6) for x in c])
    everyone = sum(n.values()) + len(domains)
    return logs, [math.log((n.get(d, 0) + 1) / everyone) for d in domains]


def scores_of(buckets: Column, n_words: Column, logs: list[list[float]], priors: list[float], evidence: int = EVIDENCE) -> Column:
    """Tempered log scores of the domains for an array of word buckets; the log priors for a text without words."""
    temper = F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest(n_words, F.lit(1)))

    def total(table: Column) -> Column:
        return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))

    return F.array(*[F.lit(prior) + temper * total(_constant(values)) for values, prior in zip(logs, priors)])


def membership(docs: DataFrame, logs: list[list[float]], priors: list[float], id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``(id_col, n_tokens, posterior)``, one row per row of ``docs``; with ``whole`` its columns as the struct ``row`` in place of the id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if whole else F.col(id_col)
    w = docs.select(row, F.transform(words(F.col(text_col)), bucket).alias("b"))
    first = w.columns[0]
    s = w.select(first, F.size("b").cast("long").alias("n_tokens"), scores_of(F.col("b"), F.size("b"), logs, priors).alias("s"))
    e = s.select(first, "n_tokens", F.expr("transform(s, x -> exp(x - array_max(s)))").alias("e"))
    return e.select(first, "n_tokens", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))").alias("posterior"))


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Least-norm-like solution of a small symmetric system, by elimination with a ridge."""
    k = len(b)
    ridge = 1e-9 * (sum(a[i][i] for i in range(k)) / k + 1e-300)
    m = [[*a[i], b[i]] for i in range(k)]
    for i in range(k):
        m[i][i] += ridge
    for i in range(k):
        p = max(range(i, k), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(k):
            if r != i and m[i][i]:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [m[i][k] / m[i][i] if m[i][i] else 0.0 for i in range(k)]


class Fit(NamedTuple):
    """Steps from a rate of 1, the gap that they leave as a share of the target tokens, and whether they came to rest.

    At rest with a gap, no nonnegative rates reach the targets; not at rest, ``steps`` were too few.
    """

    steps: list[list[float]]
    gap: float
    converged: bool


def _moved(base: Column, posterior: str, g) -> Column:
    """A rate after one step along the posteriors, cut at 0."""
    return F.greatest(F.lit(0.0), base - g(F.col(posterior)))


def rate(posterior: str, steps: list[list[float]]) -> Column:
    """The rate after the given steps: from 1, each step moves along the posteriors and is cut at 0."""
    if not steps:
        return F.lit(1.0)
    table = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    along = lambda g: lambda p: sum((p[k] * F.get(g, F.lit(k)) for k in range(len(steps[0]))), F.lit(0.0))
    return F.aggregate(table, F.lit(1.0), lambda r, g: _moved(r, posterior, along(g)))


def fit_steps(members: DataFrame, targets: list[float], posterior: str = "posterior", tokens: str = "n_tokens", steps: int = STEPS) -> Fit:
    """Projected gradient steps that bring the expected totals to ``targets`` (in tokens).

    In rates, the gradient of the squared gap is ``t_i p_i . gap``; in the metric of the tokens it
    is ``p_i . gap``, and the matrix ``sum t_i p_ik p_il`` over the rates that can move scales it.
    That step and plain ones of several lengths, the shortest of which gains always, are tried in one
    pass, and the best is taken.  Targets that no nonnegative rates reach are approached in the
    least-squares sense, until no step gains; ``steps`` that end before that end with a warning.
    """
    k = len(targets)
    done: list[list[float]] = []
    scale = max(sum(targets), 1.0)
    t = F.col(tokens).cast("double")

    def summed(tries: list[list[float]]) -> list[tuple[float, list[float]]]:
        """Squared gap and totals after each of the tries, by one pass."""
        base = members.select(tokens, posterior, rate(posterior, done).alias("_r"))
        after = [_moved(F.col("_r"), posterior, lambda p, g=g: sum((p[i] * F.lit(x) for i, x in enumerate(g)), F.lit(0.0))) for g in tries]
        rated = base.select(tokens, posterior, *[r.alias(f"_r{j}") for j, r in enumerate(after)])
        row = rated.agg(*[F.sum(t * F.col(f"_r{j}") * F.col(posterior)[i]).alias(f"s{j}_{i}") for j in range(len(tries)) for i in range(k)]).first()
        totals = [[row[f"s{j}_{i}"] or 0.0 for i in range(k)] for j in range(len(tries))]
        return [(sum((x - y) ** 2 for x, y in zip(s, targets)), s) for s in totals]

    def gram() -> list[list[float]]:
        rated = members.select(tokens, posterior, rate(posterior, done).alias("_r"))
        sums = [F.sum(F.when(F.col("_r") > 0, t * F.col(posterior)[i] * F.col(posterior)[j])).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
        row = rated.agg(*sums).first()
        return [[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]

    gap, s = summed([[0.0] * k])[0]
    a = gram()
    # No rate is 0 yet, so this bounds the curvature for all later steps.
    bound = max(sum(abs(x) for x in row) for row in a) or 1.0
    rested = gap <= (TOLERANCE * scale) ** 2
    while not rested and len(done) < steps:
        left = [x - y for x, y in zip(s, targets)]
        tries = [_solve(a, left), *[[f * x / bound for x in left] for f in LENGTHS]]
        (new, totals), g = min(zip(summed(tries), tries), key=lambda x: x[0][0])
        if new >= gap * (1 - RESTING):
            rested = True
            break
        done.append(g)
        gap, s, a = new, totals, gram()
        rested = gap <= (TOLERANCE * scale) ** 2
    if not rested:
        warnings.warn(f"the rates have not come to rest in {steps} steps: a gap of {math.sqrt(gap) / scale:.2g} of all tokens is left", stacklevel=2)
    return Fit(done, math.sqrt(gap) / scale, rested)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", total: float | None = None, fit_rows: int = FIT_ROWS, whole: bool = False) -> DataFrame:
    """``(id_col, n_tokens, domain, posterior, rate, copies, gap, converged)``, one row per row of ``docs``.

    ``labelled(id_col, domain_col)`` gives the domains of some rows, ``targets`` the weights of the domains; expected totals are to match them times ``total``
    tokens (all tokens of ``docs`` if not given).  ``posterior`` follows the order of ``targets``,
    ``domain`` is the likeliest one, ``copies`` rounds the rate up or down by a hash of the id, so
    that its expectation is the rate; ``gap`` and ``converged`` are those of the fit, the same in all rows.  Texts without words have no tokens, the priors as
    posteriors, and a rate that counts for nothing; very long texts are read whole.  Of equally likely
    domains ``domain`` is the first.  Null and repeated ids keep a row each, repeated ones the same
    rounding; further columns are not read; an empty table gives none.

    With ``whole`` all columns of ``docs`` come first, texts included, and those above after them, with
    a ``_`` more where ``docs`` has their name.
    """
    names = list(targets)
    logs, priors = fit_domains(docs, labelled, names, id_col, text_col, domain_col, fit_rows)
    members = cut(membership(docs, logs, priors, id_col, text_col, whole))
    tokens = total if total is not None else float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    weight = sum(targets.values())
    fit = fit_steps(members, [tokens * targets[d] / weight for d in names])
    domain = F.get(F.lit(names), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    first = members.columns[0]
    out = members.select(first, "n_tokens", domain.alias("domain"), "posterior", rate("posterior", fit.steps).alias("rate"))
    chance = F.pmod(F.xxhash64(F.col("row")[id_col] if whole else F.col(id_col), F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    out = out.withColumns({"copies": copies, "gap": F.lit(fit.gap), "converged": F.lit(fit.converged)})
    return out.select("row.*", *[F.col(c).alias(free_name(docs, c)) for c in out.columns[1:]]) if whole else out
