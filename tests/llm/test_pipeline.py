"""The pipeline's stages, each against a plain version over its own input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isospark.llm import decontaminate, ordinal, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "decontamination", "mixing"]
    for df in steps[1:5]:
        assert df.columns == steps[0].columns


def test_rules(steps):
    def fails(text):
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure_bytes(text.encode())))
        return [n for n, c in quality_rules.RULES if eval(c.replace("AND", "and"), {}, m)]

    before, after = rows_of(steps[0]), rows_of(steps[1])
    assert set(after) == {i for i, r in before.items() if not fails(r.text)}
    assert all(after[i] == before[i] for i in after)


def test_classifier(spark, steps):
    before, after = rows_of(steps[1]), rows_of(steps[2])
    model = ordinal.fit(steps[1], ordinal.grades_of(spark.read.parquet(f"{SF}/labels.parquet")), 3)
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    want = set()
    for i, r in before.items():
        idx, val = ordinal.features(r.text.encode())
        s = sum(weights.get(b, 0.0) * v for b, v in zip(idx.tolist(), val.tolist()))
        if 1 / (1 + np.exp(model.thresholds[-1] - s)) >= ordinal.KEEP:
            want.add(i)
    assert set(after) == want


def test_near_dedup(steps):
    """Groups by the exact similarity of five-word sets, every pair tried."""
    before, after = rows_of(steps[2]), rows_of(steps[3])

    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {i: shingles(r.text) for i, r in before.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(after) == {i for i in ids if root(i) == i} and len(after) < len(before)


def test_decontamination(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def folded(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    windows = set()
    for t in items:
        w = folded(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def hit(t):
        w = folded(t)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    before, after = rows_of(steps[3]), rows_of(steps[4])
    assert not any(hit(r.text) for r in after.values())
    for i, r in before.items():
        if not hit(r.text):
            assert after[i].text == r.text
        elif i in after:
            assert set(folded(after[i].text)) <= set(folded(r.text)) and after[i].n_chars == len(after[i].text)
    assert any(hit(r.text) for r in before.values())
    assert decontaminate.WINDOW == 10


def test_mixing(steps):
    before, after = rows_of(steps[4]), rows_of(steps[5])
    assert set(after) <= set(before) and all(r.rate > 0 and r.converged for r in after.values())
    assert all(r.text == before[i].text and r.source == before[i].source for i, r in after.items())
    t = np.array([r.rate * r.n_tokens for r in after.values()])
    totals = t @ np.array([r.posterior for r in after.values()])
    n = sum(len((r.text or "").split()) for r in before.values())
    assert np.allclose(totals / totals.sum(), list(corpus_pipeline.TARGETS.values()), atol=1e-3)
    assert totals.sum() == pytest.approx(n, rel=0.02)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema) if "text" in docs.columns else docs


def test_awkward_rows(spark):
    """Null and empty texts, null and repeated ids, extra columns with the names that the stages use inside."""
    good = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars > 2000").limit(6).collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good]
    rows += [(rows[0][0], rows[0][1], "en", "again", 1), (None, rows[1][1] + " tail", "en", "s", 1), (None, rows[1][1] + " tail", "en", "s", 1)]
    rows += [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \n ", "en", "s", 3), (9004, rows[2][1] * 40, "en", "long", 1)]
    names = ["node", "component_id", "fp", "grade", "_m", "key", "row", "failed_bits", "hit_spans", "n", "_cut"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    stages = dict(corpus_pipeline.STAGES)
    ruled = stages["quality_rules"](spark, docs, SF)
    kept = [r.doc_id for r in ruled.collect()]
    assert ruled.columns == docs.columns and not {9001, 9002, 9003} & set(kept) and kept.count(rows[0][0]) == 2 and kept.count(None) == 2
    judged = stages["quality_classifier"](spark, docs, SF)
    assert judged.columns == docs.columns and judged.count() <= docs.count()
    one = stages["near_dedup"](spark, docs, SF)
    ids = [r.doc_id for r in one.collect()]
    assert one.columns == docs.columns and ids.count(None) == 2 and len(set(ids)) == len(ids) - 1 and sum(i in (9001, 9002, 9003) for i in ids) == 1
    clean = stages["decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns and not {9001, 9002, 9003} & {r.doc_id for r in clean.collect()}
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.count() == docs.count() and all(r.rate > 0 for r in mixed.collect())


def test_columns_of_any_name_come_out_as_they_went_in(spark):
    """Names that the stages use inside, as text columns, also in another case."""
    text = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    names = ["measures", "MEASURES_", "score", "Score_", "_isospark_measures", "_isospark_score"]
    docs = text.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    ratings = ordinal.grades_of(spark.read.parquet(f"{SF}/labels.parquet"))
    for out in (quality_rules.keep_passing(docs), ordinal.keep_good(docs, ratings)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
