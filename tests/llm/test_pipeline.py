import re

import corpus_pipeline as P
from lumenlink.llm import decontaminate, dsir, kernels, mixing, pii

from .test_decontaminate import brute as leaks
from .test_mixing_dsir import fill
from .test_near import sets

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixture"]
    tables = [docs]
    for _, stage in P.STAGES:
        out = stage(spark, tables[-1], SF)
        tables.append(spark.createDataFrame(out.collect(), out.schema))
    names = [{r.doc_id: r for r in t.collect()} for t in tables]
    assert all(t.columns == columns for t in tables[:5])
    # Quality: the filter keeps exactly what the operator's verdict keeps, and few labelled good documents go.
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in dsir.importance_resampling(docs, labels).collect()}
    assert set(names[1]) == {d for d, k in verdict.items() if k}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & set(names[1])) >= 0.95 * len(good)
    # Near duplicates: all pairs.
    rows = sorted(names[1].values(), key=lambda r: r.doc_id)
    shingled = dict(zip((r.doc_id for r in rows), sets([r.text for r in rows], 5), strict=True))
    up = {d: d for d in shingled}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in shingled:
        for b in shingled:
            if b < a and shingled[a] and shingled[b] and 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    assert set(names[2]) == {d for d in up if find(d) == d}
    # Leaks: every window against every item, by exact edit distance.
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    candidates = [(d, r.text) for d, r in names[2].items() if len((r.text or "").split()) < 150 or d not in names[3]]
    known = {d for d, _ in leaks(candidates, items)}
    assert known == {d for d, _ in candidates} - set(names[3])
    # Personal data: nothing that was detected is left, all else is unchanged.
    assert set(names[4]) == set(names[3])
    for d, r in names[3].items():
        found = {r.text[s:e] for s, e, *_ in pii.detect(r.text or "")}
        assert all(x not in names[4][d].text for x in found)
        assert found or names[4][d] == r
    # Mixture: targets by the plain rule; sums reach them.
    size = {d: len(re.findall(mixing.WORD, r.text or "")) for d, r in names[4].items()}
    sources = sorted({r.source for r in names[4].values()})
    total = [sum(size[d] for d, r in names[4].items() if r.source == s) for s in sources]
    want = fill(total, [[5, 2, 1][k % 3] for k in range(len(sources))], 3)
    taken = [sum(r.taken for r in names[5].values() if r.source == s) for s in sources]
    assert all(abs(t - w) <= 0.5 for t, w in zip(taken, want, strict=True))
    assert all(0 < r.taken <= 3 * size[d] for d, r in names[5].items())


def test_run_equals_the_stages(spark):
    a = sorted(map(tuple, P.run(spark, SF).collect()))
    assert a == sorted(map(tuple, P.run(spark, SF).collect())) and a


def test_edge_rows_pass_all_stages(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a b c d e f g", "en", "s", 1), (2, "", "en", "s", 0), (3, "x" * 300_000, "en", None, 9), (3, "x" * 300_000, "en", None, 9), (4, "word " * 40_000, "en", "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, kind in (("documents", rows, schema), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [(1, None)], "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {None, 1, 2, 3, 4} and out
    empty = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_words_are_split_on_ascii_white_space_only():
    import numpy as np

    text = "a b\x0bc\x0cd\te\nf\rg\x1ch\x00i　j".encode()
    w = kernels.Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    assert [text[s:e] for s, e in zip(w.start, w.end, strict=True)] == text.split() or text.split() != re.findall(rb"[^\x20\x09-\x0D]+", text)
    assert [text[s:e] for s, e in zip(w.start, w.end, strict=True)] == re.findall(rb"[^\x20\x09-\x0D]+", text)
    assert decontaminate.allowed(10, 0.8) == 2
