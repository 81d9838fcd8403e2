"""The pipeline's stages against brute force, each on what its predecessor kept."""

import random
import re

from test_dedup import expect_components, expect_cut

import corpus_pipeline
from pepspark.llm.common import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    random.seed(11)
    words = [f"wort{i}" for i in range(900)]
    text = lambda n: " ".join(random.choices(words, k=n))
    passage = text(70)
    rows, toxic = [], set()
    for i in range(260):
        t = text(random.randint(60, 160))
        if i % 11 == 1:
            t = text(20) + " " + passage + " " + text(20)
        if i % 9 == 0:
            parts = t.split()
            for at in random.sample(range(len(parts)), 6):
                parts[at] = random.choice(["vilex", "grubbo", "snarfle"])
            t = " ".join(parts)
            toxic.add(i)
        rows.append((i, t))
    clean = [r for r in rows if r[0] not in toxic]
    rows += [(300 + k, clean[k][1].replace(" ", "  ", 5)) for k in range(20)]
    for k in range(20, 40):
        parts = clean[k][1].split()
        parts[len(parts) // 2] = "anders"
        rows.append((400 + k, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "kurz"), (None, text(30))]
    return rows, toxic


def test_stages(spark, tmp_path):
    rows, toxic = corpus()
    docs = spark.createDataFrame([(i, t, None, "s", len(t) if t else None) for i, t in rows], COLUMNS)
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), "stage")
        kept.append(now)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    get = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    first, second, third, fourth = map(get, kept[:4])
    assert {i for i, _ in rows} - {i for i, _ in first} == toxic
    groups = {}
    for i, t in first:
        key = (-len(t or ""), i is None, i or 0)
        at = re.sub("[\x20\x09-\x0d]", "", t or "")
        groups[at] = min(groups.get(at, key), key)
    assert sorted((i for i, _ in second), key=str) == sorted((None if none else i for _, none, i in groups.values()), key=str)
    near = [i for i, _, c in expect_components(second, 5, 80) if i == c]
    assert sorted((i for i, _ in third), key=str) == sorted(near, key=str)
    sizes = {i: size - removed for i, size, removed, _, _ in expect_cut(third, 400)}
    assert {i: len((t or "").encode()) for i, t in fourth} == sizes and min(sizes[i] for i in sizes if i and i % 11 == 1 and i < 260) < 400
    packed = kept[4].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in packed} == {i for i, _ in fourth}
