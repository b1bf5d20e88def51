"""The pipeline's stages, each judged on its own input."""

import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import mutate, prose
from zephyrlake.llm import pieces

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    d = str(tmp_path_factory.mktemp("corpus"))
    item, passage, copy = prose(900, 40, 4000), prose(901, 70, 4000), prose(902, 200, 4000)
    texts = [prose(2000 + k, 80, 4000) for k in range(300)]
    toxic = [k for k in range(300) if k % 6 == 0]
    for k in toxic:
        w = texts[k].split()
        w[rng.randrange(80)] = rng.choice(["moronic", "worthless"])
        texts[k] = " ".join(w)
    leaks, passages, copies = [301, 302], [303, 304, 305], [306, 307, 308]
    texts += [
        None, f"{texts[1]} {item}", f"{item} {texts[2]}", *[f"{prose(3000 + k, 30, 4000)}\n{passage}" for k in range(3)], copy,
        copy + " tail", mutate(copy, 0.01, rng), ""
    ]
    rows = [(k, t, "en", "src0", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame([*rows, (None, "without id", None, None, None)], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(enumerate(texts)), set(toxic), set(leaks), passages, copies, passage, item


def test_stages(spark, corpus):
    d, texts, toxic, leaks, passages, copies, passage, item = corpus
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/out-{k}")
        docs = spark.read.parquet(f"{d}/out-{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
    everyone = {*texts, None}
    assert set(seen[0]) == everyone - toxic
    assert set(seen[1]) == set(seen[0]) and sum(passage in (r.text or "") for r in seen[1].values()) == 1
    assert passage in seen[1][passages[0]].text and all(seen[1][k].n_chars == len(seen[1][k].text) for k in passages)
    assert all(seen[1][k].text == texts[k] for k in set(seen[1]) - {None, *passages})
    assert set(seen[1]) - set(seen[2]) == set(copies[1:])
    assert set(seen[2]) - set(seen[3]) == leaks and not any(item in (r.text or "") for r in seen[3].values())
    p = pieces.load(pieces.MODEL)
    assert set(seen[4]) == set(seen[3]) and all(p.decode(r.ids) == (seen[3][k].text or "") for k, r in seen[4].items())


def test_run_and_names(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() == 300 - 50 + 11 - 4
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]


def test_nothing_swallows_import_errors():
    for f in ("corpus_pipeline.py",):
        assert not re.search(r"except (Module|Import)", open(corpus_pipeline.__file__).read()), f
