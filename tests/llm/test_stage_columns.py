"""Every stage on tables whose columns carry the names that the stages use, and on tables with few columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

NAMES = "row kept_text ranges id mark gone_id gone_mark words hashes held item item_id at length low high pattern quality m stay nth first node size fp key keys bytes bucket part window".split()
PROSE = " ".join(f"Word{(k * k) % 211} goes" for k in range(90))
ROWS = [(1, PROSE), (2, PROSE + " tail"), (3, None), (4, ""), (5, "x" * 200_000 + " " + PROSE), (5, "x" * 200_000 + " " + PROSE), (None, PROSE.replace("goes", "went"))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("columns")
    spark.createDataFrame([(1, " ".join(f"leak{k}" for k in range(30)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("names", [NAMES, []])
@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_clashing_and_missing_columns(spark, folder, stage, names):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({n: F.lit(k) for k, n in enumerate(names)})
    got = stage(spark, docs, folder)
    rows = got.collect()
    if stage is not corpus_pipeline.into_sequences:
        assert got.columns == docs.columns
        assert {tuple(r)[2:] for r in rows} <= {tuple(range(len(names)))}
    ids = sorted({r.doc_id for r in rows if r.doc_id is not None})
    want = {"keep_quality": [1, 2], "keep_one_of_each": [1, 3], "cut_repeats": [1, 2, 3, 4, 5], "drop_leaks": [1, 2, 3, 4, 5], "into_sequences": [1, 2, 3, 4, 5]}[stage.__name__]
    assert set(ids) >= set(want)
    if stage is corpus_pipeline.cut_repeats:
        assert {r.doc_id: r.text for r in rows}[2] == "tail"
