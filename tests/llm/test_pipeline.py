"""The stages on a small corpus, each against what it says it does."""

import re

import pytest

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    words = "the of and to in that it was for on are as with his they at be this from have".split()
    text = lambda k, n: " ".join(words[(k * 7 + i * i + i * k) % 20] + str((k * 31 + i) % 97) for i in range(n))
    rows = [(i, text(i, 40 + i), "en", f"s{i % 3}") for i in range(20)]
    rows += [(20, text(1, 41), "en", "s0"), (21, text(1, 41) + " end", "en", "s1"), (22, "123", "en", "s0"), (23, None, None, None), (24, text(50, 60) + " " + text(2, 42), "en", "s2"), (25, text(60, 30), "en", "s1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, text(60, 30))], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "source_mixing"]


def test_each_stage(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == (columns if name != "source_mixing" else [*columns, "repetition"])
    everything = set(range(26))
    assert set(seen["language_id"]) == everything - {22, 23}
    assert set(seen["near_duplicates"]) == everything - {20, 21, 22, 23}
    cut = seen["substring_dedup"][24]
    assert cut.n_chars == len(cut.text) and len(cut.text.split()) == 60 and set(seen["substring_dedup"]) == set(seen["near_duplicates"])
    assert set(seen["decontamination"]) == set(seen["substring_dedup"]) - {25}
    assert set(seen["source_mixing"]) <= set(seen["decontamination"])


def test_run(spark, tables):
    made = corpus_pipeline.run(spark, tables)
    assert made.count() > 0 and made.columns[-1] == "repetition"


def test_imports_are_not_swallowed():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"except\s+(ImportError|Exception)", source)
