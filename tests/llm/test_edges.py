"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import os
import re
import subprocess
import sys

import pytest

import corpus_pipeline
from fragmill.llm import bpe, language_id, neighbours, packing, quality_rules, secret_scan, substring_dedup, toxicity, url_filter
from fragmill.llm.jaccard_join import jaccard_components, keep_one_each

#: Names that the operators use, or used, for columns of their own.
CLASHING = "spans __id __text __base __spans __runs __bucket __at __hit __hash h fp n key first row salt host lines gone known lo hi c i j again doc label tokens held_out score predicted kept at embedding_ rep root".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in [*CLASHING, "a.b", "we``ird"])
LONG = "word " * 50_000
PROSE = "It was a bright cold day in April and the clocks were striking thirteen. Winston Smith slipped quickly through the glass doors of Victory Mansions, though not quickly enough. The hallway smelt of boiled cabbage and old rag mats that day."


def rows():
    texts = [(1, PROSE), (1, PROSE), (2, PROSE + " More of it."), (3, None), (4, ""), (5, " \n\t"), (6, LONG), (7, "x" * 300_000), (8, "漢" * 5_000), (None, PROSE), (None, "quite another text of its own " * 5), (None, None), (9, "token=abcdefgh1234 " + PROSE[::-1]), (10, "\n".join([PROSE[:60]] * 30))]
    extra = [f"own {c}" for c in CLASHING] + ["dot", "tick"]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if t is None else len(t), *extra) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(1, 11)] + [(None, 1, 1), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "bpe.digest": lambda d, path, labels: bpe.digest(d, path),
    "bpe.encode": lambda d, path, labels: bpe.encode(d, path),
    "toxicity": lambda d, path, labels: toxicity.toxicity(d, labels),
    "secrets": lambda d, path, labels: secret_scan.secrets(d),
    "redact": lambda d, path, labels: secret_scan.redact(d),
    "dedup": lambda d, path, labels: substring_dedup.dedup_substrings(d),
    "quality": lambda d, path, labels: quality_rules.quality(d),
    "languages": lambda d, path, labels: language_id.identify(d),
    "jaccard": lambda d, path, labels: jaccard_components(d),
}
KEEPING = {
    "redact": PER_ROW["redact"],
    "dedup": lambda d, path, labels: substring_dedup.dedup_substrings(d).drop("n_sentences_removed", "n_words_removed"),
    "keep_good": lambda d, path, labels: quality_rules.keep_good(d),
    "keep_one_each": lambda d, path, labels: keep_one_each(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_every_row_has_a_result(docs, path, labels, name):
    found = PER_ROW[name](docs, path, labels).collect()
    ids = lambda some: sorted(str(r.doc_id) for r in some)
    assert ids(found) == sorted(str(r[0]) for r in rows())
    # equal rows get equal results, other columns aside
    assert len({str(r) if name not in KEEPING else r.text for r in found if r.doc_id == 1}) == 1


@pytest.mark.parametrize("name", sorted({**PER_ROW, **KEEPING}))
def test_empty_tables(spark, path, labels, name):
    none = spark.createDataFrame([], SCHEMA)
    assert {**PER_ROW, **KEEPING}[name](none, path, labels).count() == 0
    if name == "toxicity":
        assert toxicity.toxicity(spark.createDataFrame(rows(), SCHEMA), labels.limit(0)).where("score != 0").count() == 0


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_other_columns_pass(docs, path, labels, name):
    found = KEEPING[name](docs, path, labels)
    assert found.columns == docs.columns
    kept = found.collect()
    assert kept and all(tuple(r)[5:] == rows()[0][5:] for r in kept)
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)


def test_stages(spark, docs, tmp_path):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_packing(docs, path):
    bins = packing.pack(docs, path).collect()
    assert all(sum(b.lengths) == b.used <= b.capacity for b in bins) and {i for b in bins for i in b.doc_ids} == {1, 2, 5, 6, 7, 8, 9, 10, None}


def test_pages(spark, labels):
    urls = ["http://a.example.net/en/1", None, "", "no scheme", "http://", "http://HOST", "http://x.com/" + "a/" * 5_000, "http://a.example.net/en/1"]
    names = "tokens host path rule hit filed items item".split()
    schema = "page_id long, url string, html string, " + ", ".join(f"`{n}` string" for n in names)
    pages = spark.createDataFrame([(k if k != 5 else None, u, None, *names) for k, u in enumerate(urls)] + [(0, urls[0], None, *names)], schema)
    got = url_filter.judge(pages, labels).collect()
    assert len(got) == 9 and {r.verdict for r in got if r.host == "a.example.net"} == {"allow"} and sum(r.host == "" for r in got) == 4
    assert url_filter.judge(pages.limit(0), labels).count() == 0 and url_filter.judge(pages, labels.limit(0)).count() == 9


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, dims string, top string, query_id string"
    assert neighbours.nearest_of_twentieths(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], None, "d", "t", "q"), (1, [0.5, 0.5], 1, "d", "t", "q"), (2, [0.5, 0.5], 1, "d", "t", "q"), (3, None, 1, None, None, None)], schema)
    assert [(r["rank"], r.vec_id) for r in neighbours.nearest_of_twentieths(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_ids_of_another_type(spark):
    """The least and the greatest id, and ids beside each other, stay apart."""
    ids = [-(2**63), -1, 0, 2**63 - 1]
    df = spark.createDataFrame([(i, f"{PROSE} {i}", "en", "s", 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.component_id for r in jaccard_components(df).collect()} == {min(ids)}
    assert [r.doc_id for r in keep_one_each(df).collect()] == [min(ids)]


def test_dedup_joins_its_runs_once(docs, monkeypatch):
    found = substring_dedup.dedup_substrings(docs)
    assert len(re.findall(r"Join LeftOuter, .*= id_", found._jdf.queryExecution().optimizedPlan().toString())) == 1
    # whatever the filter lets through, rows without a repeated run stay as they are
    monkeypatch.setattr(substring_dedup, "split_by_ids", lambda d, ids: (d, d.limit(0)))
    through = substring_dedup.dedup_substrings(docs)
    assert sorted(map(str, through.collect())) == sorted(map(str, found.collect()))
    assert {r.doc_id for r in found.where("n_sentences_removed > 0").collect()} == {2, 10}


def test_jaccard_splits_a_large_class(spark):
    copies = [(k, PROSE if k % 3 else f"{k} {PROSE[k % 40 :]} {k}") for k in range(900)]
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(8)
    adaptive = "spark.sql.adaptive."
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", adaptive + "coalescePartitions.enabled": "false", adaptive + "advisoryPartitionSizeInBytes": "64b", adaptive + "skewJoin.skewedPartitionThresholdInBytes": "64b", adaptive + "skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = jaccard_components(df)
        rows = found.collect()
        assert "SortMergeJoin(skew=true)" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 900 and len({(r.class_id, r.component_id) for r in rows if r.doc_id % 3}) == 1


def test_jaccard_follows_long_chains(spark):
    """Every text links with the next one only; the least doc_id is reached from the other end."""
    chain = [(k, " ".join(f"w{i}" for i in range(6 * k, 6 * k + 60))) for k in range(400)]
    df = spark.createDataFrame([*chain, (1000, "quite another text " * 9)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(df).collect()}
    assert got == {**dict.fromkeys(range(400), 0), 1000: 1000}


IDLE = """
import re, sys
from pathlib import Path
import numpy as np, pyarrow as pa
from fragmill.llm import bpe, common, jaccard_join, substring_dedup

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

class Vocabulary:
    value = Path(sys.argv[2]).read_text(encoding="utf-8")

def batch(text_at):
    rng = np.random.default_rng(1)
    text = pa.array([" ".join(map(str, rng.integers(0, 300, 800))) for _ in range(3000)])
    ids = pa.array(range(3000), pa.int64())
    yield pa.RecordBatch.from_arrays([text] if text_at == 0 else [ids, text, ids], ["text"] if text_at == 0 else ["doc_id", "text", "text_hash"])

runs = {
    "profiles": lambda: jaccard_join._profiles(batch(1)),
    "first": lambda: jaccard_join._first_fragment(batch(0)),
    "spans": lambda: substring_dedup._spans(batch(1)),
    "tokens": lambda: bpe._batched(bpe._counted, ["doc_id", "n"], Vocabulary)(batch(1)),
}
for rows in runs[sys.argv[1]]():
    pass
del rows
after = held()
common.give_back()
print(after - held())
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
@pytest.mark.parametrize("name", ["profiles", "first", "spans", "tokens"])
def test_idle_workers_hold_no_freed_memory(name):
    """A worker that waits for its next task counts as its executor's memory, with all that its allocators keep."""
    import public_tokenizers

    ran = subprocess.run([sys.executable, "-c", IDLE, name, public_tokenizers.path(corpus_pipeline.VOCABULARY)], capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 4
