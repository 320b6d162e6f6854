import corpus_pipeline
import duckdb
import numpy as np
from linkgrove import storage
from linkgrove.llm import decontaminate as dc
from linkgrove.llm import neardups, oracles

from test_native import brute_lines
from test_neardups import brute_groups
from test_tokens import check_pieces


def test_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({oracles.quality()}) where kept").fetchall()}
    rows = [r for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect() if r.doc_id in kept]
    lines = brute_lines([tuple(r) for r in rows])
    rows = [(r.doc_id, lines[True, r.doc_id, r.h][2]) for r in rows]
    first = {min(rows[i][0] for i in g) for g in brute_groups([t for _, t in rows])}
    rows = [r for r in rows if r[0] in first]
    bench = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    items = dc.Items([(r.item_id, r.text) for r in bench])

    def leaks(text):
        numbers = items.numbers([text])[0]
        return any(
            len(ws) >= dc.SEED and 5 * np.isin(numbers, ws).sum() >= 4 * dc.least_span(len(ws)) and dc.copied(ws, numbers)
            for ws in items.words
        )

    rows = [r for r in rows if not leaks(r[1])]
    got = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in got} == {d for d, _ in rows}
    check_pieces(got, rows)


def test_stages_keep_the_columns(spark, data, none):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, data).schema.fieldNames() == docs.columns
        assert stage(spark, none, data).collect() == []


def test_stages_on_odd_rows(spark, data, odd):
    """Columns of any name, null and repeated ids: every stage keeps the columns and each row's own values."""
    rows = {tuple(r) for r in odd.drop("text", "n_chars").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, data)
        assert got.columns == odd.columns
        assert {tuple(r) for r in got.drop("text", "n_chars").collect()} <= rows
    assert corpus_pipeline.STAGES[-1][1](spark, odd, data).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_wide_tables_go_with_their_plans(spark, data):
    """What a stage's result reads stays as long as the result and no longer."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for stage, name in ((corpus_pipeline.quality_rules, "quality-metrics"), (corpus_pipeline.simhash_dedup, "near-rows")):
        kind = f"{storage.shared_dir(spark)}/linkgrove/{name}-*"
        storage.free_shuffles(spark)
        before = storage.list_paths(spark, kind)
        got = stage(spark, docs, data)
        storage.free_shuffles(spark)
        assert len(set(storage.list_paths(spark, kind)) - set(before)) == 1 and got.count()
        copy = storage.staged(got, "copy")
        rows = got.count()
        del got
        for _ in range(3):  # Spark may hold the last plans for a while
            storage.free_shuffles(spark)
            spark.range(1).count()
        assert set(storage.list_paths(spark, kind)) <= set(before) and copy.count() == rows


def test_links_are_few_files(spark, data, monkeypatch):
    """Files follow the rows of a link table, not the shuffle partitions, of which check runs have hundreds."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    staged, files = neardups.staged, {}

    def spy(df, name, *more):
        out = staged(df, name, *more)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(neardups, "staged", spy)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        corpus_pipeline.simhash_dedup(spark, docs, data)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    short = ("near-prints", "near-among", "near-anchored", "near-close", "near-links")
    assert all(n == 1 for name in short for n in files[name])
