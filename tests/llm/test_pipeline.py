import corpus_pipeline
import pytest
from test_dedup import components
from test_scans import contained
from tidebar.llm import bpe, queries
from tokenizers import Tokenizer


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, sf)
        if name != "bpe":
            assert at.columns == docs.columns
        kept = {r.doc_id for r in at.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "toxicity":
            wrong = [i for i in ids if i in labels and (i in kept) == bool(labels[i])]
            assert len(wrong) <= 0.03 * len(labels)
        at = at.cache()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == kept
    assert 0.4 * len(ids) < len(kept) < len(ids)


def test_stages_on_odd_rows(spark, docs, rows, empty, sf):
    """Nulls, empty and long texts, repeated rows, extra columns: each stage against a brute-force version, or what must stay."""
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, empty, sf).collect() == []
        if name != "bpe":
            assert stage(spark, docs, sf).columns == docs.columns
    shown = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)
    plain = sorted([(i, t) for i, t, *_ in rows], key=repr)
    assert shown(stages["toxicity"](spark, docs, sf)) == plain
    gone = {i for i, _, _, kept in components(rows, 5) if not kept}
    assert shown(stages["near_duplicates"](spark, docs, sf)) == [x for x in plain if x[0] not in gone]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    text = items[0][1]
    more = [*rows, (90, f"before {text} after", "x", 1), (91, text.upper(), "x", 1)]
    bad = {(i, t) for i, t, *_ in more if contained([(i, t)], items)}
    assert {90, 91} <= {i for i, _ in bad}
    got = stages["decontamination"](spark, spark.createDataFrame(more, docs.schema), sf)
    assert shown(got) == sorted([(i, t) for i, t, *_ in more if (i, t) not in bad], key=repr)
    mail = [*rows, (92, "write to ann.lee@mail.org or Ann.Lee@mail.org", "x", 1)]
    got = shown(stages["pii"](spark, spark.createDataFrame(mail, docs.schema), sf))
    assert [x for x in got if x[0] != 92] == plain
    first, second = next(t for i, t in got if i == 92).removeprefix("write to ").split(" or ")
    assert "ann" not in first and first == second.lower()
    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = sorted([(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows], key=repr)
    assert sorted([(r.doc_id, r.ids) for r in stages["bpe"](spark, docs, sf).collect()], key=repr) == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sf, name):
    import duckdb

    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name not in queries.SQL:
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.astype(str).equals(b.astype(str))
