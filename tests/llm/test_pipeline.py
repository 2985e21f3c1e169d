import hashlib
import os

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quaere.llm import bpe, decontaminate, lines, quality, registry

from .test_operators import brute_links, brute_tiles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        assert docs.count() <= before
        before = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    want = sorted(tuple(r) for r in docs.collect())
    assert want and sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def by_hand(docs, benchmark, good):
    """All stages on lists: ``(doc_id, n_tokens, ids_sha256)`` of what is left."""
    import duckdb

    docs = {k: t for k, t in docs.items() if k in good}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(docs.items()))
    docs = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text FROM ({lines.ORACLE_SQL})").fetchall()}
    keys = sorted(docs)
    docs = {k: docs[k] for k, (first, _) in zip(keys, brute_links([docs[k] for k in keys]).values(), strict=True) if keys[first] == k}
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for item in (decontaminate.words(t) for t in benchmark):
        ids = {w: i for i, w in enumerate(dict.fromkeys(item))}
        for k, t in list(docs.items()):
            w = decontaminate.words(t)
            if runs(w) & runs(item) and sum(x[2] for x in brute_tiles([ids.get(x, -1) for x in w], [ids[x] for x in item], 5)) >= 0.5 * len(item):
                del docs[k]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {k: theirs.encode_ordinary(t or "") for k, t in docs.items()}
    return {(k, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for k, x in ids.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_against_stages_by_hand(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = by_hand({r.doc_id: r.text for r in docs.collect()}, items, good)
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want and len(want) < len(good)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with the stages' own names; then no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, None, "en", "s", 0), (10**6, "", None, None, None), (10**6 + 1, "a b c d e f " * 900, "en", "s", 5), (10**6 + 1, "a b c d e f " * 900, "en", "s", 5)], docs.schema)
    wide = docs.unionByName(odd).selectExpr("*", "1 AS set", "'x' AS leaf", "2L AS row", "0 AS score", "text AS _text", "1 AS n")
    for name, df in (("odd", wide), ("none", wide.where("false"))):
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(rows) > 20) if name == "odd" else rows == []
    left = wide
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == wide.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(map(repr, theirs.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in registry.QUERIES[name](spark, SF).collect())
