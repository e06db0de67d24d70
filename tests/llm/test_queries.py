from colloquy.llm.queries import ORACLE_SQL, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_identified_rows(spark, small):
    found = QUERIES["op1_language_id"](spark, small)
    docs, pages = (spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("documents", "pages"))
    assert found.count() == docs + pages
    assert found.where("claim != language").count() <= 0.01 * (docs + pages) and found.where("not kept").count() == 0


def test_every_document_is_in_one_shard(spark, small):
    found = QUERIES["op8_sharding"](spark, small)
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect())
