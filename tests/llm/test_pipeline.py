import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
        assert docs.count() > 0.5 * before.count() * (name != "mixture")
    assert {"doc_id", "ids", "n_tokens"} <= set(pipeline.STAGES[-1][1](spark, docs, SF).columns)


def test_stages_take_odd_and_empty_documents(spark, odd, none, clashing):
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, none, clashing):
        names = docs.columns
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == names
        if docs.columns == clashing.columns:
            assert {r.kept for r in docs.collect()} <= {"taken"}
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("name", ["op7_warc", "op10_mix_sources"])
def test_queries_equal_their_sql(spark, name):
    from lexiloom.llm import catalog

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    told = con.sql(catalog.ORACLES[name])
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    assert columns == sorted(told.columns)
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = sorted([str([rounded(r[c]) for c in columns]) for r in found.collect()])
    at = [told.columns.index(c) for c in columns]
    assert mine == sorted(str([rounded(r[k]) for k in at]) for r in told.fetchall())


def test_every_contract_column_is_there(spark):
    from lexiloom.llm import catalog

    wanted = {
        "op1": "doc_id n_assign n_access n_hex base_sha256 spans", "op2": "doc_id held_out score predicted", "op3": "doc_id n_bytes n_tokens over_limit", "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op5": "doc_id class_id n_links", "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7": "page_id payload_bytes payload_digest record_type refers_to", "op8": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op9": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op10": "doc_id size source_size target taken",
    }
    for op, names in wanted.items():
        (query,) = (q for n, q in catalog.QUERIES.items() if n.startswith(op + "_"))
        found = query(spark, SF)
        assert set(names.split()) <= set(found.columns)
        assert found.count() == spark.read.parquet(f"{SF}/{'pages' if op == 'op7' else 'documents'}.parquet").count()
