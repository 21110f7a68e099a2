import corpus_pipeline
from corpusloom.llm import pieces, registry


def test_queries_return_ids_of_encodings_and_samples(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The water runs where people live."), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (registry.op3_pieces(spark, str(tmp_path)), corpus_pipeline.pieces_stage(spark, docs, "")):
        rows = {r.doc_id: r for r in got.collect()}
        assert len(rows[1].ids) == rows[1].n_pieces > 0 and rows[2].ids == []
        assert len(rows[1].samples) == 3
        model = pieces.Model(pieces.MODEL, 1.0)
        for x in rows[1].samples:
            assert len(x.ids) == x.n_pieces and model.decode(x.ids) == "The water runs where people live."
