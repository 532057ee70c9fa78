"""Ids of all documents by both ways of encoding."""

from tessera.llm._ids import IdEncoder, byte_bpe


def test_every_document_has_the_ids_of_the_tokenizers_library(spark):
    encode = IdEncoder(*byte_bpe())
    for sf in ("sf0.001", "sf0.01"):
        texts = [r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect() if r.text]
        for text in texts:
            assert encode(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids
