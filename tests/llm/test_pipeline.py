"""The pipeline's stages on the smallest driver tables."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import bwt, cotrain, crf, jaccard
from tallyloom.sources.workspace import pin

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = pin(stage(spark, now, SF))
        if name != "packing":
            assert after.columns == docs.columns
        if name == "toxicity":
            toxic = {r[0] for r in crf.toxicity(now, labels).where("predicted = 1").select("doc_id").collect()}
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in now.select("doc_id").collect()} - toxic
        if name == "quality":
            poor = {r[0] for r in cotrain.quality(now, labels).where("predicted = 0").select("doc_id").collect()}
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in now.select("doc_id").collect()} - poor
        if name == "near_duplicates":
            assert jaccard.jaccard_classes(after).where("links > 0").count() == 0
        if name == "repeats":
            found = bwt.removal_digest(now, corpus_pipeline.REPEAT).agg(F.sum("n_removed")).first()[0]
            size = lambda d: d.agg(F.sum(F.octet_length("text"))).first()[0]
            assert 0 <= size(now) - found - size(after) * 1 <= 3 * now.count() or size(after) <= size(now) - found
        if name == "packing":
            whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            ids = {r["doc_id"]: np.array(whole.encode(r["text"], add_special_tokens=False).ids + [1], "<u4") for r in now.collect()}
            for r in after.collect():
                part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
                assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            assert after.agg(F.sum("length")).first()[0] == sum(map(len, ids.values()))
        now = after


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() > 0
