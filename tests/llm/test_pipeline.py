"""The pipeline's stages, each against a plain account of what it must do on its own input."""

import sentencepiece

import corpus_pipeline
from factloom.llm import REST, TARGETS, mixing, pieces, quality
from tests.llm.test_likeness import jaccard_groups, shingle_set
from tests.llm.test_operators import brute_removal, words


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append(name)
        after = [tuple(r) for r in now.collect()]
        if name != "piece_ids":
            assert now.columns == docs.columns
        if name == "quality":
            kept = quality.judged(docs).where("kept").count()
            assert len(after) == kept < len(before)
        elif name == "near_dedup":
            assert len(after) == len(set(jaccard_groups([shingle_set(r[1]) for r in before]).values()))
        elif name == "substring_dedup":
            assert sorted(len(words(r[1])) for r in after) == sorted(n - gone for _, n, gone, _ in brute_removal(before))
        elif name == "source_mix":
            assert sorted(map(repr, after)) == sorted(map(repr, before))
            order = [tuple(x.row) for x in sorted(mixing.mixed(spark.createDataFrame(before, docs.schema), TARGETS, REST).collect(), key=lambda x: (x.slot, x.start))]
        else:
            assert now.columns == [*docs.columns, "position", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
            got = sorted(now.collect(), key=lambda r: r.position)
            assert [r.position for r in got] == list(range(len(before))) and [tuple(r)[: len(docs.columns)] for r in got] == order
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file("piece_bpe_32k.model"))
            assert all(r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids) for r in got)
    assert len(seen) == 5
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, now.collect()), key=repr)
