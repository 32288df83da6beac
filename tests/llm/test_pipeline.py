import hashlib
import re

import llm_paths  # noqa: F401
import public_tokenizers
import sentencepiece
from texts import SCHEMA, frame, odd, prose, rows, write

import corpus_pipeline
from broadsheet.llm import decontaminate, language


def plant(spark, folder):
    item, key = prose(500, 40), "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    base = prose(600, 150)
    texts = [prose(k, 120) for k in range(20)] + [base, base, base + " more", f"{prose(700, 30)} {item} {prose(701, 30)}", f'{prose(702, 20)} token = "{key}" end', None, "", "12 34"]
    docs = frame(spark, rows(*texts))
    write(docs, folder, "documents")
    write(frame(spark, [(1, item)], "item_id bigint, text string"), folder, "benchmark")
    return docs, item, key


def test_every_stage_takes_effect(spark, tmp_path):
    docs, item, key = plant(spark, tmp_path)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        write(out, tmp_path, name)
        seen.append(spark.read.parquet(f"{tmp_path}/{name}.parquet"))
        if name != "sentencepiece":
            assert seen[-1].columns == docs.columns and seen[-1].schema == docs.schema
    kept = [{r.doc_id: r for r in d.collect()} for d in seen]
    assert set(kept[0]) - set(kept[1]) == {25, 26, 27}
    assert set(kept[1]) - set(kept[2]) == {21, 22}
    assert set(kept[2]) == set(kept[3]) == set(kept[4]) == set(kept[5])
    assert item[:60] in kept[2][23].text and item[:60] not in kept[3][23].text
    assert key in kept[3][24].text and "<secret>" in kept[4][24].text
    same = [d for d in kept[4] if d not in (23, 24)]
    assert all(kept[4][d].text == kept[0][d].text for d in same)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d, r in kept[5].items():
        assert list(r.ids) == library.encode(kept[4][d].text)
        assert r.decoded_sha256 == hashlib.sha256(kept[4][d].text.encode()).hexdigest()
    words = lambda t: re.findall(r"\w+", t)
    assert words(kept[3][23].text) == words(kept[0][23].text)[:30] + words(kept[0][23].text)[70:]


def test_odd_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", odd(spark)), ("empty", frame(spark, [], SCHEMA))):
        folder = f"{tmp_path}/{name}"
        write(docs, folder, "documents")
        write(frame(spark, [(1, None), (2, "x y z")], "item_id bigint, text string"), folder, "benchmark")
        out = corpus_pipeline.run(spark, folder)
        assert out.count() == (0 if name == "empty" else out.count())
        wide = docs.withColumns({"_key": docs.doc_id, "spans": docs.text, "ids": docs.lang})
        for step, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, wide, folder).columns == wide.columns, step


def test_models_are_those_of_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_neardup", "benchmark_decontamination", "secret_scan", "sentencepiece"]
    assert decontaminate.WINDOW == 10 and language.LEAST == 0.5
