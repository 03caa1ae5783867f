import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.tables import written
from tidemark.llm.token_counts import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(rng, n, words):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted toxic texts, common lines, copies and benchmark items, and odd rows; by kind."""
    rng, folder = random.Random(4), str(tmp_path_factory.mktemp("corpus"))
    words, bad = [f"word{k}" for k in range(400)], [f"vile{k}" for k in range(12)]
    texts, kinds, labels = {}, {}, []
    for i in range(160):
        toxic = i % 4 == 0
        texts[i] = made(rng, 40, words) + (" " + made(rng, 12, bad) if toxic else "")
        kinds[i] = "toxic" if toxic else "clean"
        labels.append((i, 1, int(toxic)))
    common = "this line of more than forty characters is in many documents"
    items = [(k, made(rng, 30, words)) for k in range(4)]
    for i in range(200, 206):
        texts[i], kinds[i] = f"{made(rng, 40, words)}\n{common}\n{made(rng, 10, words)}", "lines"
    # fewer than the five documents from which on a line is dropped
    for i in range(210, 213):
        texts[i], kinds[i] = texts[1], "copies"
    near = texts[2].split()
    texts[220], kinds[220] = " ".join([*near[:-1], "changed"]), "copies"
    for k, item in items:
        texts[230 + k], kinds[230 + k] = f"{made(rng, 20, words)} {item} {made(rng, 20, words)}", "leaks"
    texts[240], texts[241], texts[242] = None, "", made(rng, 6000, words)
    kinds |= {240: "clean", 241: "clean", 242: "clean"}
    rows = [(i, t, "en", "web", len(t or "")) for i, t in texts.items()] + [(None, made(rng, 30, words), None, None, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, kinds, common


def test_stages_one_after_the_other(spark, corpus):
    folder, texts, kinds, common = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == names
        docs = written(out)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda kind: {i for i, k in kinds.items() if k == kind}
    gone = set(texts) - set(kept["toxicity"])
    assert len(gone & ids("toxic")) >= 0.9 * len(ids("toxic")) and len(gone - ids("toxic")) <= 3
    lines = ids("lines") & set(kept["line_dedup"])
    assert {i for i in lines if common in kept["line_dedup"][i]} == {max(lines)}
    assert all(kept["line_dedup"][i] == kept["toxicity"][i] for i in kept["line_dedup"] if i not in lines)
    gone = set(kept["line_dedup"]) - set(kept["near_duplicates"])
    first = {1} & set(kept["line_dedup"]) or {210}
    assert gone == {i for i in ids("copies") & set(kept["line_dedup"]) if i != 220 or 2 in kept["line_dedup"]} - first
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == ids("leaks") & set(kept["near_duplicates"])
    # rows without an id, without text and very long ones stay
    assert None in kept["decontamination"] and {240, 241, 242} <= set(kept["decontamination"])
    library = Tokenizer.from_file(vocabulary_path())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in kept["decontamination"].values())
    assert sum(r["length"] for r in packed) == want
    fill: dict = {}
    for r in packed:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, folder).count() == 0, name
