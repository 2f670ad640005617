from __future__ import annotations

import hashlib
import random

import tiktoken
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stridelake.llm import bpe

SYLLABLES = {"xx": ["ba", "do", "ku", "mi", "ra"], "yy": ["sch", "ung", "ö", "tz", "ein"], "zz": ["фи", "жа", "ле", "но", "ро"]}

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(5), [], []

    def text(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))

    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        toxic = i % 6 == 0
        body = text(lang, rng.randint(20, 60)) + (" scum trash" if toxic else "")
        rows.append((i, body, lang))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(10)]  # exact copies
    rows += [(2000 + i, rows[i][1] + " extra", rows[i][2]) for i in range(20, 30)]  # near copies
    rows += [(3000, "123 --- 456", "xx"), (3001, None, None), (3002, "", "xx")]
    path = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        found = [r.doc_id for r in docs.collect()]
        assert len(found) == len(set(found))
        ids.append(set(found))
    assert ids[0] - ids[1] == {3000, 3001, 3002}
    assert ids[1] - ids[2] == set(range(10))
    assert ids[2] - ids[3] == set(range(2020, 2030))
    gone = ids[3] - ids[4]
    toxic = {i for i in ids[3] if "scum" in texts[i]}
    assert len(gone & toxic) > 0.4 * len(toxic) and len(gone - toxic) < 0.1 * len(ids[3])

    result = corpus_pipeline.run(spark, folder).collect()
    with open(P.path(corpus_pipeline.VOCABULARY), "rb") as file:
        ranks = bpe.read_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id for r in result} == ids[4]
    for r in result:
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
