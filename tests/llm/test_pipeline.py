"""The pipeline's stages on a small fixture, against brute force."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from helpers import SCHEMA, documents
from test_pairs import lines_by_hand, sets_by_hand
from test_texts import windows_by_hand

import __spark_entry__ as entry
import corpus_pipeline
from lexmill.llm import line_dedup


def test_pipeline(spark, tmp_path):
    rows = [r for r in documents(50, seed=12)]
    items = [(1, " ".join(rows[3][1].split()[2:14])), (2, "not in any text at all")]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        if k == 0:
            assert {i for i, t in texts.items() if t and any(c.isalpha() for c in t)} == set(after)
        if k == 1:
            want = lines_by_hand(before, line_dedup.MIN_CHARS, line_dedup.MIN_EXACT)
            assert {i: r.text for i, r in after.items()} == {i: w[0] for i, w in want.items() if not w[2] or w[0].strip()}
        if k == 2:
            assert set(after) == {i for i, (_, top) in sets_by_hand(before, 5, 80).items() if i == top}
        if k == 3:
            assert set(after) == {i for i, w in windows_by_hand(before, items).items() if not w[4]}
        if k == 4:
            lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = {r[0]: hashlib.sha256(",".join(map(str, lib.encode(r[1] or ""))).encode()).hexdigest() for r in before}
            assert {i: r.ids_sha256 for i, r in after.items()} == want
            assert all(r.ids == lib.encode(t or "") and r.decoded == lib.decode(r.ids) and not r.n_corrected for i, t, *_ in before for r in [after[i]])
    assert {str(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {str(r) for r in docs.collect()}


@pytest.mark.parametrize("k", range(5))
def test_stages_of_odd_tables(spark, tmp_path, k):
    """An empty table, and a table with further columns whose names clash with a stage's own."""
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0
    text = "the house of the man and the river that was with them"
    docs = spark.createDataFrame([(1, text, "en", "s", 9, "a", 5, "b"), (None, text, "en", "s", 9, "a", 5, "b")], f"{SCHEMA}, row string, key int, language string")
    out = stage(spark, docs, str(tmp_path))
    assert out.count() == 2 and (k == 4 or out.columns == corpus_pipeline.COLUMNS)


def test_rows_of_repeated_and_missing_ids(spark, tmp_path):
    r = __import__("random").Random(4)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    near = a + " tail"
    ids = [(None, c), (None, d), (None, c), (None, a), (1, a), (1, b), (2, near), (2, e), (3, d), (3, d), (5, near)]
    rows = [(i, t, "en", "s", len(t)) for i, t in ids]
    spark.createDataFrame([(1, " ".join(e.split()[3:16]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    left = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=key)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # the near copy of 1's first text goes, the other text of 2 stays; rows without an id all stay
    want = [(None, c), (None, d), (None, c), (None, a), (1, a), (1, b), (2, e), (3, d)]
    assert left(corpus_pipeline.drop_near_copies(spark, docs, "")) == sorted(want, key=key)
    want = [x for x in ids if x != (2, e)]
    assert left(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))) == sorted(want, key=key)
    docs = spark.createDataFrame([*rows, (1, "!!! 123", "en", "s", 7)], SCHEMA)
    assert left(corpus_pipeline.identify_language(spark, docs, "")) == sorted(ids, key=key)


def test_rows_without_id_link_nothing(spark):
    w = [f"w{k}" for k in range(100)]
    texts = {7: w, None: [*w[:91], *(f"x{k}" for k in range(9))], 8: [*w[:82], *(f"x{k}" for k in range(18))]}
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in texts.items()]
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").count() == 3


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
