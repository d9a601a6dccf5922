import random
from pathlib import Path

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from smilegrid.llm import token_counts as T  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def plain(texts):
    whole = tokenizers.Tokenizer.from_file(PATH)
    return [len(x.ids) for x in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def texts(seed, n):
    rng = random.Random(seed)
    parts = [" ", " ", " ", "  ", "\n", " \n ", "\t", "a", "the", "word", "Überß", "日本語", "123", "'s", "'re", "!!", "***", " ", " ", "\x1f",
             "<|endoftext|>", "<|endoftext", "|>", "🙂", "é", "x" * 30, ".", ","]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 120))) for _ in range(n)]


def test_words_give_whole_text_counts():
    sample = ["", " ", "  ", "a", " a", "a ", "a  ", " a b ", "a b", "a  b", "a \n b c", "\n", "a\n\nb c  ", *texts(1, 3000)]
    assert T.Counter(PATH).counts(sample) == plain(sample)


@pytest.mark.parametrize("step,overlap", [(40, 8), (64, 32), (300, 40)])
def test_spliced_chunks_give_whole_text_counts(spark, step, overlap):
    sample = [*("".join(texts(k, 12)) for k in range(40)), "x" * 2000, " " * 1500, "\n" * 900, "ab" * 400 + " c", None, ""]
    frame = spark.createDataFrame(list(enumerate(sample)), SCHEMA)
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in T.token_counts(frame, PATH, step=step, overlap=overlap).collect()}
    assert found == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(sample, plain(sample), strict=True))}


def test_repeated_null_and_clashing_rows(spark):
    long = "many words here " * 5000
    frame = spark.createDataFrame([(1, long, 3), (1, long, 4), (None, long, 5), (2, None, 6), (None, None, 7)], SCHEMA + ", row int")
    found = sorted(((r.doc_id, r.n_tokens) for r in T.token_counts(frame, PATH).collect()), key=str)
    n = plain([long])[0]
    assert found == sorted([(1, n), (1, n), (None, n), (2, 0), (None, 0)], key=str)


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_query_against_the_library(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("test data not available")
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = {r.doc_id: (r.n_tokens, r.over_limit) for r in T.op2_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert found == {d: (n, n > 512) for d, n in zip(docs, plain(docs.values()), strict=True)}


def test_other_kinds_of_vocabulary_encode_whole_texts():
    other = public_tokenizers.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(other)
    sample = ["Some words  here", "", "a\nb"]
    assert T.Counter(other).counts(sample) == [len(x.ids) for x in whole.encode_batch(sample, add_special_tokens=False)]


def test_tasks_of_a_worker_share_one_counter():
    from pyspark import cloudpickle

    T.counter(PATH).counts(["some words and some words"])
    kernel = cloudpickle.dumps(T.counter)
    one, two = cloudpickle.loads(kernel), cloudpickle.loads(kernel)
    assert one is not two and one(PATH) is two(PATH)
    assert len(kernel) < 100_000  # the vocabulary stays where it is
