import random

import pyarrow as pa
from test_kernel import twins

from sediment.llm.token_counts import Counter, token_counts, tokenizer_path


def test_counts_are_the_librarys():
    from pyarrow import parquet
    from tokenizers import Tokenizer

    library, rnd = Tokenizer.from_file(tokenizer_path()), random.Random(5)
    parts = [*"ab'sdltrevm  \n\t\r.,!12 　éñß中文😀½²́_-", "'s", "'ll", " 't", "''re", "'ve", "<|endoftext|>", "<|endof", "  ", "\x85", "\x1c", "​", "٣", "ǅ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    texts += ["", "'", " ", "  ", "don't'll", "<|endoftext|>", " <|endoftext|> x", "a" * 3000, " " * 3000]
    texts += [t for n in (1024, 2048) for a, b in ("ab", "xe", "01", "th") for t in twins(n, a, b)]
    texts += parquet.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = Counter(tokenizer_path())
    assert counter.texts(pa.array(texts)).tolist() == want
    assert counter.texts(pa.array(texts[100:200]).slice(7)).tolist() == want[107:200]


def test_frame(spark):
    df = spark.createDataFrame([(1, "héllo", 0), (1, "héllo", 0), (2, None, 0), (None, "", 0)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(spark, df).collect()), key=str)
    n = int(Counter(tokenizer_path()).texts(pa.array(["héllo"]))[0])
    assert n > 1 and got == sorted([(1, 6, n), (1, 6, n), (2, 0, 0), (None, 0, 0)], key=str)
    assert token_counts(spark, df.limit(0)).count() == 0
