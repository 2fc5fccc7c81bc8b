import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use."""
    long = " ".join(f"word{i % 700} line{i % 13}." + ("\n" if i % 40 == 0 else "") for i in range(30_000))
    rows = [
        (0, "The quick brown fox jumps over the lazy dog again and again.", "a", 0.1),
        (1, None, "b", 0.2),
        (2, "", None, 0.3),
        (3, " \n\t ", "c", None),
        (4, long, "a", 0.5),
        (5, "The quick brown fox jumps over the lazy dog again and again.", "b", 0.6),
        (5, "The quick brown fox jumps over the lazy dog again and again.", "b", 0.6),
        (6, "one", "c", 0.7),
        (None, "The quick brown fox jumps over the lazy dog again and again.", "c", 0.8),
        (None, None, None, None),
        (7, "ÀÉ ñ 日本語 <|endoftext|>  x y " + "x" * 5000, "a", 0.9),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, score double")
