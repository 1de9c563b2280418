"""Count-only Viterbi against the tokenizers library's unigram model."""

import random

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from papertrail.llm import viterbi

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(vocabulary, unknown, byte_fallback):
    tokenizer = Tokenizer(models.Unigram(vocabulary, unknown, byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=viterbi.MARK, prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_small_vocabularies_with_ties(byte_fallback):
    rng = random.Random(7)
    for trial in range(150):
        pieces = {"".join(rng.choice("abc▁é漢") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        vocabulary = [("<unk>", 0.0), *((p, float(-rng.randint(1, 4))) for p in sorted(pieces))]
        if byte_fallback and trial % 2:
            vocabulary += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
        count, own = library(vocabulary, 0, byte_fallback), viterbi.Counter(vocabulary, 0, byte_fallback, limit=50)
        for _ in range(20):
            text = "".join(rng.choice("abc é漢x😀  ▁\n") for _ in range(rng.randint(0, 14)))
            assert own.text(text) == count(text), (vocabulary, text)


def test_model_file(spark):
    count = library(*viterbi.vocabulary(PATH), True)
    rng = random.Random(2)
    texts = ["", " ", "  two  blanks ", "The quick brown fox.", "naïve façade – 漢字 😀\n\ttab", "<s> </s> <unk> <0x0A>", "x" * 300,
             *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz éß.,\n") for _ in range(rng.randint(0, 200))) for _ in range(200)), "long words " * 20_000]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, "clash"), (3, texts[3], "clash")]
    out = viterbi.token_counts(spark.createDataFrame(rows, schema), PATH)
    assert out.columns == ["doc_id", "n_tokens"]
    expected = [(d, count(t) if t else 0) for d, t, _ in rows]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))
    assert viterbi.token_counts(spark.createDataFrame([], schema), PATH).count() == 0
