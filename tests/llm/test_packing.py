"""op8's word-by-word encoder against the whole tokenizer on random Unicode texts, and what it does with other files."""

import random

import pyarrow as pa
import public_tokenizers

from strataspark.llm import op8_packing

#: Signs, spaces, letters that lower-casing or normal forms lengthen, shorten or join, and beginnings of special tokens.
POOL = list("abcXYZ019 .,!?;:$%&#*'\n\t-_") + list("éÉßİıǅŉΣσςΐаяД漢字가ﬁ①²½ʼ̈̇́ͅ‍ 　ẞªºևᾈ𝐀😀<|")
PLANES = (0x250, 0x3000, 0x11000, 0x1F700)


def fuzzed(rng):
    def any_of_plane():
        c = rng.randrange(0x20, rng.choice(PLANES))
        return "x" if 0xD800 <= c < 0xE000 else chr(c)

    return "".join(rng.choice(POOL) if rng.random() < 0.7 else any_of_plane() for _ in range(rng.randrange(1, 25)))


def test_encoder_equals_the_tokenizer_on_60000_texts():
    encode, rng = op8_packing.Encoder(op8_packing.default_tokenizer()), random.Random(3)
    texts = [fuzzed(rng) for _ in range(60_000)] + ["İ.", "xİ!", "T̈", "Ẃ.", "<|endoftext|> A", "<|ENDOFTEXT|>"]
    assert encode.by_words
    for a in range(0, len(texts), 1000):
        part = texts[a : a + 1000]
        for text, ids, whole in zip(part, encode(pa.array(part)), encode.whole.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert ids.tolist() == whole.ids, repr(text)


def test_other_tokenizer_files_encode_whole_texts():
    encode, rng = op8_packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    texts = [fuzzed(rng) for _ in range(500)] + ["", "Two  words."]
    assert not encode.by_words
    assert [ids.tolist() for ids in encode(pa.array(texts))] == [c.ids for c in encode.whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_one_document_many_times_is_dealt_over_groups(spark):
    n = 3 * op8_packing.GROUP
    docs = spark.createDataFrame([(7, "some words")], "doc_id long, text string").crossJoin(spark.range(n)).select("doc_id", "text")
    got = op8_packing.pack_documents(docs, op8_packing.default_tokenizer()).toPandas()
    assert len(got) == n and got.groupby("sequence_id").length.sum().max() <= 4096
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert (got.sequence_id // 2**32).value_counts().max() <= 1.2 * op8_packing.GROUP
