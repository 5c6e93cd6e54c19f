"""The sums of offsets against the offsets themselves."""

import struct
import zlib

import public_tokenizers

from docloom.llm import byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_spans_sum_up_the_offsets(spark):
    texts = [None, "", "plain words", "👍🏽 é 日本語 x", "a" * 300, "ＡＢＣ ß ſ 👩‍👩‍👧"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in byte_bpe.encode(docs, VOCABULARY, offsets=True, spans=True).collect():
        assert r.n_split == sum(b < a for a, b in zip(r.ends, r.starts[1:]))
        assert r.spans_crc32 == zlib.crc32(struct.pack(f"<{2 * len(r.ids)}i", *r.starts, *r.ends))
        if r.doc_id in (0, 1, 2, 4):
            assert r.n_split == 0
        elif r.doc_id == 3:
            assert r.n_split > 0
