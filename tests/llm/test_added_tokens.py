"""Ids of texts that hold an added token of the tokenizers file."""

from __future__ import annotations

import zlib

from flowgate.llm import packing, tokens

END = "<|endoftext|>"
TEXTS = ["a <|endoftext|> x", END, END + END, f"a{END}b", f" {END} ", f"x\n\n{END}\n y  z", "<|endoftext|", f"<{END}>", "it's 12,5 €\r\n", "", None]


def test_ids_and_counts_equal_the_tokenizers_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [reference.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    bpe = tokens.byte_bpe(*tokens.installed_bpe(), tokens.installed_added())
    for text, ids in zip(TEXTS, wanted, strict=True):
        assert bpe.encode(text).tolist() == ids and bpe.lengths[ids].sum() == len((text or "").encode())
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.doc_id: r.doc_tokens for r in tokens.token_counts(docs).collect()} == {i: len(x) for i, x in enumerate(wanted)}
    for r in packing.pack(docs).collect():
        ids = [*wanted[r.doc_id], packing.END_OF_TEXT][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids))
