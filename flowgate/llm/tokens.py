"""Token counts of documents and their sections from one encoding of the whole text.

The whole document is encoded once. Byte-level tokens cover the UTF-8 bytes of the text without gaps, so the running
sum of token lengths is the offset map. Sections are intervals of the same axis; tokens are joined to them by binary
search. A token that crosses a boundary is allocated by a rule:

``first``     the section that holds the token's first byte
``most``      the section that holds most of its bytes, the earliest of equal ones
``share``     every section it touches, in proportion to its bytes (counts are then fractions)
"""

from __future__ import annotations

import base64
import json
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.llm.common import from_texts, kept

RULES = ("first", "most", "share")
KNOWN_WORDS = 250_000  # encoded words that a worker keeps, some 50 MB


class Words(dict):
    """Ids of words after a space, as bytes; a word that is not there yet is encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError("white space that is not a single space")
        ids = self.encode(" " + word)
        if len(self) < KNOWN_WORDS and len(word) < 64:
            self[word] = ids
        return ids


class ByteBpe:
    """Ids of the byte-level vocabulary, equal to those of its ``tokenizers`` file without a post-processor's tokens.

    ``vocabulary`` is the rank file. Text is cut at single spaces between other characters, where the split pattern always
    starts a new piece; most words are then known. A text with another run of white space is encoded whole. ``added`` are the
    file's added tokens (content, id): a text is first cut at them, and each gives its id. Without them such strings are ordinary text.
    """

    def __init__(self, vocabulary: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max([*ranks.values(), *(i for _, i in added)]) + 1, dtype=np.int64)
        for token, rank in [*ranks.items(), *((content.encode(), i) for content, i in added)]:
            self.lengths[rank] = len(token)
        self.added = {content: array("I", [i]).tobytes() for content, i in added}
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.words = Words(self._whole)

    def _whole(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit little-endian integers; none for a null or empty text."""
        text, data, at = text or "", [], 0
        for cut in self.cuts.finditer(text) if self.cuts else ():
            data += [self._ordinary(text[at : cut.start()]), self.added[cut[0]]]
            at = cut.end()
        return np.frombuffer(b"".join([*data, self._ordinary(text[at:])]), dtype="<u4")

    def _ordinary(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace() and rest:
                raise LookupError
            return (self._whole(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))
        except LookupError:
            return self._whole(text)


def byte_bpe(vocabulary: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> ByteBpe:
    return kept(("tokens", vocabulary, pattern, added), lambda: ByteBpe(vocabulary, pattern, added))


def installed_bpe() -> tuple[str, str]:
    """Rank file and split pattern of the installed 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def installed_added() -> tuple[tuple[str, int], ...]:
    """Added tokens of the installed ``tokenizers`` file and their ids."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens are matched as they stand only")
    return tuple((t["content"], t["id"]) for t in tokens)


def line_starts(data: bytes) -> np.ndarray:
    """Sections are lines; a line feed ends its own line. An empty text has one empty section."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    return np.concatenate(([0], ends[ends < len(data)])).astype(np.int64)


def allocate(lengths: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and boundary-crossing tokens per section that gets (a part of) them.

    ``lengths``: bytes of each token, ``starts``: first byte of each section, ascending from 0, ``total``: bytes in all.
    Zero-length tokens do not occur. The counts add up to the number of tokens under every rule.
    """
    n = len(starts)
    counts, crossing = np.zeros(n), np.zeros(n, dtype=np.int64)
    if not len(lengths):
        return counts, crossing
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    inside = first == last
    counts += np.bincount(first[inside], minlength=n)
    edges = np.append(starts, total)
    for t in np.flatnonzero(~inside):
        own = np.arange(first[t], last[t] + 1)
        part = np.minimum(edges[own + 1], ends[t]) - np.maximum(edges[own], begins[t])
        if rule == "share":
            counts[own] += part / lengths[t]
            crossing[own] += 1
        else:
            to = own[0] if rule == "first" else own[int(np.argmax(part))]
            counts[to] += 1
            crossing[to] += 1
    return counts, crossing


SECTIONS = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long, doc_tokens long"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "most", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """One row per document and section (line): character span, tokens by ``rule``, crossing tokens among them, document total.

    A null or empty text has one empty section without tokens. A null id stays null. Repeated rows are counted each by
    themselves. Other columns are ignored. Spans are code points; a token that starts inside a character belongs where
    the character is. Nothing is shuffled: each text is read once, and work is linear in its length.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    vocabulary, pattern = tokenizer or installed_bpe()
    added = () if tokenizer else installed_added()

    def make(batch):
        bpe = byte_bpe(vocabulary, pattern, added)
        out = {k: [] for k in ("doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")}
        texts = batch.column(1).to_pylist()
        for doc, text, ids in zip(batch.column(0).to_pylist(), texts, map(bpe.encode, texts), strict=True):
            data = (text or "").encode()
            starts = line_starts(data)
            lengths = bpe.lengths[ids]
            counts, crossing = allocate(lengths, starts, len(data), rule)
            # code points before each byte: bytes that do not continue a character
            points = np.concatenate(([0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)))
            spans = points[np.append(starts, len(data))]
            n = len(starts)
            out["doc_id"] += [doc] * n
            out["section"] += range(n)
            out["start"] += spans[:-1].tolist()
            out["end"] += spans[1:].tolist()
            out["n_tokens"] += counts.tolist()
            out["n_crossing"] += crossing.tolist()
            out["doc_tokens"] += [len(lengths)] * n
        return out

    return from_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", make, SECTIONS)
