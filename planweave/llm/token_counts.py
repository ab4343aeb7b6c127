"""Token counts by a public tokenizer, as lengths only.

An Arrow function receives texts, cuts long ones at safe boundaries, and encodes
the pieces in batches of about equal bytes. A boundary is safe where the tokenizer
itself cuts and nothing before it looks across: at white space, if the tokenizer
drops it before its merges, none of its special strings holds any and its
normal form composes nothing with it; and after an ASCII digit, if every digit is
a piece of its own. Whether that is so is read from the tokenizer's file. Then
counts add up over words, and each worker encodes a word once while it stays in a
bounded store. With any other tokenizer whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bound_arrow_batches, byte_groups, free_name

#: Words whose counts a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 300_000
#: Bytes of words in one call of the library.
CALL_BYTES = 1 << 18
#: Bytes of a text that are cut into words at once.
PIECE_BYTES = 1 << 22
SPACES = b" \t\n\v\f\r"


DIGITS = b"0123456789"


def pieces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text, cut before white space or after a digit into parts of at most limit bytes, or more where neither comes for longer."""
    start = 0
    while len(text) - start > limit:
        cut = max(text.rfind(bytes([c]), start, start + limit) for c in SPACES)
        if cut <= start:
            cut = max(text.rfind(bytes([c]), start, start + limit) for c in DIGITS) + 1
        if cut <= start:
            later = re.compile(rb"[\x09-\x0d ]|[0-9]").search(text, start + limit)
            if not later:
                break
            cut = later.end() if later.group().isdigit() else later.start()
        yield text[start:cut]
        start = cut
    yield text[start:]


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer's file says that it drops white space and takes every digit by itself, so that counts of words add up.

    It must cut by a pattern first, keep nothing but what the pattern matches, and
    the pattern must match neither white space nor a digit together with others.
    """
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    cut = own.get("pre_tokenizer") or {}
    cut = cut["pretokenizers"][0] if cut.get("type") == "Sequence" else cut
    if cut.get("type") != "Split" or cut.get("behavior") != "Removed" or not cut.get("invert"):
        return False
    pattern = cut.get("pattern", {}).get("Regex", "")
    alone = {"[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+"}
    if not all(x in alone or re.fullmatch("'[a-z]+", x) for x in pattern.split("|")) or not alone <= set(pattern.split("|")):
        return False
    normal = own.get("normalizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    known = all(x.get("type") in ("NFC", "Lowercase") or (x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " ") for x in steps)
    special = [x["content"] for x in own.get("added_tokens", [])]
    return known and not any(re.search(r"\s|[0-9]", x) for x in special) and not any(x.get("lstrip") or x.get("rstrip") for x in own.get("added_tokens", []))


class WordCounter:
    """Counts the tokens of texts with one tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}
        self.by_word = cuts_at_spaces(path)

    def whole(self, texts: list[bytes]) -> np.ndarray:
        """Counts of texts that are encoded as they are."""
        out = np.zeros(len(texts), np.int64)
        for group in byte_groups(texts, CALL_BYTES):
            found = self.tokenizer.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in group], add_special_tokens=False)
            out[group] = [len(x) for x in found]
        return out

    def learn(self, words: set[bytes]) -> None:
        new = sorted(words.difference(self.known), key=len)
        for group in byte_groups(new, CALL_BYTES):
            part = [new[i].decode("utf-8", "replace") for i in group]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip((new[i] for i in group), map(len, found), strict=True))

    def count(self, texts: list[bytes]) -> np.ndarray:
        if not self.by_word:
            return self.whole(texts)
        out = np.zeros(len(texts), np.int64)
        for group in byte_groups(texts, PIECE_BYTES):
            for i, words in [(i, part.split()) for i in group for part in pieces(texts[i])]:
                if len(self.known) > KEPT_WORDS:
                    self.known.clear()
                self.learn(set(words))
                out[i] += sum(map(self.known.__getitem__, words))
        return out


def _counter(path: str, limit: int):
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = WordCounter(path)
        for batch in batches:
            texts = [x or b"" for x in batch.to_pylist()]
            n = counter.count(texts)
            yield pa.StructArray.from_arrays(
                [pa.array([len(x) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                ["n_bytes", "n_tokens", "over_limit"],
            )

    return F.arrow_udf(counted, "n_bytes long, n_tokens long, over_limit boolean").asNondeterministic()


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """docs with a struct column `tokens` of n_bytes, n_tokens and over_limit; one pass, no shuffle.

    tokenizer: path of a tokenizer's JSON file on every executor; counts are those of its library for the whole
    text, whether it is cut into words or not. A null text counts
    as empty (0 bytes, 0 tokens). Repeated rows count each for itself. A very long
    text is encoded in pieces if the tokenizer has safe boundaries. A name
    clash gives the new column a leading underscore.
    """
    bound_arrow_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, "tokens"), _counter(tokenizer, limit)(F.col(text_col).cast("binary")))
