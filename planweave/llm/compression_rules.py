"""Quality rules: word statistics and zstandard compression bands.

Repetitive text compresses far below ordinary prose of its length, and random
or encoded text hardly compresses. A band gives, for texts up to a length, the
lowest and highest accepted ratio of compressed to plain bytes. The whole text
must lie in the band of its length, and of its fixed-size chunks at most a
quarter of the bytes may lie outside the band of the chunk's length, so that a repetitive part
of a long document shows although the whole looks ordinary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bound_arrow_batches, free_name

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))

#: (bytes at most, lowest ratio, highest ratio) for whole texts. From 256 bytes to 16 KB the lowest is the 0.5 %
#: quantile, less 0.003, of the texts of its length that are labelled clean, lie in the training folds of sf0.1 and
#: pass the base rule; the highest is their 99.5 % quantile and 0.1, as no rejectable text lay above the clean ones.
#: To 32 KB there are 12 such texts: the lowest is half-way from the least of them to the highest rejectable one.
#: Other lengths have no clean labels, so their limits are wide.
BANDS = (
    (128, 0.45, 2.00),
    (256, 0.42, 1.20),
    (512, 0.543, 0.809),
    (724, 0.535, 0.780),
    (1 << 10, 0.510, 0.724),
    (1448, 0.491, 0.668),
    (2 << 10, 0.476, 0.635),
    (2896, 0.464, 0.617),
    (4 << 10, 0.452, 0.589),
    (5793, 0.438, 0.571),
    (8 << 10, 0.426, 0.562),
    (11585, 0.419, 0.549),
    (16 << 10, 0.413, 0.539),
    (32 << 10, 0.392, 0.66),
    (64 << 10, 0.37, 0.66),
    (1 << 62, 0.35, 0.66),
)
CHUNK = 4096
#: A shorter rest counts with the chunk before it.
LEAST_CHUNK = 1024
#: The like for chunks, by their length.
CHUNK_BANDS = ((2048, 0.484, 0.649), (4095, 0.453, 0.602), (CHUNK, 0.445, 0.576), (1 << 62, 0.439, 0.571))
MAX_CHUNK_SHARE = 0.25
LEVEL = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, odd_chunk_share double, kept boolean"
)


def repeat_words(words: list[bytes]) -> int:
    """The words that lie in a 3-word window which the list holds twice or more."""
    n = len(words)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if n < 4 or len(index) == n:
        return 0
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    base = len(index)
    pairs = ids[:-1] * base + ids[1:]
    if base > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * base + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, windows)
    found = twice[np.minimum(at, len(twice) - 1)] == windows
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= found
    return int(covered.sum())


def chunks(text: bytes) -> list[bytes]:
    cuts = list(range(0, max(len(text), 1), CHUNK))
    if len(cuts) > 1 and len(text) - cuts[-1] < LEAST_CHUNK:
        cuts.pop()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def within(bands: tuple[tuple[int, float, float], ...], size: int, ratio: float) -> bool:
    return next(low <= ratio <= high for most, low, high in bands if size <= most)


def compression(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in chunks outside their band, and whether both pass."""
    if not text:
        return 1.0, 0.0, False
    ratio = len(packer.compress(text)) / len(text)
    odd = 0
    if len(text) > CHUNK:
        for part in chunks(text):
            odd += len(part) * (not within(CHUNK_BANDS, len(part), len(packer.compress(part)) / len(part)))
    share = odd / len(text)
    return ratio, share, within(BANDS, len(text), ratio) and share <= MAX_CHUNK_SHARE


def judge(text: bytes | None, packer: zstandard.ZstdCompressor) -> dict:
    text = text or b""
    words = text.split()  # splits bytes at the six ASCII spaces only
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    ratio, share, passed = compression(text, packer)
    return {
        "n_words": len(words),
        "word_chars": len(text.translate(None, CONTINUATION + SPACES)),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "ratio": ratio,
        "odd_chunk_share": share,
        "kept": passed and not failed,
    }


def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    kind = pa.struct(
        [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("base_failed", pa.bool_()), ("ratio", pa.float64()), ("odd_chunk_share", pa.float64()), ("kept", pa.bool_())]
    )
    for batch in batches:
        yield pa.array([judge(text.as_py(), packer) for text in batch], kind)


def compression_quality(docs: DataFrame, text_col: str = "text", into: str = "verdict") -> DataFrame:
    """docs with a struct column of statistics and the verdict `kept`; one pass, no shuffle.

    A null text counts as empty: no words, base_failed, not kept. Repeated rows
    are judged each for itself. Other columns are untouched; where one is named
    like `into`, the new one gets a leading underscore.
    """
    bound_arrow_batches(docs.sparkSession)
    verdict = F.arrow_udf(judged, VERDICT).asNondeterministic()  # else a filter on it would run it again
    return docs.withColumn(free_name(docs, into), verdict(F.col(text_col).cast("binary")))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    name = free_name(docs, "verdict")
    return compression_quality(docs, text_col).where(F.col(f"{name}.kept")).select(*[docs[c] for c in docs.columns])
