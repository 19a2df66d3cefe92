"""Quality rules: word statistics and bands of zstandard ratios."""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import map_texts, packed

LEVEL = 3
CHUNK = 4096
BAD_CHUNKS = 0.5
#: Bytes, least and largest ratio of compressed to plain bytes there. The least ratio holds up to the next size, the
#: largest one is interpolated over log size. Largest ratios lie above English prose and technical notes and the test
#: data, below random base64 and letters; short texts compress less, so the lower-case letters alone pass below 3 KB.
BANDS = (
    (0, 0.0, 9.0), (128, 0.0, 1.06), (256, 0.20, 0.885), (384, 0.20, 0.82), (512, 0.20, 0.765), (768, 0.20, 0.72), (1024, 0.15, 0.68),
    (1536, 0.15, 0.64), (2048, 0.15, 0.61), (3072, 0.15, 0.57), (4096, 0.12, 0.55), (8192, 0.12, 0.51), (16384, 0.12, 0.48), (65536, 0.08, 0.47),
)
#: For texts with most bytes in characters of three bytes or more: above characters drawn by Zipf's law, below uniform ones
#: from about 4 KB.
WIDE_BANDS = ((0, 0.0, 9.0), (256, 0.20, 1.05), (512, 0.20, 0.90), (1024, 0.15, 0.80), (2048, 0.15, 0.755), (4096, 0.12, 0.72), (65536, 0.08, 0.715))
_WIDE_LEADS = bytes(range(0xE0, 0x100))
SYMBOLS = b"#*$%&|<>"


def band(size: int, bands: Sequence[tuple[int, float, float]] = BANDS) -> tuple[float, float]:
    """Least and largest ratio for a text of ``size`` bytes."""
    i = max(k for k, b in enumerate(bands) if size >= b[0])
    least, low, high = bands[i]
    if least and i + 1 < len(bands):
        high += (bands[i + 1][2] - high) * log2(size / least) / log2(bands[i + 1][0] / least)
    return low, high


def is_wide(raw: bytes) -> bool:
    """Most bytes stand in characters of three bytes or more."""
    return 6 * (len(raw) - len(raw.translate(None, _WIDE_LEADS))) > len(raw)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1].astype(np.int64) * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def word_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; zeros for null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(128))+ bytes(range(0xC0, 0x100))))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(raw), repeated_words(words)


def compression(text: str | None, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK, bad: float = BAD_CHUNKS, bands=BANDS, wide_bands=WIDE_BANDS) -> tuple[float | None, float | None, float | None, float, bool]:
    """Ratio of the whole text, least and largest ratio of full chunks, share of bytes in chunks outside their band, rejected."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return None, None, None, 0.0, False

    def judge(part: bytes) -> tuple[float, bool]:
        r = len(compressor.compress(part)) / len(part)
        low, high = band(len(part), wide_bands if is_wide(part) else bands)
        return r, not low <= r <= high

    whole = judge(raw)
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
    judged = [whole] if len(parts) == 1 else list(map(judge, parts))
    full = [r for (r, _), p in zip(judged, parts, strict=True) if len(p) == chunk]
    out = sum(len(p) for (_, wrong), p in zip(judged, parts, strict=True) if wrong) / len(raw)
    return whole[0], min(full, default=None), max(full, default=None), out, whole[1] or out > bad


def quality_rules(docs: DataFrame, ident: str = "doc_id", text: str = "text", bands: Sequence[tuple[int, float, float]] = BANDS, chunk: int = CHUNK, bad_chunks: float = BAD_CHUNKS, level: int = LEVEL, wide_bands: Sequence[tuple[int, float, float]] = WIDE_BANDS) -> DataFrame:
    """One row per input row: id, the word statistics, ratios, base_failed, rejected, kept.

    A text is rejected if the zstandard ratio of the whole lies outside the band of its length, or if
    more than ``bad_chunks`` of its bytes lie in chunks of ``chunk`` bytes outside theirs, the last
    chunk by the band of its own length: low ratios are repetitive, high ones are noise. base_failed: fewer than 50 words, or more than half of the words
    in repeated three-word windows. Kept is neither. Null and empty texts have zero counts and null
    ratios and fail the base rule; equal rows get equal results. Nothing is shuffled.
    """
    base = packed(docs, ident, text)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "least_chunk", "most_chunk", "bad_chunks", "rejected")
    kinds = (*[pa.int64()] * 5, *[pa.float64()] * 4, pa.bool_())

    def make():
        z = zstandard.ZstdCompressor(level=level)

        def judge(texts: list[str | None]) -> dict[str, pa.Array]:
            rows = [(*word_statistics(t), *compression(t, z, chunk, bad_chunks, bands, wide_bands)) for t in texts]
            return {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}

        return judge

    fields = ", ".join(f"{n} {'long' if i < 5 else 'double' if i < 9 else 'boolean'}" for i, n in enumerate(names))
    out = map_texts(base.select("id", "text"), make, fields)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("*", failed.alias("base_failed"), (~failed & ~F.col("rejected")).alias("kept"))
