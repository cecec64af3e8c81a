"""Quality rules by compression: zstandard ratios of the whole text and of its fixed chunks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.rows import texts_of, with_text_column

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, n_chunks long, n_repetitive long, n_incompressible long, "
    "kept boolean"
)
BLANKS = bytes([9, 10, 11, 12, 13, 32])
SYMBOLS = b"#*$%&|<>"
#: Quartile distances beyond the quartiles: the outer fences of a box plot.
FENCE = 3


@dataclass(frozen=True)
class Bands:
    """Lowest and highest compressed share by text length.

    ``limits``: (bytes up to which the row holds, lowest, highest). Short texts compress badly
    whatever they say, so their band is wide. The default limits hold for any text; ``fit`` draws
    them closer to a corpus. A text is rejected if its own ratio leaves its band, or if more than ``chunk_share`` of its chunks of ``chunk`` bytes leave theirs.
    """

    limits: Sequence[tuple[float, float, float]] = (
        (96, 0.0, math.inf),
        (256, 0.36, math.inf),
        (1024, 0.32, 0.95),
        (4096, 0.25, 0.80),
        (16384, 0.20, 0.72),
        (math.inf, 0.16, 0.70),
    )
    chunk: int = 2048
    chunk_share: float = 0.25
    level: int = 3
    least_words: int = 50
    most_repeated_percent: int = 50

    def band(self, size: int) -> tuple[float, float]:
        return next((low, high) for most, low, high in self.limits if size <= most)


#: What ``fit`` finds in the 10,000 documents of sf0.1. Up to 256 bytes no text has words enough.
MEASURED = Bands(
    limits=(
        (96, 0.0, math.inf),
        (256, 0.36, math.inf),
        (512, 0.497, 0.771),
        (1024, 0.412, 0.724),
        (2048, 0.429, 0.593),
        (4096, 0.424, 0.532),
        (8192, 0.41, 0.496),
        (16384, 0.384, 0.488),
        (math.inf, 0.361, 0.468),
    )
)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, reached = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, reached)
            reached = i + 3
    return total


def measure(text: str, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = repeated_words(words)
    failed = (
        len(words) < bands.least_words
        or 100 * repeats > bands.most_repeated_percent * len(words)
    )

    def ratio(part: bytes) -> float:
        return len(press.compress(part)) / len(part) if part else 1.0

    whole = ratio(raw)
    low, high = bands.band(len(raw))
    chunks = [raw[i : i + bands.chunk] for i in range(0, len(raw), bands.chunk)]
    below = above = 0
    for part in chunks:
        part_low, part_high = bands.band(len(part))
        part_ratio = ratio(part) if len(chunks) > 1 else whole
        below += part_ratio < part_low
        above += part_ratio > part_high
    good = low <= whole <= high and below + above <= bands.chunk_share * len(chunks)
    return (
        len(words),
        len(text) - len(raw) + len(raw.translate(None, BLANKS)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        failed,
        whole,
        len(chunks),
        below,
        above,
        good and not failed,
    )


def with_quality(
    df: DataFrame, text: str = "text", into: str = "quality_rules", bands: Bands | None = None
) -> DataFrame:
    """``df`` with a struct of counts, ratios and the verdict ``kept`` for every row.

    A null text counts as empty: no words, ratio 1, not kept. Every row is judged by itself, so
    copies get equal verdicts; other columns pass unread, one named ``into`` is replaced.
    """
    bands = bands or Bands()
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def judge(column: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=bands.level)
        out = [measure(x, bands, press) for x in texts_of(column)]
        kinds = [pa.bool_() if x.endswith("boolean") else pa.float64() if x.endswith("double")
                 else pa.int64() for x in FIELDS.split(", ")]
        parts = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.StructArray.from_arrays(
            [pa.array(list(v), k) for v, k in zip(parts, kinds, strict=True)], names
        )

    return with_text_column(df, text, into, judge, f"struct<{FIELDS.replace(' ', ':').replace(',:', ', ')}>")


def filter_quality(df: DataFrame, text: str = "text", bands: Bands | None = None) -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    verdict = "__quality"
    return with_quality(df, text, verdict, bands).where(F.col(f"{verdict}.kept")).drop(verdict)


def fit(
    df: DataFrame, text: str = "text", bands: Bands | None = None, least_rows: int = 50
) -> Bands:
    """``bands`` with limits from the ratios of all texts of ``df`` that have words enough and do
    not repeat themselves: per length the quartiles and ``FENCE`` times their distance beyond.

    Lengths with fewer than ``least_rows`` texts keep their limits. The driver gets three numbers
    for each length.
    """
    bands = bands or MEASURED
    judged = with_quality(df.select(F.coalesce(F.col(text), F.lit("")).alias("text")), bands=bands)
    size, row = F.octet_length("text"), F.lit(len(bands.limits) - 1)
    for i, (most, _, _) in reversed(list(enumerate(bands.limits))[:-1]):
        row = F.when(size <= most, i).otherwise(row)
    found = (
        judged.where(~F.col("quality_rules.base_failed"))
        .groupBy(row.alias("row"))
        .agg(F.percentile_approx("quality_rules.ratio", [0.25, 0.75], 10_000).alias("q"),
             F.count("*").alias("n"))
        .collect()
    )
    limits = list(bands.limits)
    for r in found:
        if r["n"] >= least_rows:
            margin = FENCE * (r["q"][1] - r["q"][0])
            limits[r["row"]] = (limits[r["row"]][0], r["q"][0] - margin, r["q"][1] + margin)
    return replace(bands, limits=tuple(limits))
