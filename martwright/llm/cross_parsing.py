"""Language identification by cross-parsing entropy.

Of each language a bounded sample is indexed by a suffix automaton, which knows every substring of
it. A text is parsed by each automaton into phrases, each the longest match from where the last one
ended; the language that needs fewest bits, phrases times the logarithm of its sample's length, for
a byte of text wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.rows import hash_sample, with_text_column

#: Parsing starts anew after so many bytes, so that a text of any length is parsed side by side.
BLOCK = 1024
LANES = 4096
UNKNOWN = "und"
FIELDS = "struct<lang:string, score:double, bits:double>"
_OTHER = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> bytes:
    """Lower-case letters, with one blank for whatever else; empty if there is no letter."""
    if not text:
        return b""
    plain = _OTHER.sub(" ", text.lower()).strip()
    return plain.encode() if any(map(str.isalpha, plain)) else b""


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads just the substrings of ``data``."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for byte in data:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and byte not in step[p]:
            step[p][byte] = now
            p = link[p]
        if p >= 0:
            q = step[p][byte]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(byte) == q:
                    step[p][byte] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


@dataclass
class Automata:
    """All languages' automata as one table.

    ``symbol``: a byte's column; bytes that no sample has share column 0, past a text's end is the
    last. ``table[state, column]`` is twice the next state, plus one if a phrase ended before the
    byte. ``root``: each language's first state.
    """

    langs: list[str]
    root: np.ndarray
    symbol: np.ndarray
    table: np.ndarray
    log_size: np.ndarray

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """languages x texts: the number of phrases each text falls into."""
        sizes = np.array([len(t) for t in texts])
        parts = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), parts)
        out = np.zeros((len(self.langs), len(texts)))
        blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
        order = sorted(range(len(blocks)), key=lambda i: len(blocks[i]))
        for start in range(0, len(order), LANES):
            lanes = order[start : start + LANES]
            width = len(blocks[lanes[-1]])
            flat = b"".join(blocks[i].ljust(width, b"\xff") for i in lanes)  # xff: not in UTF-8
            steps = self.symbol[np.frombuffer(flat, np.uint8)].reshape(len(lanes), width)
            steps = np.ascontiguousarray(steps.T)
            state = np.repeat(self.root[:, None], len(lanes), axis=1).astype(np.int32)
            count = np.ones(state.shape, np.int32)  # the last phrase
            columns = self.table.shape[1]
            cells = self.table.reshape(-1)
            for row in steps:
                found = cells[state * columns + row]
                count += found & 1
                state = found >> 1
            for lang in range(len(self.langs)):
                np.add.at(out[lang], owner[lanes], count[lang])
        return out


def _table(samples: dict[str, bytes]) -> Automata:
    langs = sorted(samples)
    seen = sorted(set(b"".join(samples.values())))
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    end = len(seen) + 1
    symbol[255] = end
    tables, roots, states = [], [], 0
    for lang in langs:
        step = suffix_automaton(samples[lang])
        here = np.full((len(step) + 1, end + 1), -1, np.int64)
        for i, ways in enumerate(step):
            for byte, to in ways.items():
                here[i, symbol[byte]] = to
        # No way on: a phrase ends and the byte begins another. A byte that the sample lacks is a
        # phrase by itself; the last state stands for that, there every byte begins a phrase.
        alone = len(step)
        again = 2 * (np.where(here[0] >= 0, here[0], alone) + states) + 1
        table = np.where(here >= 0, 2 * (here + states), again[None, :])
        table[0] -= here[0] < 0  # nothing has begun yet
        table[:, end] = 2 * (np.arange(alone + 1) + states)
        tables.append(table.astype(np.int32))
        roots.append(states)
        states += alone + 1
    sizes = np.array([max(len(samples[x]), 2) for x in langs], float)
    return Automata(langs, np.array(roots), symbol, np.concatenate(tables), np.log2(sizes))


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    sample_rows: int = 120, row_chars: int = 400, sample_bytes: int = 32_768,
) -> Automata:
    """Automata of a bounded sample of each language: ``row_chars`` characters, from a place set by
    a hash, of ``sample_rows`` rows with the smallest hashes, ``sample_bytes`` bytes in all.

    Rows with null text or language are left out. The driver gets one sample for each language,
    and their number is that of the label's values.
    """
    draw = F.xxhash64(F.col(key), F.col(text))
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    start = F.pmod(draw, F.greatest(F.char_length(text) - row_chars + 1, F.lit(1))).cast("int") + 1
    pieces = usable.select(
        F.col(lang).cast("string").alias("lang"), draw.alias("draw"),
        F.substring(F.col(text), start, F.lit(row_chars)).alias("piece"),
    )
    chosen = hash_sample(pieces, "lang", sample_rows, "draw", "piece")
    rows = chosen.orderBy("lang", "draw", "piece").select("lang", "piece").collect()
    samples: dict[str, list[bytes]] = {}
    for row in rows:
        samples.setdefault(row["lang"], []).append(normalised(row["piece"]))
    whole = {k: b" ".join(v)[:sample_bytes] for k, v in samples.items()}
    # A cut inside a character would be a byte that is no text.
    return _table({k: v.decode(errors="ignore").encode() for k, v in whole.items()}) if whole else None


def with_language(
    df: DataFrame, automata: Automata | None, text: str = "text", into: str = "language"
) -> DataFrame:
    """``df`` with struct (lang, score 0 to 1, bits a byte) for every row, by its whole text.

    Null texts, texts without a letter, and all texts if nothing was learned: ``und``, score 0.
    Of languages that need as few bits the first by name wins. A column named ``into`` is
    replaced, others pass unread.
    """
    shared = df.sparkSession.sparkContext.broadcast(automata)

    def judge(column: pa.Array) -> pa.Array:
        model = shared.value
        lang = np.full(len(column), UNKNOWN, object)
        score, bits = np.zeros(len(column)), np.zeros(len(column))
        texts = [normalised(x) for x in column.to_pylist()]
        rows = [i for i, t in enumerate(texts) if t] if model is not None else []
        held: list[int] = []
        size = 0
        for k, i in enumerate(rows):
            held.append(i)
            size += len(texts[i])
            if size < LANES * BLOCK and k + 1 < len(rows):
                continue
            lengths = np.array([len(texts[j]) for j in held], float)
            need = model.phrases([texts[j] for j in held]) * model.log_size[:, None] / lengths
            best = need.argmin(axis=0)
            least = need.min(axis=0)
            # Odds of the languages if the bits of 40 bytes told them apart.
            odds = np.exp2(-np.minimum((need - least) * np.minimum(lengths, 40), 60)).sum(axis=0)
            lang[held] = np.array(model.langs, object)[best]
            score[held] = 1 / odds
            bits[held] = least
            held, size = [], 0
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score), pa.array(bits)],
            ["lang", "score", "bits"],
        )

    return with_text_column(df, text, into, judge, FIELDS)
