"""Secrets in texts: three fixed rules, and a linear-chain conditional random field beside them.

Texts are cut into tokens: runs of letters, digits, ``+/_.-`` and bytes beyond ASCII, or a single
other byte; blanks part them. A token is the begin of a secret, inside one, or outside. Its score
in each state is a sum of learned weights: of its shape (length, character classes, hex, changes
between letters and digits; with and without the case of letters), of itself and its neighbours as words (three before, one after), and
of the file (shares of punctuation and of tokens with digits, length). Transitions have weights of
their own; inside never follows outside. The best tagging is found by Viterbi over the whole text,
never over windows: texts lie one after the other in a chain whose links forget the past where a
text starts, and blocks of the chain are solved side by side by max-plus products.

The field is fitted by maximum likelihood on at most ``rows_a_kind`` texts that hold a rule's match
and as many that hold none, of up to ``most_bytes`` and out of ``drawn`` rows (bounds of the fit
only; every text is tagged whole). What the rules match are the tags it learns from, so it finds more of what looks
and stands like them: upper-case digests, keys of other lengths, values after other words.

Nulls: a null text is empty and has no span. Without any row that a rule matches nothing is learned
and only the rules speak. Repeated rows and ids do not matter, each row is judged by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.rows import hash_sample, run_hashes, slices, with_text_column
from martwright.llm.tables import keep

OUT, BEGIN, INSIDE = 0, 1, 2
_NEVER = -40.0
KINDS = ("assign", "access", "hex", "crf")

# --- the rules -------------------------------------------------------------------------------

# The three rules. Runs below the least length are no match, so that the last two
# can state it in the pattern; the first keeps what it consumed.
_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE,
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LEAST_VALUE = 6

#: A text that has any match of the rules, for Spark's regular expressions.
ANY_RULE = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}"
    r"|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"
)


def rule_matches(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of every match, in bytes, in order."""
    found = [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [
            (m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= _LEAST_VALUE
        ]
    return sorted(found)


# --- tokens and their features ---------------------------------------------------------------

_CLASS = np.full(256, 2, np.uint8)  # 0 blank, 1 part of a run, 2 a token by itself
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
for _byte in b"0123456789+/_.-":
    _CLASS[_byte] = 1
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1

_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 24, 32, 48])
_CHANGES = np.array([1, 2, 4, 8])
_SHAPES = (len(_LENGTHS) + 1) * 32 * (len(_CHANGES) + 1)
_WORDS = 4096  # punctuation by its byte, then buckets of hashed words
_EDGE, _MIXED, _NUMBER = 0, 1, 2
_SHARES = np.array([0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7])
_SIZES = np.array([16, 64, 256, 1024, 4096, 16384, 65536])
_NEAR = (0, -1, -2, -3, 1)
_VOID = 2 * _SHAPES + len(_NEAR) * _WORDS + 3 * 8  # evidence left out: weighs nothing
N_FEATURES = _VOID + 1


class Tokens:
    """Tokens of some texts: ``start`` and ``end`` bytes, ``first`` of each text (and the number
    of all), ``features`` as one column of weight numbers a token."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[
            texts.offset : texts.offset + len(texts) + 1
        ]
        self.base = offsets - offsets[0]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else (
            np.zeros(0, np.uint8)
        )
        self.data = data
        kind = _CLASS[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[self.base] = True
        joined = np.zeros(len(data) + 1, bool)  # with the byte before
        joined[1:-1] = (kind[1:] == 1) & (kind[:-1] == 1)
        joined &= ~cut
        solid = kind > 0
        self.start = np.flatnonzero(solid & ~joined[:-1])
        self.end = np.flatnonzero(solid & ~joined[1:]) + 1
        self.first = np.searchsorted(self.start, self.base)
        self.features = self._features()

    def _features(self) -> np.ndarray:
        data, start, end = self.data, self.start, self.end
        size = end - start
        low, high = (data >= 97) & (data < 123), (data >= 65) & (data < 91)
        digit = (data >= 48) & (data < 58)

        def count(flag: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int32)
            np.cumsum(flag, dtype=np.int32, out=sums[1:])
            return sums[end] - sums[start]

        lows, highs, digits = count(low), count(high), count(digit)
        far = count(data >= 128)
        hexes = count(digit | ((data >= 97) & (data < 103)) | ((data >= 65) & (data < 71)))
        turned = np.zeros(len(data), bool)
        turned[1:] = digit[1:] != digit[:-1]
        if len(start):
            turned[start] = False
        changes = count(turned)
        other = size - lows - highs - digits - far
        flags = 4 * (digits > 0) + 8 * (other > 0) + 16 * ((hexes == size) & (size >= 8))

        def shape(flags: np.ndarray) -> np.ndarray:
            sized = np.searchsorted(_LENGTHS, size, "right") * 32 + flags
            return sized * (len(_CHANGES) + 1) + np.searchsorted(_CHANGES, changes, "right")

        folded = np.where(high, data | 0x20, data)
        hashed = run_hashes(folded, start, end, 2) % np.uint64(_WORDS - 256)
        word = np.where(
            lows + highs + far == size, 256 + hashed.astype(np.int64),
            np.where(digits == size, _NUMBER, _MIXED),
        )
        lone = (size == 1) & (_CLASS[data[start]] == 2)
        word = np.where(lone, data[start], word) if len(start) else word

        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        # With the case of its letters, and whatever the case.
        cased, any_case = flags + (lows > 0) + 2 * (highs > 0), flags + (lows + highs > 0)
        columns = [shape(cased), _SHAPES + shape(any_case)]
        for place, step in enumerate(_NEAR):
            near = np.arange(len(start)) + step
            known = (near >= self.first[:-1][text]) & (near < self.first[1:][text])
            columns.append(
                np.where(known, word[np.clip(near, 0, max(len(start) - 1, 0))], _EDGE)
                + 2 * _SHAPES + place * _WORDS
            )
        many = np.maximum(np.diff(self.first), 1)
        at = 2 * _SHAPES + len(_NEAR) * _WORDS
        for flag in (lone, digits > 0):
            share = np.bincount(text, flag, len(many)) / many
            columns.append((at + np.searchsorted(_SHARES, share, "right"))[text])
            at += 8
        columns.append((at + np.searchsorted(_SIZES, np.diff(self.first), "right"))[text])
        return np.stack(columns).astype(np.int32)

    def starts(self) -> np.ndarray:
        """Whether each token is the first of its text."""
        flags = np.zeros(len(self.start) + 1, bool)
        flags[self.first] = True
        return flags[:-1]


# --- the field -------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights: a row of three states for each feature, transitions, and states of a first token."""

    weights: np.ndarray
    moves: np.ndarray
    opening: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros((features.shape[1], 3), self.weights.dtype)
        for column in features:
            total += np.take(self.weights, column, axis=0)
        return total


def _links(field: Field, scores: np.ndarray, first: np.ndarray, block: int) -> np.ndarray:
    """Log-weights from each state before to each state now, as blocks x block x 3 x 3; a first
    token forgets the state before. Filled up by links that cost nothing."""
    n = len(scores)
    room = -(-n // block) * block
    links = np.zeros((room, 3, 3))
    links[:n] = field.moves[None] + scores[:, None, :]
    links[:n][first] = (field.opening + scores[first])[:, None, :]
    return links.reshape(-1, block, 3, 3)


def _reach(links: np.ndarray, block: int) -> np.ndarray:
    """Best score of each state before each of some links in a row (max-plus prefix products)."""
    n = len(links)
    if n <= block:
        before = np.zeros((n, 3))
        for i in range(1, n):
            before[i] = (before[i - 1][:, None] + links[i - 1]).max(0)
        return before
    room = np.full((-(-n // block) * block, 3, 3), _NEVER * 1e6)
    room[:, range(3), range(3)] = 0.0  # links that change nothing
    room[:n] = links
    room = room.reshape(-1, block, 3, 3)
    whole = room[:, 0]
    for i in range(1, block):
        whole = (whole[:, :, :, None] + room[:, i, None, :, :]).max(2)
    now = _reach(whole, block)
    before = np.empty((len(room), block, 3))
    for i in range(block):
        before[:, i] = now
        now = (now[:, :, None] + room[:, i]).max(1)
    return before.reshape(-1, 3)[:n]


def viterbi(field: Field, scores: np.ndarray, first: np.ndarray, block: int = 64) -> np.ndarray:
    """The best state of every token; of equal ones the first."""
    n = len(scores)
    if not n:
        return np.zeros(0, np.int64)
    links = _links(field, scores, first, block)
    count = len(links)
    whole = links[:, 0]
    for i in range(1, block):
        whole = (whole[:, :, :, None] + links[:, i, None, :, :]).max(2)
    now = _reach(whole, block)
    came = np.empty((block, count, 3), np.int64)
    for i in range(block):
        steps = now[:, :, None] + links[:, i]
        came[i] = steps.argmax(1)
        now = steps.max(1)
    # From each state at the end of a block back to its start, then from block to block.
    path = np.empty((block + 1, count, 3), np.int64)
    path[block] = np.arange(3)
    for i in range(block - 1, -1, -1):
        path[i] = np.take_along_axis(came[i], path[i + 1], 1)
    back, state = path[0].tolist(), int(now[-1].argmax())
    ends = [0] * count
    for b in range(count - 1, -1, -1):
        ends[b] = state
        state = back[b][state]
    best = path[1:, np.arange(count), ends]  # block x count
    return best.T.reshape(-1)[:n]


def expectations(field: Field, scores: np.ndarray, first: np.ndarray, block: int = 64):
    """Posterior of each state of each token; summed posteriors of moves; of first states."""
    n = len(scores)
    links = np.exp(_links(field, scores - scores.max(1, keepdims=True), first, block))
    count = len(links)
    ahead = np.empty_like(links)  # products from the block's start
    ahead[:, 0] = links[:, 0]
    for i in range(1, block):
        step = ahead[:, i - 1] @ links[:, i]
        ahead[:, i] = step / step.max((1, 2), keepdims=True)
    rest = np.empty_like(links)  # products of what follows in the block
    rest[:, -1] = np.eye(3)
    for i in range(block - 2, -1, -1):
        step = links[:, i + 1] @ rest[:, i + 1]
        rest[:, i] = step / step.max((1, 2), keepdims=True)
    begin, finish = np.empty((count, 3)), np.empty((count, 3))
    now, later = np.full(3, 1 / 3), np.ones(3)
    for b in range(count):
        begin[b] = now
        now = now @ ahead[b, -1]
        now = now / now.sum()
    for b in range(count - 1, -1, -1):
        finish[b] = later
        later = ahead[b, -1] @ later
        later = later / later.sum()
    alpha = np.einsum("bi,blij->blj", begin, ahead).reshape(-1, 3)
    beta = np.einsum("blij,bj->bli", rest, finish).reshape(-1, 3)
    each = alpha * beta
    each = each[:n] / each[:n].sum(1, keepdims=True)
    pairs = alpha[: n - 1, :, None] * links.reshape(-1, 3, 3)[1:n] * beta[1:n, None, :]
    pairs = (pairs / pairs.sum((1, 2), keepdims=True))[~first[1:]].sum(0)
    return each, pairs, each[first].sum(0)


def _thinned(features: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Features of which half of the tokens miss the neighbours, half the case of their letters."""
    thin = features.copy()
    many = thin.shape[1]
    thin[3 : 2 + len(_NEAR), rng.random(many) < 0.5] = _VOID
    thin[0, rng.random(many) < 0.5] = _VOID
    return thin


def fit(batches: list[tuple[Tokens, np.ndarray]], rounds: int = 60, rate: float = 0.5,
        penalty: float = 1e-4, seed: int = 1) -> Field:
    """Maximum likelihood with a quadratic penalty, by AdaGrad over all batches in every round.

    ``batches``: tokens and their states. What the rules match always stands after the same few
    words in the same case; so that weight does not gather there alone, each round hides some of
    this from some tokens, drawn anew from ``seed``.
    """
    rng = np.random.default_rng(seed)
    field = Field(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), np.zeros(3))
    field.moves[OUT, INSIDE] = field.opening[INSIDE] = _NEVER
    total = max(1, sum(len(states) for _, states in batches))
    memory = [np.full_like(x, 1e-8) for x in (field.weights, field.moves, field.opening)]
    for _ in range(rounds):
        slopes = [np.zeros_like(x) for x in (field.weights, field.moves, field.opening)]
        for tokens, states in batches:
            first = tokens.starts()
            features = _thinned(tokens.features, rng)
            each, pairs, opened = expectations(field, field.scores(features), first)
            gap = np.eye(3)[states] - each
            for column in features:
                for k in range(3):
                    slopes[0][:, k] += np.bincount(column, gap[:, k], N_FEATURES)
            real = np.zeros((3, 3))
            follows = ~first[1:]
            np.add.at(real, (states[:-1][follows], states[1:][follows]), 1)
            slopes[1] += real - pairs
            slopes[2] += np.eye(3)[states[first]].sum(0) - opened
        for x, slope, seen in zip((field.weights, field.moves, field.opening), slopes, memory):
            slope = slope / total - penalty * x * (x > _NEVER)
            seen += slope**2
            x += rate * slope / np.sqrt(seen)
        field.weights[_VOID] = 0.0
        field.moves[OUT, INSIDE] = field.opening[INSIDE] = _NEVER
    return Field(field.weights.astype(np.float32), field.moves, field.opening)


def rule_states(tokens: Tokens) -> np.ndarray:
    """The state of each token by the rules: what overlaps the secret part of a match."""
    states = np.zeros(len(tokens.start), np.int64)
    whole = tokens.data.tobytes()
    for i in range(len(tokens.base) - 1):
        low, high = tokens.base[i], tokens.base[i + 1]
        reached = -1
        for _, _, end, secret in sorted(rule_matches(whole[low:high]), key=lambda m: m[3]):
            a = int(np.searchsorted(tokens.end, low + secret, "right"))
            b = int(np.searchsorted(tokens.start, low + end))
            if a < b and a >= reached:
                states[a] = BEGIN
                states[a + 1 : b] = INSIDE
                reached = b
    return states


def learn(
    docs: DataFrame, text: str = "text", rows_a_kind: int = 300, most_bytes: int = 8192,
    drawn: int = 20_000, batch_bytes: int = 1 << 18,
) -> Field | None:
    """A field fitted on a bounded sample of ``docs``; None where no text of it has a match.

    About ``drawn`` rows are drawn by a hash of their texts, equal texts counting once, and of
    these ``rows_a_kind`` with a rule's match and as many without.
    """
    share = min(1.0, drawn / max(1, docs.count()))
    body = docs.select(F.col(text).cast("string").alias("body"))
    some = body.where(
        F.octet_length("body").between(1, most_bytes)
        & (F.pmod(F.xxhash64(F.lit(5), "body"), F.lit(1 << 40)) < int(share * (1 << 40)))
    ).distinct()
    kind = F.when(F.col("body").rlike(ANY_RULE), 1).otherwise(0).alias("kind")
    labelled = keep(some.select("body", kind), "labelled")
    chosen = hash_sample(labelled, "kind", rows_a_kind, "body").select("body", "kind").toArrow()
    if not pc.any(pc.equal(chosen.column("kind"), 1)).as_py():
        return None
    chosen = chosen.sort_by("body")
    column = chosen.column("body").combine_chunks()
    batches = []
    for _, piece in slices(column, batch_bytes):
        tokens = Tokens(piece)
        if len(tokens.start):
            batches.append((tokens, rule_states(tokens)))
    return fit(batches)


# --- spans -----------------------------------------------------------------------------------

SPANS = (
    "struct<n_assign: long, n_access: long, n_hex: long,"
    " spans: array<struct<kind: string, start: long, stop: long>>>"
)
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
_TYPE = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                   ("spans", pa.list_(_SPAN))])


def _undecided(field: Field, scores: np.ndarray) -> np.ndarray:
    """Tokens that may be in a secret. A text without any is best tagged outside throughout.

    Take a run of k tokens that are not outside and tag them outside instead: of its k + 1 moves
    each loses at most ``gain``, and each token wins its lead. A lead of twice the gain suffices.
    """
    moves, opening = field.moves - field.moves[OUT, OUT], field.opening - field.opening[OUT]
    gain = max(0.0, moves.max(), (opening[1:]).max())
    return scores[:, OUT] - scores[:, 1:].max(1) <= 2 * gain


def field_spans(field: Field, tokens: Tokens) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) in bytes of each begin and the insides after it."""
    scores = field.scores(tokens.features)
    states = np.full(len(scores), OUT)
    open_ = np.flatnonzero(_undecided(field, scores))
    if len(open_):
        which = np.unique(np.searchsorted(tokens.first, open_, "right") - 1)
        chosen = np.zeros(len(tokens.first) - 1, bool)
        chosen[which] = True
        of_them = np.repeat(chosen, np.diff(tokens.first))
        states[of_them] = viterbi(field, scores[of_them], tokens.starts()[of_them])
    begins = np.flatnonzero(states == BEGIN)
    if not len(begins):
        return
    stops = np.flatnonzero(np.append(states, OUT) != INSIDE)
    last = stops[np.searchsorted(stops, begins, "right")] - 1
    text = np.searchsorted(tokens.first, begins, "right") - 1
    for t, a, b in zip(text.tolist(), begins.tolist(), last.tolist()):
        yield t, int(tokens.start[a] - tokens.base[t]), int(tokens.end[b] - tokens.base[t])


def _spans_of(column: pa.Array, field: Field | None) -> pa.Array:
    out = []
    for _, piece in slices(column):
        tokens = Tokens(piece) if field is not None else None
        more: dict[int, list[tuple[int, int]]] = {}
        if tokens is not None:
            for t, a, b in field_spans(field, tokens):
                more.setdefault(t, []).append((a, b))
        for i in range(len(piece)):
            body = piece[i].as_buffer().to_pybytes()
            rules = rule_matches(body)
            found = [(a, kind, b) for a, kind, b, _ in rules]
            for a, b in more.get(i, ()):
                if all(b <= c or a >= d for c, _, d, _ in rules):
                    found.append((a, 3, b))
            found.sort()
            points = _points(body, found)
            out.append({
                **{f"n_{KINDS[k]}": sum(r[1] == k for r in rules) for k in range(3)},
                "spans": [{"kind": KINDS[k], "start": points[a], "stop": points[b]}
                          for a, k, b in found],
            })
    return pa.array(out, _TYPE)


def _points(body: bytes, spans: list[tuple[int, int, int]]) -> dict[int, int]:
    """Code points before each byte offset that a span names."""
    places, at, passed = {}, 0, 0
    for offset in sorted({x for a, _, b in spans for x in (a, b)}):
        passed += len(body[at:offset].decode())
        at = offset
        places[offset] = passed
    return places


def with_secrets(
    docs: DataFrame, field: Field | None, text: str = "text", into: str = "secrets"
) -> DataFrame:
    """``docs`` with a column of the matches of each rule and all spans of the whole text.

    Spans are in code points, the end exclusive, by start and then kind: the rules' matches, and as
    ``crf`` what the field tags and no rule's match overlaps. A column named ``into`` is replaced.
    """
    return with_text_column(docs, text, into, lambda column: _spans_of(column, field), SPANS)
