"""Quality rules: counts of words, signs and repetition, and a line-labelling CRF.

A linear-chain conditional random field labels every line content or boilerplate.
Its weights are learnt from documents with a quality mark: the lines of good documents
are content but for repeated and bulleted ones, those of bad documents boilerplate. Viterbi
decoding runs over all texts of a batch at once, line by line. A document is kept if
enough of its characters lie in content lines and no base rule fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.arrays import NOT_BLANK, U64, mix, range_hashes, slices, text_bytes, words
from trialspark.llm.columns import from_text

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_CONTENT_SHARE = 0.5
REPEAT_WORDS = 8
MAX_TRAINING_ROWS = 8_192
ROUNDS = 25
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[np.frombuffer(SYMBOLS.encode(), np.uint8)] = True
_CONTENT, _BOILERPLATE = 0, 1
# Shares cut at these values make one-hot features.
_CUTS = np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
_SHARES = ("capitals", "signs", "symbols", "digits", "repeats", "twins")
_WIDTH = 1 + len(_SHARES) * (len(_CUTS) + 1) + 5 + 2


class Lines:
    """Lines and words of the texts of a batch, as flat arrays."""

    def __init__(self, part: pa.RecordBatch) -> None:
        data, offsets = text_bytes(part.column("text"))
        self.n = part.num_rows
        self.data, self.offsets = data, offsets
        breaks = np.flatnonzero(data == 10)
        filled = offsets[:-1][np.diff(offsets) > 0]
        start = np.union1d(filled, breaks + 1)
        # A break at the end of a text opens an empty line, which has no words; it is left out.
        self.start = start[(start < len(data))]
        self.end = np.concatenate((self.start[1:], [len(data)])) if len(self.start) else self.start
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.word_start, self.word_end, self.word_text = words(data, offsets)
        self.word_line = np.searchsorted(self.start, self.word_start, "right") - 1
        self.word = range_hashes(data, self.word_start, self.word_end)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.word_chars = lead[self.word_end] - lead[self.word_start]
        self.line_words = np.bincount(self.word_line, minlength=len(self.start))

    def repeated_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        end = self.end - (self.data[self.end - 1] == 10) if len(self.start) else self.end
        value = mix(range_hashes(self.data, self.start, end) ^ mix(self.text.astype(U64)))
        order = np.argsort(value, kind="stable")
        out = np.zeros(len(value), bool)
        out[order[1:]] = value[order[1:]] == value[order[:-1]]
        return out & (self.line_words > 0)

    def repeated_words(self) -> np.ndarray:
        """Words inside a run of eight words that stands twice or more in their text."""
        n = len(self.word) - REPEAT_WORDS + 1
        out = np.zeros(max(len(self.word), 1), np.int64)
        if n > 0:
            value = mix(self.word_text[:n].astype(U64))
            for i in range(REPEAT_WORDS):
                value = mix(value ^ self.word[i : i + n]) + U64(i + 1)
            inside = np.flatnonzero(self.word_text[:n] == self.word_text[REPEAT_WORDS - 1 :])
            value = value[inside]
            order = np.argsort(value)
            same = value[order[1:]] == value[order[:-1]]
            twice = np.zeros(len(inside), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            at = inside[twice]
            out += np.bincount(at, minlength=len(out))
            out -= np.bincount(np.minimum(at + REPEAT_WORDS, len(out)), minlength=len(out) + 1)[:-1]
        return (np.cumsum(out) > 0)[: len(self.word)]


def _per_line(lines: Lines, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[lines.end] - total[lines.start]


def line_features(lines: Lines, repeated: np.ndarray) -> np.ndarray:
    """For each line the places of its features that are one (the others are nought)."""
    data = lines.data
    size = np.maximum(_per_line(lines, NOT_BLANK[data]), 1)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    sign = NOT_BLANK[data] & ~letter & ~digit
    same = np.zeros(len(lines.word), bool)
    same[1:] = (lines.word[1:] == lines.word[:-1]) & (lines.word_line[1:] == lines.word_line[:-1])
    n_words = np.maximum(lines.line_words, 1)
    count = lambda flags: np.bincount(lines.word_line[flags], minlength=len(lines.start))
    shares = (
        _per_line(lines, upper) / size,
        _per_line(lines, sign) / size,
        _per_line(lines, _IS_SYMBOL[data]) / size,
        _per_line(lines, digit) / size,
        count(lines.repeated_words()) / n_words,
        count(same) / n_words,
    )
    columns = [np.zeros(len(lines.start), np.int64)]
    base = 1
    for share in shares:
        columns.append(base + np.searchsorted(_CUTS, share, "right"))
        base += len(_CUTS) + 1
    columns.append(base + np.searchsorted([1, 3, 8, 20], lines.line_words, "right"))
    columns.append(base + 5 + repeated)
    return np.stack(columns, 1)


def _steps(lines: Lines, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines that are labelled, their number inside their text, and how many each text has."""
    at = np.flatnonzero(chosen)
    counts = np.bincount(lines.text[at], minlength=lines.n)
    first = np.cumsum(counts) - counts
    return at, np.arange(len(at)) - first[lines.text[at]], counts


def _by_step(step: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((text, step))
    return np.split(order, np.cumsum(np.bincount(step))[:-1]) if len(step) else []


def viterbi(scores: np.ndarray, move: np.ndarray, step: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Best labels of all texts' lines; ties go to content."""
    best, back = np.zeros((n, 2)), np.zeros((len(scores), 2), np.int8)
    groups = _by_step(step, text)
    for k, at in enumerate(groups):
        own = text[at]
        if k == 0:
            best[own] = scores[at]
            continue
        paths = best[own][:, :, None] + move[None]
        back[at] = paths.argmax(1)
        best[own] = paths.max(1) + scores[at]
    label = np.zeros(len(scores), np.int8)
    state = np.full(n, -1, np.int8)
    for k in range(len(groups) - 1, -1, -1):
        at = groups[k]
        own = text[at]
        ends = state[own] < 0
        state[own[ends]] = best[own[ends]].argmax(1)
        label[at] = state[own]
        state[own] = back[at, state[own]]
    return label


def gradient(places: np.ndarray, truth: np.ndarray, step: np.ndarray, text: np.ndarray, n: int, weights: np.ndarray, move: np.ndarray):
    """Observed less expected counts of features and moves (forward and backward recursions)."""
    scores = weights[places].sum(1)
    groups = _by_step(step, text)
    forward, backward = np.zeros((len(truth), 2)), np.zeros((len(truth), 2))
    held = np.zeros((n, 2))
    before = np.full(n, -1)
    previous = np.full(len(truth), -1)
    for k, at in enumerate(groups):
        own = text[at]
        previous[at] = before[own]
        into = np.logaddexp.reduce(held[own][:, :, None] + move[None], 1) if k else 0.0
        held[own] = forward[at] = into + scores[at]
        before[own] = at
    total = np.logaddexp.reduce(held, 1)
    held[:] = 0
    seen = np.zeros(n, bool)
    for at in reversed(groups):
        own = text[at]
        backward[at] = np.where(seen[own][:, None], held[own], 0)
        seen[own] = True
        held[own] = np.logaddexp.reduce(move[None] + (backward[at] + scores[at])[:, None, :], 2)
    chance = np.exp(forward + backward - total[text][:, None])
    for_features = np.zeros_like(weights)
    for column in places.T:
        for side in (0, 1):
            for_features[:, side] += np.bincount(column, (truth == side) - chance[:, side], len(weights))
    for_moves = np.zeros((2, 2))
    at = np.flatnonzero(previous >= 0)
    p = previous[at]
    both = forward[p][:, :, None] + move[None] + (scores[at] + backward[at])[:, None, :]
    expected = np.exp(both - total[text[at]][:, None, None]).sum(0)
    np.add.at(for_moves, (truth[p], truth[at]), 1)
    return for_features, for_moves - expected


def _training_part(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    lines = Lines(part)
    repeated = lines.repeated_lines()
    places = line_features(lines, repeated)
    at, step, _ = _steps(lines, lines.line_words > 0)
    good = np.asarray(part.column("label"))[lines.text[at]] == 1
    truth = np.where(good & ~repeated[at], _CONTENT, _BOILERPLATE)
    return places[at], truth, step, lines.text[at]


Model = tuple[np.ndarray, np.ndarray]


def fit(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS, rounds: int = ROUNDS) -> Model:
    """Weights of features and moves from ``labelled(doc_id, text, label)``.

    At most about ``max_rows`` labelled rows are used, chosen by a hash of the id and dealt
    to shards; every shard climbs the likelihood of its own lines (AdaGrad), and the
    shards' weights are averaged. Without rows all weights are nought, so all lines are content.
    """
    known = labelled.where("label IS NOT NULL AND text IS NOT NULL")
    n = known.count()
    if n > max_rows:
        place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20))
        known = known.where(place < (max_rows << 20) // n)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, min(n, max_rows) // 1024)))

    def climb(table: pa.Table) -> pa.Table:
        parts = [
            _training_part(part)
            for batch in table.sort_by("doc_id").combine_chunks().to_batches()
            for part in slices(batch, "text")
        ]
        weights, move = np.zeros((_WIDTH, 2)), np.zeros((2, 2))
        squares = [np.full_like(weights, 1e-6), np.full_like(move, 1e-6)]
        for _ in range(rounds):
            for places, truth, step, text in parts:
                if not len(truth):
                    continue
                found = gradient(places, truth, step, text, int(text.max()) + 1, weights, move)
                for value, change, square in zip((weights, move), found, squares):
                    change = change / len(truth) - 1e-4 * value
                    square += change * change
                    value += 0.5 * change / np.sqrt(square)
        flat = np.concatenate((weights.ravel(), move.ravel()))
        return pa.table({"weights": pa.array([flat.tolist()], pa.list_(pa.float64()))})

    rows = known.select("doc_id", F.col("label").cast("int"), "text", shard.alias("shard"))
    found = [r[0] for r in rows.groupBy("shard").applyInArrow(climb, "weights array<double>").collect()]
    mean = np.mean(np.array(found), 0) if found else np.zeros(2 * _WIDTH + 4)
    return mean[:-4].reshape(_WIDTH, 2), mean[-4:].reshape(2, 2)


ADDED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "content_share double, base_failed boolean, kept boolean"
)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the base counts, the share of characters in content lines and the verdict.

    Null and blank texts have no words and fail. Lines without a word have no label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        weights, move = shared.value
        lines = Lines(part)
        n = lines.n
        repeated = lines.repeated_lines()
        places = line_features(lines, repeated)
        at, step, _ = _steps(lines, lines.line_words > 0)
        label = viterbi(weights[places[at]].sum(1), move, step, lines.text[at], n)
        chars = np.bincount(lines.word_line, lines.word_chars, len(lines.start))[at]
        by_text = lambda owner, value=None: np.bincount(owner, value, n)
        total = by_text(lines.text[at], chars)
        content = by_text(lines.text[at], chars * (label == _CONTENT))
        share = np.divide(content, total, out=np.zeros(n), where=total > 0)
        symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[lines.data])))[lines.offsets]
        n_words = by_text(lines.word_text)
        again = by_text(lines.word_text[lines.repeated_words()])
        failed = (n_words < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n_words)
        return [
            *(
                pa.array(column.astype(np.int64))
                for column in (n_words, total, np.diff(symbols), by_text(lines.text[repeated]), again)
            ),
            pa.array(share),
            pa.array(failed),
            pa.array(~failed & (share >= MIN_CONTENT_SHARE)),
        ]

    return from_text(docs, ADDED, compute)
