"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

A line with words is described by a few yes/no features (length, ending, symbols, capitals, repeats); neighbours are tied
by transition weights, so a lone odd line in prose stays content and a short plain line in a menu doesn't become it.
Viterbi decoding labels all lines of a document together; the share of words in content lines decides whether it stays.
Fixed base rules (too short, too repetitive) reject before that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, texts
from tallyloom.llm.samples import choose, features_of, minimise

PER_CLASS = 1000  # at most so many labelled documents of each quality are fitted on
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5
SEED, SEQUENCE, FEATURES = 37, 64, 16
RUN = 6  # lines of one label in a row, at most, in the sequences that are fitted on
BOILERPLATE, CONTENT = 0, 1

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
SPACES = b" \t\n\r\x0b\x0c"


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def line_features(line: bytes, words: list[bytes], seen: bool) -> int:
    """Features of a line with words, as bits; bit 0 is always set."""
    n, size = len(words), len(line)
    symbols, upper = _count(line, SYMBOLS), _count(line, UPPER)
    letters = upper + _count(line, LOWER)
    repeats = sum(map(eq, words, islice(words, 1, None)))
    bits = (
        True, n <= 2, 3 <= n <= 5, 6 <= n <= 15, n > 15,
        words[-1][-1:] in b".!?", 50 * symbols > size, 12 * symbols > size,
        letters >= 4 and 5 * upper > 3 * letters, 5 * repeats > n, seen,
        5 * _count(line, DIGITS) > size, 3 * line.count(b"!!") > n,
        n >= 6 and 2 * len(set(words)) < n, size > 16 * n, words[0][:1].islower(),
    )
    return sum(1 << i for i, bit in enumerate(bits) if bit)


def lines_of(text: bytes) -> tuple[list[int], list[int], int]:
    """Features and numbers of words of the lines with words, and how many of these repeat an earlier line."""
    found, sizes, seen, repeats = [], [], set(), 0
    for line in text.split(b"\n"):
        if words := line.split():
            again = line in seen
            repeats += again
            seen.add(line)
            found.append(line_features(line, words, again))
            sizes.append(len(words))
    return found, sizes, repeats


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None)))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    marked = np.zeros(len(words), bool)
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    for shift in range(3):
        marked[shift : shift + len(windows)] |= again
    return int(marked.sum())


@dataclass
class Model:
    emission: np.ndarray  # by feature and label
    transition: np.ndarray  # from label to label

    def __post_init__(self):
        self._scores: dict[int, tuple[float, float]] = {}

    def line_scores(self, bits: int) -> tuple[float, float]:
        if bits not in self._scores:
            used = [i for i in range(FEATURES) if bits >> i & 1]
            self._scores[bits] = tuple(self.emission[used].sum(0).tolist())
        return self._scores[bits]

    def viterbi(self, lines: list[int]) -> list[int]:
        """The likeliest labels of all lines together; ties go to content."""
        if not lines:
            return []
        (bb, bc), (cb, cc) = self.transition.tolist()
        b, c = self.line_scores(lines[0])
        back = []
        for bits in lines[1:]:
            eb, ec = self.line_scores(bits)
            to_b, to_c = (BOILERPLATE if b + bb > c + cb else CONTENT), (BOILERPLATE if b + bc > c + cc else CONTENT)
            b, c = max(b + bb, c + cb) + eb, max(b + bc, c + cc) + ec
            back.append((to_b, to_c))
        label = BOILERPLATE if b > c else CONTENT
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def _objective(sequences: list[np.ndarray], labels: list[np.ndarray], penalty: float):
    """The gradient of the mean negative log-likelihood a line and the penalty, and the value, as functions of the weights;
    null if fewer than two labels occur. Long sequences are fitted in parts of SEQUENCE lines.
    """
    parts = [
        (s[i : i + SEQUENCE], y[i : i + SEQUENCE]) for s, y in zip(sequences, labels) for i in range(0, len(s), SEQUENCE)
    ]
    if len({int(v) for _, y in parts for v in y}) < 2:
        return None
    n, length = len(parts), max(len(s) for s, _ in parts)
    bits, y, real = np.zeros((n, length), np.int64), np.zeros((n, length), int), np.zeros((n, length), bool)
    for row, (s, labelled) in enumerate(parts):
        bits[row, : len(s)], y[row, : len(s)], real[row, : len(s)] = s, labelled, True
    x = ((bits[:, :, None] >> np.arange(FEATURES)) & 1).astype(float) * real[:, :, None]
    truth = np.eye(2)[y] * real[:, :, None]
    both = real[:, 1:]
    moves = np.einsum("nti,ntj->ij", truth[:, :-1] * both[:, :, None], truth[:, 1:])
    total = real.sum()

    def evaluate(p: np.ndarray) -> tuple[np.ndarray, float]:
        w, t = p[: 2 * FEATURES].reshape(FEATURES, 2), p[2 * FEATURES :].reshape(2, 2)
        e = x @ w
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = e[:, 0]
        for k in range(1, length):
            step = np.logaddexp.reduce(forward[:, k - 1, :, None] + t, axis=1) + e[:, k]
            forward[:, k] = np.where(real[:, k, None], step, forward[:, k - 1])
        for k in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(t + (e[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(real[:, k + 1, None], step, 0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        marginal = np.exp(forward + backward - z[:, None, None]) * real[:, :, None]
        pair = forward[:, :-1, :, None] + t + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = (np.exp(pair) * both[:, :, None, None]).sum((0, 1))
        by_w = np.einsum("ntf,ntj->fj", x, marginal - truth)
        loss = (z.sum() - (e * truth).sum() - (t * moves).sum()) / total + penalty * (p * p).sum() / 2
        return np.concatenate([by_w.ravel(), (expected - moves).ravel()]) / total + penalty * p, loss

    return evaluate


def fit_sequences(sequences: list[np.ndarray], labels: list[np.ndarray], penalty: float = 1e-3, steps: int = 120) -> Model:
    """Maximum likelihood on line features (bits) and labels; all zero where only one label occurs."""
    evaluate = _objective(sequences, labels, penalty)
    if evaluate is None:
        return Model(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    p = minimise(lambda w: evaluate(w)[0], np.zeros(2 * FEATURES + 4), steps, 0.1)
    return Model(p[: 2 * FEATURES].reshape(FEATURES, 2), p[2 * FEATURES :].reshape(2, 2))


def spliced(good: list[np.ndarray], poor: list[np.ndarray], seed: int = SEED, run: int = RUN) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences and labels: runs of 1 to `run` lines taken in turn from a good and a poor document, until both are used up.

    Labels are known by document, so documents alone would teach that a label never changes; spliced ones show changes.
    The shorter list of documents is used again from its start.
    """
    draw, sequences, labels = np.random.default_rng(seed), [], []
    for i in range(max(len(good), len(poor)) if len(good) and len(poor) else 0):
        rest = {CONTENT: good[i % len(good)], BOILERPLATE: poor[i % len(poor)]}
        parts, marks, turn = [], [], int(draw.integers(2))
        while any(map(len, rest.values())):
            n = int(draw.integers(1, run + 1))
            part, rest[turn] = rest[turn][:n], rest[turn][n:]
            parts.append(part)
            marks.append(np.full(len(part), turn))
            turn = 1 - turn
        sequences.append(np.concatenate(parts))
        labels.append(np.concatenate(marks))
    return sequences, labels


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Model:
    """Fit from documents labelled by quality (doc_id, quality): lines of good ones count as content, of poor ones as
    boilerplate, and both are spliced into one another. At most `per_class` documents of each kind, chosen by hash of the id
    among all labels.
    """
    rated = labels.where("quality is not null").select("doc_id", (F.col("quality") > 0).cast("int").alias("class"))
    chosen = choose(rated, per_class, range(2), seed)
    found, _, y = features_of(docs, chosen, lambda text: (np.array(f := lines_of(text)[0], np.int64), np.zeros(len(f))))
    of = lambda label: [f for f, c in zip(found, y) if c == label and len(f)]
    return fit_sequences(*spliced(of(CONTENT), of(BOILERPLATE)))


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "content_share": "double", "kept": "boolean",
}


def measure(text: bytes, model: Model, min_content: float = MIN_CONTENT) -> tuple:
    """The values of COLUMNS for one text."""
    words = text.split()
    n, repeated = len(words), repeat_words(words)
    lines, sizes, repeats = lines_of(text)
    content = sum(size for size, label in zip(sizes, model.viterbi(lines)) if label == CONTENT)
    share = content / n if n else 0.0
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    chars = len(text.translate(None, SPACES).decode())
    return n, chars, _count(text, SYMBOLS), repeats, repeated, failed, share, not failed and share >= min_content


def label_documents(docs: DataFrame, model: Model, min_content: float = MIN_CONTENT) -> DataFrame:
    """docs with COLUMNS, from whole texts. Null and empty texts have no words: base_failed, not kept. Rows, repeats
    included, and other columns stay; columns of these names are replaced. A map: no shuffle.
    """
    docs = docs.drop(*COLUMNS)
    schema = docs.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in COLUMNS.items()]).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = zip(*[measure(t, model, min_content) for t in texts(batch.column(at))])
            kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[k] for k in COLUMNS.values()]
            arrays = [pa.array(values, kind) for values, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *COLUMNS])

    return docs.mapInArrow(run, schema)
