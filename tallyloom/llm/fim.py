"""Fill-in-middle: a text's parts in another order, so that a model learns to write the middle from both sides.

Two random cuts, at line ends or between code points, part a text into prefix, middle and suffix. Marked parts are written
prefix, suffix, middle (psm) or suffix, prefix, middle (spm); some texts stay plain.

Texts are cut as UTF-8 bytes, lengths are told in code points. What lies between is a sparse index of exceptions: the
positions of characters of more than one byte and the bytes they have beyond the first. A search in it converts a
position in one measure to the other, with arithmetic alone for everything ASCII; plain ASCII texts have an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, texts

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = "7", 100, 50
COLUMNS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


class Exceptions:
    """Characters of more than one byte in a UTF-8 text: where they start, and the bytes beyond the first up to each."""

    def __init__(self, text: bytes):
        if text.isascii():
            self.at_byte = self.at_char = np.empty(0, np.int64)
            self.excess = np.zeros(1, np.int64)
        else:
            data = np.frombuffer(text, np.uint8)
            self.at_byte = np.flatnonzero(data >= 0xC0)
            lead = data[self.at_byte]
            self.excess = np.zeros(len(lead) + 1, np.int64)
            np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), out=self.excess[1:])
            self.at_char = self.at_byte - self.excess[:-1]

    def byte(self, char: int) -> int:
        """The byte at which the code point of that number starts; also for the number past the last."""
        return char + int(self.excess[np.searchsorted(self.at_char, char)])

    def char(self, byte: int) -> int:
        """The number of code points before a byte at which one starts."""
        return byte - int(self.excess[np.searchsorted(self.at_byte, byte)])


@dataclass(frozen=True)
class Plan:
    """unit: where cuts may lie, "line" (after a line break) or "char". Of 100 texts `rate` are transformed, and of these
    `spm` start with the suffix. Marks must not overlap one another, so that outputs can be taken apart again.
    """

    unit: str = "line"
    seed: str = SEED
    rate: int = RATE
    spm: int = SPM
    marks: tuple[str, str, str] = MARKS

    def __post_init__(self):
        if self.unit not in ("line", "char"):
            raise ValueError(f"unknown unit {self.unit!r}")
        together = "".join(self.marks)
        if not all(self.marks) or len(set(self.marks)) < 3 or any(together.count(m[0]) != sum(x[0] == m[0] for x in self.marks) for m in self.marks):
            raise ValueError("marks must be three different texts whose first characters occur at their start alone")

    def make(self, doc_id: int | None, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        """Units, form, code points of prefix and middle, and the output of one text."""
        digest = sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        a, b, keep, order = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
        index = Exceptions(text)
        if self.unit == "line":
            ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
            n = len(ends) + bool(text and text[-1] != 10)
            start, end = (self._line_byte(ends, k, len(text)) for k in sorted((a % (n + 1), b % (n + 1))))
        else:
            n = index.char(len(text))
            start, end = (index.byte(k) for k in sorted((a % (n + 1), b % (n + 1))))
        p, s, m = (mark.encode() for mark in self.marks)
        if not text or p in text or s in text or m in text or keep % 100 >= self.rate:
            return n, "plain", None, None, text
        before = index.char(start)
        sizes = before, index.char(end) - before
        if order % 100 < self.spm:
            return n, "spm", *sizes, b"".join((s, text[end:], p, text[:start], m, text[start:end]))
        return n, "psm", *sizes, b"".join((p, text[:start], s, text[end:], m, text[start:end]))

    @staticmethod
    def _line_byte(ends: np.ndarray, line: int, size: int) -> int:
        """The byte at which the line of that number starts."""
        return 0 if not line else int(ends[line - 1]) if line <= len(ends) else size


def transform(docs: DataFrame, plan: Plan = Plan(), text: str = "text") -> DataFrame:
    """docs and COLUMNS: units, form, code points of prefix and middle (null if plain) and the whole output text.

    Cuts follow from seed and doc_id alone, so reruns and retries agree. A null text is empty; empty texts, and those that
    hold a mark, are plain. Rows with a null doc_id are cut like one with an empty id. Rows, repeats included, and other
    columns are kept; columns of the added names are replaced. Empty in, empty out. A map: no shuffle.
    """
    docs = docs.drop(*[c for c in COLUMNS if c != text])
    if text in COLUMNS:
        raise ValueError(f"the text column must not be called {text!r}")
    schema = docs.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in COLUMNS.items()]).schema
    at, named = docs.columns.index(text), docs.columns.index("doc_id")
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = zip(*map(plan.make, batch.column(named).to_pylist(), texts(batch.column(at))))
            arrays = [pa.array(values, kinds[kind]) for values, kind in zip(made, COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *COLUMNS])

    return docs.mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of that form was made of. Native."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
