"""Byte-pair encoding over a prefix trie, and decoding.

The last token of the encoding of a prefix is the only vocabulary entry that ends the prefix and that its own left
neighbour, the last token of what is left, does not merge into. So a depth-first walk over a trie of distinct words
carries one state per node, the last token, and what words share in front is encoded once; an encoding is read backwards
from the node where the word ends.

Texts are cut at ASCII white space first, which no token crosses. What stands between is kept in a bounded cache per
worker, so the trie sees what is new in a few megabytes of text. A map over the documents: no shuffle.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import slices, texts, warm

CACHE_CHUNKS = 500_000
KNOWN_CHUNKS = 200_000
PAIRS = 100_000
SLICE_BYTES = 4 << 20
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


# The vocabulary's split rule, with letters, numbers and white space spelled out for lower case below U+0100.
_WORDS = (
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]"
    "|[^a-z0-9\t-\r \u0085\u00a0\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00df-\u00f6\u00f8-\u00ff]+"
)
_WORDS_OF_LINES = re.compile(f"\n|{_WORDS}")


# Fixed value: the split rule under which no token crosses ASCII white space and white space leaves no token.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_space(spec: dict) -> bool:
    """Whether texts of a tokenizers file may be cut at ASCII white space: it splits by the rule above and drops the rest,
    and lower-cases letter by letter before.
    """
    split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    lowers = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
    rule = {"type": "Split", "pattern": {"Regex": SPLIT_RULE}, "behavior": "Removed", "invert": True}
    return lowers and split == rule


class Splitter:
    """Cuts texts into words and special tokens as a tokenizers file (given as text) tells."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if not cuts_at_space(spec):
            raise ValueError("the vocabulary must lower-case texts and split them by SPLIT_RULE")
        # Its normaliser and splitter alone are used; an empty model spares a second copy of the vocabulary.
        empty = {"added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.library = Tokenizer.from_str(json.dumps(spec | empty))
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens must match plain text")
        self.special: dict[str, int] = {t["content"]: t["id"] for t in added}
        by_length = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.special_pattern = re.compile(f"({'|'.join(by_length)})") if by_length else None
        self.letters = dict(enumerate(byte_letters()))

    def words_of_lines(self, lines: list[str]) -> list[str]:
        """Words of texts below U+0100 without special tokens or line breaks, and a line break after each text. Letters are
        composed there already, and lower case is letter by letter.
        """
        return _WORDS_OF_LINES.findall("\n".join([*lines, ""]).lower())

    def byte_lettered(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def pieces(self, text: str) -> list[str | int]:
        """Words of any text in byte letters, by the library's normaliser and splitter, and ids of special tokens."""
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        return [w for p in parts for w in ([self.special[p]] if p in self.special else self._words(p))]

    def _words(self, text: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


class Vocabulary(Splitter):
    """A byte-level BPE vocabulary with merges."""

    def __init__(self, text: str):
        super().__init__(text)
        model = json.loads(text)["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE model without prefixes or byte fallback is needed")
        ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[int, int], int] = {}
        # By token: the two tokens that merge into it and the rank of that merge; NEVER for one that no merge makes.
        parts = [array("i", bytes(4 * (max(ids.values()) + 1))) for _ in range(2)]
        self.taken = array("q", [NEVER]) * len(parts[0])
        for rank, pair in enumerate(model["merges"]):
            left, right = (ids[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[left, right] = rank
            token = ids[self._joined(pair)]
            parts[0][token], parts[1][token], self.taken[token] = left, right, rank
        self.lefts, self.rights = parts
        # Every beginning of a token: its id if it is a token itself, else -1.
        self.openings = {t[:n]: -1 for t in ids for n in range(1, len(t))} | ids
        self.apart: dict[int, bool] = {}

    @staticmethod
    def _joined(pair) -> str:
        return pair.replace(" ", "") if isinstance(pair, str) else "".join(pair)

    def _edge(self, token: int, parts: array) -> Iterator[tuple[int, int]]:
        """The pieces at a token's edge while it was built, each with the rank of the merge that took it."""
        taken = NEVER
        while True:
            yield token, taken
            if self.taken[token] == NEVER:
                return
            taken, token = self.taken[token], parts[token]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether encoding the text of both tokens gives these two: no pair of edge pieces merges while both exist."""
        known = self.apart.get(left << 32 | right)
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[left << 32 | right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        ranks, left_edge = self.ranks, list(self._edge(right, self.lefts))
        for a, a_taken in self._edge(left, self.rights):
            for b, b_taken in left_edge:
                rank = ranks.get((a, b))
                if rank is not None and rank < a_taken and rank <= b_taken:
                    return False
        return True

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct non-empty words given in byte letters, packed as little-endian unsigned 32-bit integers.

        Sorted words are a depth-first walk over their trie, of which only the current path is held: by depth, where its
        last token starts and which that is, and from where on something starts that a token may begin with.
        """
        openings, apart, end = self.openings.get, self.stay_apart, self.end
        found: dict[str, bytes] = {}
        alive: list[list[int]] = [[0]]
        last, start = [0], [0]
        before = ""
        for word in sorted(words):
            size, shared = len(word), 0
            for a, b in zip(word[:-1], before[:-1]):  # a word's last letter is a leaf of its own: it closes the word
                if a != b:
                    break
                shared += 1
            before = word
            while len(last) <= size:
                alive.append([])
                last.append(0)
                start.append(0)
            for depth in range(shared + 1, size + 1):
                still, chosen, suffix = [], False, end if depth == size else ""
                for at in alive[depth - 1]:
                    token = openings(word[at:depth] + suffix)
                    if token is not None:
                        still.append(at)
                        if token >= 0 and not chosen and (not at or apart(last[at], token)):
                            last[depth], start[depth], chosen = token, at, True
                if not chosen:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                still.append(depth)
                alive[depth] = still
            tokens, depth = [], size
            while depth:
                tokens.append(last[depth])
                depth = start[depth]
            tokens.reverse()
            found[word] = pack(f"<{len(tokens)}I", *tokens)
        return found

    def word_ids(self, words: list[str]) -> pa.ListArray:
        """encode_words, in the words' order."""
        return packed_lists(map(self.encode_words(words).get, words))


class ChunkEncoder:
    """Encodes texts chunk by chunk; a chunk stands between ASCII white space. `encode_words` gives the ids of distinct words
    in byte letters.

    Known chunks and their ids are two Arrow arrays, so Python sees new chunks alone. When they would hold more than `limit`
    chunks, what the current batch doesn't use is dropped: memory is bounded whatever the corpus.
    """

    def __init__(self, splitter: Splitter, encode_words: Callable[[list[str]], pa.ListArray], limit: int = CACHE_CHUNKS):
        self.splitter, self.encode_words, self.limit = splitter, encode_words, limit
        self.chunks, self.ids = pa.array([], pa.string()), id_lists([])

    def encode(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text of a column as array<int>; null is empty."""
        chunks = pc.ascii_split_whitespace(self._lowered(pc.fill_null(column.cast(pa.string()), "")))
        distinct = chunks.flatten().dictionary_encode()
        ids = self._known(distinct.dictionary)
        return _grouped(ids.take(distinct.indices), chunks.offsets.to_numpy())

    def _lowered(self, column: pa.Array) -> pa.Array:
        # Upper case would cost a second entry; but special tokens are matched before texts are lower-cased.
        lower = small = pc.ascii_lower(column)
        for mark in self.splitter.special:
            lower = pc.if_else(pc.match_substring(small, mark.lower()), column, lower)
        return lower

    def _known(self, distinct: pa.Array) -> pa.ListArray:
        at = pc.index_in(distinct, value_set=self.chunks)
        if not at.null_count:
            return self.ids.take(at)
        unknown = at.is_null()
        new, places = distinct.filter(unknown), pc.fill_null(at, 0).to_numpy().astype(np.int64)
        unknown = unknown.to_numpy(zero_copy_only=False)
        if len(self.chunks) + len(new) > self.limit:
            used = at.drop_null()
            self.chunks, self.ids = self.chunks.take(used), self.ids.take(used)
            places[~unknown] = np.arange(len(used))
        places[unknown] = len(self.chunks) + np.arange(len(new))
        self.chunks, self.ids = pa.concat_arrays([self.chunks, new]), pa.concat_arrays([self.ids, self._learnt(new)])
        return self.ids.take(pa.array(places))

    def _learnt(self, chunks: pa.Array) -> pa.ListArray:
        by_rule = pc.match_substring_regex(chunks, r"^[\x{00}-\x{ff}]*$")
        for mark in self.splitter.special:
            by_rule = pc.and_(by_rule, pc.invert(pc.match_substring(chunks, mark)))
        words = pa.array(self.splitter.words_of_lines(chunks.filter(by_rule).to_pylist()), pa.string()).dictionary_encode()
        names, places = words.dictionary.to_pylist(), words.indices.to_numpy()
        breaks = names.index("\n") if "\n" in names else -1
        ends = np.flatnonzero(places == breaks) - np.arange(np.count_nonzero(places == breaks))
        ids = self._ids_of(names, breaks).take(pa.array(places[places != breaks]))
        found = _grouped(ids, np.concatenate([[0], ends]))
        if len(found) < len(chunks):
            rest = [self.splitter.pieces(c) for c in chunks.filter(pc.invert(by_rule)).to_pylist()]
            named = sorted({w for pieces in rest for w in pieces if type(w) is str})
            known = dict(zip(named, self.encode_words(named).to_pylist()))
            others = id_lists([[i for w in pieces for i in (known[w] if type(w) is str else [w])] for pieces in rest])
            order = np.argsort(np.argsort(pc.invert(by_rule).to_numpy(zero_copy_only=False), kind="stable"))
            found = pa.concat_arrays([found, others]).take(pa.array(order))
        return found

    def _ids_of(self, names: list[str], breaks: int) -> pa.ListArray:
        """The ids of words by place; what stands at `breaks` is no word."""
        words = [self.splitter.byte_lettered(w) for i, w in enumerate(names) if i != breaks]
        ids = self.encode_words(words)
        places = np.arange(len(names)) - (np.arange(len(names)) > breaks if breaks >= 0 else 0)
        return ids.take(pa.array(np.minimum(places, len(ids) - 1))) if len(ids) else ids


@warm
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


@warm
def _encoder(text: str) -> ChunkEncoder:
    """One per Python worker and vocabulary: later tasks of the worker find the cache filled."""
    return ChunkEncoder(vocabulary(text), vocabulary(text).word_ids, KNOWN_CHUNKS)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))


def _grouped(lists: pa.ListArray, offsets: np.ndarray) -> pa.ListArray:
    """Runs of lists, which start and end at the offsets, each as one list."""
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(lists.value_lengths().to_numpy(), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), lists.flatten())


def packed_lists(packed: Iterable[bytes]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    packed = list(packed)
    return _lists(np.cumsum([0, *[len(p) // 4 for p in packed]]), np.frombuffer(b"".join(packed), "<i4"))


def id_lists(encoded: list[list[int]]) -> pa.ListArray:
    return pa.array(encoded, pa.list_(pa.int32()))


def ended(lists: pa.ListArray, end_id: int) -> pa.ListArray:
    """Every list with one more id at its end."""
    offsets = lists.offsets.to_numpy()
    return _lists(offsets + np.arange(len(offsets)), np.insert(lists.values.to_numpy(), offsets[1:], end_id))


def sizes_of(lists: pa.ListArray) -> pa.Array:
    return pa.array(np.diff(lists.offsets.to_numpy()), pa.int64())


def id_bytes(lists: pa.ListArray) -> Iterator[bytes]:
    """Each row's ids as little-endian 32-bit integers; a null list is empty."""
    values, offsets = lists.values.to_numpy().astype("<i4", copy=False), lists.offsets.to_numpy().tolist()
    valid = lists.is_valid().to_pylist() if lists.null_count else None
    for i, (start, end) in enumerate(zip(offsets, offsets[1:])):
        yield values[start:end].tobytes() if valid is None or valid[i] else b""


def add_columns(df: DataFrame, kinds: dict[str, str], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df and the columns that `make(batch)` gives as Arrow arrays; columns of those names are replaced. One Python worker."""
    df = df.drop(*kinds)
    schema = df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=[*batch.schema.names, *kinds])

    return df.mapInArrow(run, schema)


def read_vocabulary(path: str) -> str:
    """The file's text, read where the job is planned and sent along with the tasks (under 2 MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@warm
def _tokens(text: str) -> pa.Array:
    """Tokens by id; null where there is none."""
    spec = json.loads(text)
    named = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([named.get(i) for i in range(max(named) + 1)], pa.string())


def decode(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The text of each list: the tokens, special ones included, a blank between two; unknown ids are left out. A null list
    gives an empty text.
    """
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    offsets, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
    ids, offsets = ids[offsets[0] : offsets[-1]], offsets - offsets[0]
    known = (ids >= 0) & (ids < len(tokens))
    words = tokens.take(pa.array(np.where(known, ids, 0), mask=~known))
    if words.null_count:
        there = words.is_valid().to_numpy(zero_copy_only=False)
        offsets, words = np.concatenate([[0], np.cumsum(there)])[offsets], words.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), " ")


def with_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs and the ids of each whole text as array<int>, equal to the tokenizers library's without special tokens added;
    where `decoded` names a column, also what the ids decode to, made in the same pass.

    Null and empty texts and texts of white space have no ids. Special tokens' strings in a text become their ids, as in
    the library. Rows, repeats included, and other columns are kept; columns of the added names are replaced.
    """
    kinds = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    shared, at = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path)), docs.drop(*kinds).columns.index(text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        encoded = _encoder(shared.value).encode(batch.column(at))
        return [encoded, decode(encoded, _tokens(shared.value))] if decoded else [encoded]

    return add_columns(docs, kinds, make)


def with_decoded(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows and the text of each id list. A null list gives an empty text."""
    shared, at = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path)), rows.drop(decoded).columns.index(ids)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [decode(batch.column(at).cast(pa.list_(pa.int32())), _tokens(shared.value))]

    return add_columns(rows, {decoded: "string"}, make)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and the SHA-256 (lower-case hex) of each text's ids, as little-endian unsigned 32-bit integers,
    and of what these ids decode to: with_ids(), decode and digests in one pass.
    """
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    shared, at = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path)), docs.drop(*kinds).columns.index(text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        encoded = _encoder(shared.value).encode(batch.column(at))
        digests = lambda values: pa.array([sha256(v).hexdigest() for v in values], pa.string())
        return [sizes_of(encoded), digests(id_bytes(encoded)), digests(texts(decode(encoded, _tokens(shared.value))))]

    return add_columns(docs, kinds, make)
