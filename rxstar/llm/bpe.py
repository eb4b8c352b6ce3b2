"""Byte-level BPE encoding and decoding.

The merge ranks are compiled into a finite-state transducer that is determinised lazily.

- Two tokens may stand side by side if merging their joined bytes gives just the two.
  ``Merges.fit`` decides this by replaying the merges along the seam; a token sequence is the
  encoding of its bytes if all neighbours fit, and for every prefix of the input exactly one
  token ends it.
- A state of the deterministic machine is the set of readings still possible: the nodes of the
  token trie for the bytes of the tokens begun.  A move tells the next state and the tokens that
  may end at the byte; just one of them fits the token that ends where it begins.  All readings
  begin within the longest token, so what they have in common before is certain: it is emitted
  at the end of a piece, or after ``LOOKAHEAD`` bytes in a long one.
- States and moves are made when first needed and kept up to a bound, then forgotten and made
  anew.  A bounded memo of whole pieces stands before the machine.  Short pieces that are not in
  it go through the machine side by side, each different one of some texts once.

Decoding is a stream: ids come in any portions, and a UTF-8 state machine holds back only the
bytes of an unfinished character.

Null text counts as empty: no ids.  Special tokens are ordinary text.  Bytes that are not UTF-8
read as U+FFFD.  Null ids are left out.  An empty table gives an empty result; repeated
rows and extra columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fixed_rows, read, ship, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_STATES = 32_000
MAX_PIECES = 300_000
MAX_FITS = 250_000
#: Slots of the pairs of tokens that many pieces look up at once, as a power of two.
PAIR_BITS = 19
LOOKAHEAD = 4096
#: Bytes of a piece that is kept and goes through the machine beside others.
SHORT = 64
#: Characters whose pieces are encoded together.
PORTION = 1 << 20
_NEVER = 1 << 62
_SPREAD = np.int64(0x1E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Merge ranks, with the merge tree of each token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._seams: tuple[dict, dict] = ({}, {})
        self._fits: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes, below: int = _NEVER) -> list[bytes]:
        """Plain merging: again and again the first of the pairs with the lowest rank under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or an unmade token."""
        if token not in self._halves:
            parts = self.merged(self.bytes[token], token)
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def made(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.bytes[token]) == 1 or self.halves(token) is not None

    def seam(self, token: int, left: bool) -> list[int]:
        """What lies at the token's left or right end while its merges go on, first byte first."""
        known = self._seams[left]
        if token not in known:
            line, at = [token], token
            while (halves := self.halves(at)) is not None:
                at = halves[0 if left else 1]
                line.append(at)
            known[token] = line[::-1]
        return known[token]

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together gives just these two tokens."""
        known = self._fits.get((a, b))
        if known is not None:
            return known
        if len(self._fits) >= MAX_FITS:
            self._fits.clear()
        ends, begins = self.seam(a, False), self.seam(b, True)
        i = j = 0
        while True:
            next_a = ends[i + 1] if i + 1 < len(ends) else _NEVER
            next_b = begins[j + 1] if j + 1 < len(begins) else _NEVER
            across = self.ranks.get(self.bytes[ends[i]] + self.bytes[begins[j]], _NEVER)
            if across < next_a and across <= next_b and across != _NEVER:  # of equal ranks the left one goes first
                answer = False
                break
            if next_a == next_b == _NEVER:
                answer = True
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        self._fits[a, b] = answer
        return answer


class Transducer:
    """Bytes to tokens, for pieces of text that stand by themselves."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES) -> None:
        self.merges, self.max_states = merges, max_states
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token, self.inner, self.depth = [-1], [False], [0]
        for data, rank in merges.ranks.items():
            at = 0
            for byte in data:
                self.inner[at] = True
                nxt = self.child.get(at << 8 | byte)
                if nxt is None:
                    nxt = self.child[at << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[at] + 1)
                at = nxt
            self.token[at] = rank
        self.width = np.zeros(max(merges.ranks.values(), default=-1) + 1, np.int32)
        for data, rank in merges.ranks.items():
            self.width[rank] = len(data)
        # pairs of tokens and whether they fit, each in the one slot that its hash gives
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        self.fitting = np.zeros(1 << PAIR_BITS, bool)
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple, int] = {(0,): 0}
        self.states: list[tuple] = [(0,)]
        self.endings: list[list[tuple[int, int]]] = [[]]
        self.moves: dict[int, int] = {}
        # the same for many pieces at once: state << 8 | byte -> state, and the endings of all states in one row
        self.next = np.full(1 << 16, -1, np.int32)
        self.ending, self.first = array("i"), array("i", [0, 0])

    def move(self, state: int, byte: int) -> int:
        """Make the move of a state on a byte: the next state, with the tokens that may end there, the longest first."""
        nodes = [self.child.get(node << 8 | byte) for node in self.states[state] if self.inner[node]]
        new = (*(node for node in nodes if node is not None), 0)
        to = self.number.get(new)
        if to is None:
            tokens = [t for node in new if (t := self.token[node]) >= 0 and self.merges.made(t)]
            if not tokens:
                raise ValueError(f"no token for byte {byte}")
            to = self.number[new] = len(self.states)
            self.states.append(new)
            self.endings.append([(t, int(self.width[t])) for t in tokens])
            self.ending.extend(tokens)
            self.first.append(len(self.ending))
            if (to + 1) << 8 > len(self.next):
                self.next = np.concatenate((self.next, np.full(len(self.next), -1, np.int32)))
        self.moves[state << 8 | byte] = self.next[state << 8 | byte] = to
        return to

    def chain(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, from the token that ends at each byte."""
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= len(self.merges.bytes[ends[at - 1]])
        return out[::-1]

    def run(self, data: bytes) -> list[int]:
        """The tokens of one piece of any length."""
        if len(self.states) > self.max_states:
            self.forget()
        out: list[int] = []
        ends: list[int] = []
        moves, fit, state = self.moves, self.merges.fit, 0
        for byte in data:
            to = moves.get(state << 8 | byte)
            state = self.move(state, byte) if to is None else to
            for token, width in self.endings[state]:
                at = len(ends) + 1 - width
                last = ends[at - 1] if at else out[-1] if out else -1
                if last < 0 or fit(last, token):
                    break
            ends.append(token)
            if len(ends) == LOOKAHEAD:
                # what all open readings have in common is certain and leaves the machine
                open_at = [len(ends) - self.depth[node] for node in self.states[state] if self.inner[node]]
                chains = [self.chain(ends, at) for at in open_at]
                same = 0
                while all(len(c) > same for c in chains) and len({c[same] for c in chains}) == 1:
                    same += 1
                out += chains[0][:same]
                del ends[: sum(len(self.merges.bytes[t]) for t in chains[0][:same])]
        return out + self.chain(ends, len(ends))

    def fits(self, lasts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``Merges.fit`` for many pairs."""
        pairs = lasts.astype(np.int64) << 32 | tokens
        slots = ((pairs * _SPREAD).view(np.uint64) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        answers = self.fitting[slots]
        missed = np.flatnonzero(self.pairs[slots] != pairs)
        if len(missed):
            new, where, back = np.unique(pairs[missed], return_index=True, return_inverse=True)
            found = np.array([self.merges.fit(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()], bool)
            answers[missed] = found[back]
            # of pairs with one slot the last one written stays, in both arrays
            slots, last = np.unique(slots[missed][where][::-1], return_index=True)
            self.pairs[slots], self.fitting[slots] = new[::-1][last], found[::-1][last]
        return answers

    def run_all(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of many short pieces as packed int32: all go through the machine side by side, byte by byte."""
        if len(self.states) > self.max_states:
            self.forget()
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces], np.int32)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        longest, count = int(sizes[0]), len(pieces)
        joined = b"".join([pieces[i].ljust(longest, b"\0") for i in order.tolist()])
        data = np.frombuffer(joined, np.uint8).reshape(count, longest).T.astype(np.int32)
        going = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # pieces of at least that many bytes
        ends = np.full((longest + 1, count), -1, np.int32)
        state = np.zeros(count, np.int32)
        for i, (row, n) in enumerate(zip(data, going.tolist()), 1):
            step = state[:n] << 8 | row[:n]
            to = self.next[step]
            if (to < 0).any():
                for key in np.unique(step[to < 0]).tolist():
                    self.move(key >> 8, key & 0xFF)
                to = self.next[step]
            state = to
            first, ending = np.array(self.first, np.int32), np.array(self.ending, np.int32)
            at, stop = first[to], first[to + 1] - 1
            tokens = ending[at]
            # just one token of a byte fits, so the last one needs no look; nor does one that begins the piece
            doubtful = np.flatnonzero((at < stop) & (self.width[tokens] < i))
            while len(doubtful):
                token = tokens[doubtful]
                doubtful = doubtful[~self.fits(ends[i - self.width[token], doubtful], token)]
                at[doubtful] += 1
                tokens[doubtful] = ending[at[doubtful]]
                doubtful = doubtful[at[doubtful] < stop[doubtful]]
            ends[i, :n] = tokens
        return self._packed(ends, sizes, order)

    def _packed(self, ends: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> list[bytes]:
        """The chains of all pieces, from their ends back to their beginnings, in the order they were given."""
        at, numbers, rows = sizes.copy(), np.zeros(len(sizes), np.int32), []
        left = np.flatnonzero(at)
        while len(left):
            token = ends[at[left], left]
            row = np.zeros(len(sizes), np.int32)
            row[left] = token
            rows.append(row)
            numbers[left] += 1
            at[left] -= self.width[token]
            left = left[at[left] > 0]
        packed, size = np.stack(rows[::-1], axis=1).tobytes(), 4 * len(rows)
        out = [b""] * len(sizes)
        for n, (i, number) in enumerate(zip(order.tolist(), numbers.tolist()), 1):
            out[i] = packed[n * size - 4 * number : n * size]
        return out


class Encoder:
    """Text to ids: the pattern cuts pieces, and each goes through the transducer by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks
        self.machine = Transducer(Merges(ranks))
        # \s as the tokenizer's engine reads it: Unicode White_Space
        space = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(space)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def known(self, piece: str) -> bytes | None:
        """A piece of the memo; one that has not been met for long is forgotten."""
        packed = self.memo.get(piece)
        if packed is None:
            packed = self.older.get(piece)
            if packed is not None:
                self.keep(piece, packed)
        return packed

    def keep(self, piece: str, packed: bytes) -> None:
        if len(self.memo) >= MAX_PIECES // 2:
            self.memo, self.older = {}, self.memo
        self.memo[piece] = packed

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of some texts that are cut into pieces; each different piece is taken once."""
        packed = dict.fromkeys(chain.from_iterable(texts))
        short: dict[str, bytes] = {}
        for piece in packed:
            ids = self.known(piece)
            if ids is None:
                data = piece.encode("utf-8", "replace")
                whole = self.ranks.get(data)
                if whole is None and len(data) <= SHORT:
                    short[piece] = data
                    continue
                ids = array("i", [whole] if whole is not None else self.machine.run(data)).tobytes()
                if len(data) <= SHORT:
                    self.keep(piece, ids)
            packed[piece] = ids
        for piece, ids in zip(short, self.machine.run_all([*short.values()])):
            packed[piece] = ids
            self.keep(piece, ids)
        return [np.frombuffer(b"".join([packed[p] for p in pieces]), np.int32) for pieces in texts]

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text; up to ``PORTION`` characters of text are held in pieces at a time."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if held and size + len(text) > PORTION:
                yield from self.ids(held)
                held, size = [], 0
            if len(text) <= PORTION:
                held.append(self.pieces.findall(text))
                size += len(text)
            else:
                found = (m.group() for m in self.pieces.finditer(text))
                parts = [self.ids([part])[0] for part in iter(lambda: list(islice(found, 1 << 16)), [])]
                yield np.concatenate([np.empty(0, np.int32), *parts])
        yield from self.ids(held)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


#: UTF-8: the number of bytes that follow a first byte, and the range of the first that follows.
def _after(first: int) -> tuple[int, int, int]:
    if first < 0x80:
        return 0, 0, 0
    if 0xC2 <= first <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= first <= 0xEF:
        return 2, 0xA0 if first == 0xE0 else 0x80, 0x9F if first == 0xED else 0xBF
    if 0xF0 <= first <= 0xF4:
        return 3, 0x90 if first == 0xF0 else 0x80, 0x8F if first == 0xF4 else 0xBF
    return -1, 0, 0


class Utf8Stream:
    """Bytes in any portions to text: only an unfinished character is held back."""

    def __init__(self) -> None:
        self.held = b""

    def unfinished(self, data: bytes) -> int:
        """How many of the last bytes begin a character that may still be finished."""
        for back in range(1, min(3, len(data)) + 1):
            first = data[-back]
            if 0x80 <= first <= 0xBF:
                continue
            follow, low, high = _after(first)
            if follow < back:
                return 0
            return back if back == 1 or low <= data[1 - back] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids to bytes, or as a stream to text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for data, rank in ranks.items():
            self.bytes[rank] = data

    def portions(self, ids: np.ndarray, size: int = 4096) -> Iterator[bytes]:
        for at in range(0, len(ids), size):
            yield b"".join([self.bytes[i] for i in ids[at : at + size].tolist()])

    def text(self, portions: Iterable[bytes]) -> Iterator[str]:
        stream = Utf8Stream()
        for data in portions:
            yield stream.feed(data)
        yield stream.finish()


_KEPT: dict[tuple, object] = {}


def _tool(kind: type, ranks: dict[bytes, int], name: str):
    """An encoder or decoder that lasts as long as the Python worker."""
    key = kind, name
    if key not in _KEPT:
        _KEPT[key] = kind(ranks)
    return _KEPT[key]


def _name(ranks: dict[bytes, int]) -> str:
    h = hashlib.sha256()
    for token, rank in ranks.items():
        h.update(b"%d:%d:%b" % (rank, len(token), token))
    return h.hexdigest()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32))


def _encode(shared, name: str, at: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tool(Encoder, shared.value, name)
        for batch in fixed_rows(batches, 256):
            ids = _lists([*encoder.encode_all(t.decode("utf-8", "replace") for t in batch.column(at).to_pylist())])
            columns = [*batch.columns]
            columns[at] = ids
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:at], "ids", *batch.schema.names[at + 1 :]])

    return run


def _decode(shared, name: str, at: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tool(Decoder, shared.value, name)
        for batch in fixed_rows(batches, 256):
            lists = batch.column(at)
            ids, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            decoded = ["".join(decoder.text(decoder.portions(ids[a:b]))) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def vocabulary(spark: SparkSession, path: str | None = None):
    """(broadcast ranks, their name).  A vocabulary is of fixed size: some 50,000 tokens here."""
    ship(spark)
    ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
    return spark.sparkContext.broadcast(ranks), _name(ranks)


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``: the tokens of its whole text."""
    shared, name = vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts().alias("text"))
    return rows.mapInArrow(_encode(shared, name, 1), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the text of every row's ids."""
    shared, name = vocabulary(encoded.sparkSession, path)
    rows = encoded.select("doc_id", F.coalesce(F.filter("ids", lambda x: x.isNotNull()), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decode(shared, name, 1), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, encoded and decoded again.

    Both run in one Python worker, so a core holds one machine instead of two.
    """
    shared, name = vocabulary(docs.sparkSession, path)
    encode, decode = _encode(shared, name, 1), _decode(shared, name, 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts().alias("text"))
    whole = rows.mapInArrow(lambda batches: decode(encode(batches)), "doc_id long, ids array<int>, decoded string")
    return whole.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and the text that they decode to."""
    return digests(read(spark, sf_dir, "documents", "doc_id", "text"))
