"""Cross-tokenizer alignment by external spill counting.

Two tokenizers cut the same bytes.  Where tokens of both end, a group ends, and every pair of an A
and a B token of one group is a link.  An id pair's count is the number of documents that hold it
linked, over the whole corpus.

1. A task encodes its documents and collects (pair, document) records, with the links of the pair
   in the document.  Beyond ``UNIT_RECORDS`` it sorts them and spills a unit: for each radix of the A
   id one zstd run with the pairs and their documents (``keys``) and one with the records
   (``members``).  Units and a row for each document go to the shared folder, so texts are
   encoded once.
2. Only the keys are counted: the runs of a radix are merged by a heap in A-major order, at most
   ``FAN_IN`` in one task; as many rounds follow as it takes to leave one run for each radix.  A
   pair is one entry of a unit, however many rows hold it.  The last round sees all pairs of an A
   id together and marks those with the highest count.
3. The runs are streamed past the table of their radix, and what each document's records add
   (count times links; links with the highest count) is sent back to its unit, where it meets
   the document's row.

Nothing is gathered that grows with a frequent token or text: a task holds the table of a radix
(bounded by the two vocabularies), ``FAN_IN`` frames or one run.

Every row is a document of its own: repeated rows and ids count one by one, null ids are passed on.
Null and empty texts, texts that are not UTF-8 and those whose joined tokens differ from space +
text have no tokens: zeros and ''.  Texts are cut before each space that follows no white space: no
token of either vocabulary crosses there, so tokens and groups of both sides are those of the words,
which are encoded once and kept up to a bound (``Words``).  A group with many tokens on both sides
is counted by its different ids.  Long texts are whole; a word has no greatest length.  Ties for the highest count are all
highest.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.once import once
from .common import fixed_rows, read, ship, store, texts

VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Records of a unit: what a task sorts in memory before it spills.
UNIT_RECORDS = 4_000_000
#: Radices of the A id.
RADICES = 64
#: Runs that one task merges, and runs that are streamed past one copy of a radix's table.
FAN_IN = 256
RUNS_OF_TABLE = 2048
FRAME = 1 << 14
#: Characters that are encoded at a time.
PORTION = 1 << 14
#: Words, and linked pairs of words, that a task keeps.
MAX_WORDS = 300_000
MAX_WORD_LINKS = 3_000_000
BATCH_BYTES = 1 << 19
_DOC_BITS = 20


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


#: tiktoken's pattern gives up on much longer runs of white space.
_LONGEST = 1 << 20


class ByteLevel:
    """A byte-level BPE in the format of the library tokenizers.

    The library tiktoken encodes it several times faster, and merges by the rank of what is merged.
    That is the same as merging listed pairs in their order if ids follow that order, as long as
    no token is there that its own bytes do not merge to (no text gives such a token): these are
    left out.  Any other kind of file is encoded by the library tokenizers.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        of, bytes_of = self.tokenizer.get_vocab(with_added_tokens=True), byte_alphabet()
        self.tokens = [b""] * (max(of.values(), default=-1) + 1)
        for token, i in of.items():
            known = all(c in bytes_of for c in token)
            self.tokens[i] = bytes(bytes_of[c] for c in token) if known else token.encode()
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranked(json.load(f))

    def _ranked(self, file: dict) -> object | None:
        import tiktoken

        model, cuts = file["model"], file.get("pre_tokenizer") or {}
        kept = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")}
        plain = model.get("type") == "BPE" and not any(kept.values()) and file.get("normalizer") is None
        cut = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")
        if not (plain and cut):
            return None
        of = model["vocab"]
        made = [of.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        letters = {of.get(c) for c in byte_alphabet()}
        if None in made or None in letters or made != sorted(set(made)) or max(letters) > min(made, default=256):
            return None
        whole = {i for t, i in of.items() if i in letters or [x.id for x in self.tokenizer.model.tokenize(t)] == [i]}
        ranks = {self.tokens[i]: i for i in letters.union(made) & whole}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, portions: list[str]) -> list[list[int]]:
        if self.fast is not None and max(map(len, portions), default=0) < _LONGEST:
            return [self.fast.encode_ordinary(" " + p) for p in portions]
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + p for p in portions], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; it adds the space before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, portions: list[str]) -> list[list[int]]:
        return self.model.encode(portions, num_threads=1)

    def cuts_before_spaces(self) -> bool:
        """Whether no piece goes on over a space that follows something else."""
        return not any(re.search(rb"[^ ] ", t) for t in self.tokens)


_CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
#: A word that another can follow: the space between them is a cut.
_ENDS = re.compile(r"\S\Z")


def words(text: str) -> list[str]:
    """The text cut at spaces (which are left out) that follow no white space; joined by spaces it is the text."""
    return _CUT.split(text)


class Aligner:
    """Both vocabularies, and what a task needs of them."""

    def __init__(self, a, b, radices: int = RADICES) -> None:
        self.a, self.b, self.radices = a, b, radices
        self.whole = not b.cuts_before_spaces()
        self.width_a, self.width_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (a, b))
        self.names_a = [f"{i}{end}" for end in ",|" for i in range(len(a.tokens))]
        self.names_b = [f"{i}{end}" for end in ",;" for i in range(len(b.tokens))]
        self.names = np.array(self.names_a + self.names_b, object)
        self.of_radix = ceil(len(a.tokens) / radices)
        self.bits_b = max(1, (len(b.tokens) - 1).bit_length())
        if self.bits_b + (self.of_radix * radices).bit_length() + _DOC_BITS > 63:
            raise ValueError("the vocabularies are too large for 63-bit records")

    def turned(self, a: np.ndarray) -> np.ndarray:
        """A ids renumbered so that each radix (id modulo radices) is one range."""
        return a % self.radices * self.of_radix + a // self.radices

    def ids(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The A and B ids of pairs."""
        a, b = pair >> self.bits_b, pair & ((1 << self.bits_b) - 1)
        return a % self.of_radix * self.radices + a // self.of_radix, b

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The A and B ids of each text; None unless both join to space + text."""
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            want = b" " + text.encode()
            good = all(b"".join([x.tokens[i] for i in ids]) == want for x, ids in ((self.a, a), (self.b, b)))
            yield (np.array(a, np.int64), np.array(b, np.int64)) if good else None

    def encode_words(self, words_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, B ids, A tokens and B tokens of each word); no tokens where they do not join to space + word.

        Words are encoded many at a time, as one text that would be cut into them again.
        """
        portions: list[list[int]] = [[]]
        size = 0
        for n, w in enumerate(words_):
            if size > PORTION or (portions[-1] and not _ENDS.search(words_[portions[-1][-1]])):
                portions.append([])
                size = 0
            portions[-1].append(n)
            size += len(w)
        out_a, out_b = [], []
        count_a, count_b = np.zeros(len(words_), np.int64), np.zeros(len(words_), np.int64)
        while portions:
            found = self.encode([" ".join([words_[n] for n in p]) for p in portions])
            again: list[list[int]] = []
            for p, ids in zip(portions, found):
                if ids is None:
                    again += [[n] for n in p] if len(p) > 1 else []
                    continue
                ends = np.cumsum([len(words_[n].encode()) + 1 for n in p])
                for (count, out, width), own in zip(((count_a, out_a, self.width_a), (count_b, out_b, self.width_b)), ids):
                    cut = np.searchsorted(np.cumsum(width[own]), ends) + 1
                    count[p] = np.diff(cut, prepend=0)
                    out.append((p, own))
            portions = again
        a, b = (self._ordered(out, count) for out, count in ((out_a, count_a), (out_b, count_b)))
        return a, b, count_a, count_b

    def _ordered(self, portions: list[tuple[list[int], np.ndarray]], count: np.ndarray) -> np.ndarray:
        """The portions' tokens in the order of the words."""
        ids, first = np.empty(count.sum(), np.int64), np.cumsum(count) - count
        for p, own in portions:
            n = count[p]
            ids[np.repeat(first[p] - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
        return ids

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many A and B tokens each group has."""
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        at = np.searchsorted(end_a, end_b)
        both = end_a[at] == end_b  # the texts end together, so no place is beyond A
        return np.diff(at[both], prepend=-1), np.diff(np.flatnonzero(both), prepend=-1)

    def written(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """``a1,a2|b1`` of each group."""
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.repeat(first_b, n_a)] = a
        code[np.arange(len(b)) + np.repeat(first_a + n_a, n_b)] = b + 2 * len(self.a.tokens)
        code[first_a + n_a - 1 + first_b] += len(self.a.tokens)
        code[first_b + n_b - 1 + first_a + n_a] += len(self.b.tokens)
        return "".join(self.names[code].tolist()).split(";")[:-1]

    def links(
        self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, most: int = 1 << 20
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(groups, pairs, links of each, None for one): portions of about ``most`` at the most."""
        first_a, first_b, size = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
        a = self.turned(a) << self.bits_b
        for g in np.flatnonzero(size > most):
            id_a, m_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            id_b, m_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            step = max(1, most // len(id_b))
            for i in range(0, len(id_a), step):
                pairs = (id_a[i : i + step, None] | id_b).ravel()
                yield np.full(len(pairs), g), pairs, (m_a[i : i + step, None] * m_b).ravel()
        small = np.flatnonzero((size <= most) & (size > 0))
        total = np.cumsum(size[small])
        begin = 0
        while begin < len(small):
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
            g = small[begin:end]
            of_a = np.repeat(n_b[g], n_a[g])  # links of each A token of these groups
            tokens = np.repeat(first_a[g] - (np.cumsum(n_a[g]) - n_a[g]), n_a[g]) + np.arange(n_a[g].sum())
            other = np.repeat(np.repeat(first_b[g], n_a[g]) - (np.cumsum(of_a) - of_a), of_a) + np.arange(of_a.sum())
            yield np.repeat(g, size[g]), np.repeat(a[tokens], of_a) | b[other], None
            begin = end


class Words:
    """What each word of a text has: tokens, groups, links, its groups as written, and its linked pairs."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner = aligner
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        self.figures = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links; -1: the tokens do not join to the word
        self.first = np.zeros(1, np.int64)  # where a word's pairs begin
        self.pairs, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode words that are not known yet."""
        al = self.aligner
        for i in range(0, len(new), 1 << 16):
            part = new[i : i + (1 << 16)]
            n = len(part)
            a, b, count_a, count_b = al.encode_words(part)
            # words end a token of both sides, so all words together have just their own groups
            n_a, n_b = al.groups(a, b)
            word = np.searchsorted(np.cumsum(count_a), np.cumsum(n_a))
            groups, links = np.bincount(word, minlength=n), np.zeros(n, np.int64)
            np.add.at(links, word, n_a * n_b)
            figures = np.stack([count_a, count_b, groups, links], axis=1)
            figures[count_a == 0] = -1
            written, ends = al.written(a, b, n_a, n_b), np.cumsum(groups)
            self.written += [";".join(written[e - g : e]) for g, e in zip(groups.tolist(), ends.tolist())]
            unit = Unit(al)
            for g, pairs, m in al.links(a, b, n_a, n_b):
                unit.put(pairs, word[g], m, 1 << 22)
            record, m = unit.compact()
            of = record & ((1 << _DOC_BITS) - 1)
            order = np.argsort(of, kind="stable")
            self.pairs = np.concatenate([self.pairs, record[order] >> _DOC_BITS])
            self.links = np.concatenate([self.links, m[order]])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(of, minlength=n))])
            self.figures = np.concatenate([self.figures, figures])
            self.number.update(zip(part, range(len(self.number), len(self.number) + n)))

    def texts(self, rows: list[bytes]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """For each text (A tokens, B tokens, groups, links, digest); and the pairs of all with text number and links.

        A pair may come several times for a text.
        """
        if len(self.number) > MAX_WORDS or len(self.pairs) > MAX_WORD_LINKS:
            self.forget()
        whole = [r.decode("utf-8", "replace") for r in rows]
        cut = [([] if not t or "\ufffd" in t and t.encode() != r else [t] if self.aligner.whole else words(t)) for t, r in zip(whole, rows)]
        self.learn(sorted(set().union(*cut) - self.number.keys()))
        at = list(map(self.number.__getitem__, chain.from_iterable(cut)))
        numbers, size = np.array(at, np.int64), np.array([len(ws) for ws in cut], np.int64)
        row = np.repeat(np.arange(len(rows)), size)
        figures, bad = np.zeros((len(rows), 4), np.int64), np.zeros(len(rows), bool)
        bad[row[self.figures[numbers, 0] < 0]] = True  # tokens of a word do not join to it: what counts is the text as a whole
        some = np.flatnonzero(size)
        ends = np.cumsum(size)
        if len(some):
            figures[some] = np.add.reduceat(self.figures[numbers], (ends - size)[some])
        out, alone = [], []
        for n, (own, end, ws) in enumerate(zip(figures.tolist(), ends.tolist(), cut)):
            if bad[n]:
                own, pairs, links = self.alone(whole[n])
                alone.append((pairs, np.full(len(pairs), n), links))
                out.append(own)
                continue
            digest = hashlib.sha256(";".join(map(self.written.__getitem__, at[end - len(ws) : end])).encode()).hexdigest() if ws else ""
            out.append((*own, digest))
        good = ~bad[row]
        known, times = np.unique(row[good] << 32 | numbers[good], return_counts=True)
        text, word = known >> 32, known & ((1 << 32) - 1)
        size = self.first[word + 1] - self.first[word]
        place = np.repeat(self.first[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pairs = [(self.pairs[place], np.repeat(text, size), self.links[place] * np.repeat(times, size)), *alone]
        return out, *(np.concatenate(x) for x in zip(*pairs))

    def alone(self, text: str) -> tuple[tuple, np.ndarray, np.ndarray]:
        """A text that is not cut into words."""
        one = Words(self.aligner)
        one.learn([text])
        if one.figures[0, 0] < 0:
            return (0, 0, 0, 0, ""), np.zeros(0, np.int64), np.zeros(0, np.int64)
        digest = hashlib.sha256(one.written[0].encode()).hexdigest()
        return (*one.figures[0].tolist(), digest), one.pairs, one.links


# --- runs --------------------------------------------------------------------------------------

_ZSTD: dict[str, object] = {}


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type, then zstd; the first byte is the type's width."""
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    tool = once(_ZSTD, "c", lambda: zstandard.ZstdCompressor(level=1))
    return bytes([width]) + tool.compress(x.astype(f"<u{width}").tobytes())


def unpack(data: bytes) -> np.ndarray:
    tool = once(_ZSTD, "d", zstandard.ZstdDecompressor)
    return np.frombuffer(tool.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def pack_keys(pairs: np.ndarray, docs: np.ndarray) -> bytes:
    """Ascending pairs (as gaps) and the documents of each."""
    return pack_pair(np.diff(pairs, prepend=0), docs)


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, docs = unpack_pair(data)
    return np.cumsum(gaps), docs


def pack_pair(one: np.ndarray, two: np.ndarray) -> bytes:
    first = pack(one)
    return len(first).to_bytes(4, "little") + first + pack(two)


def unpack_pair(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(data[:4], "little")
    return unpack(data[4:cut]), unpack(data[cut:])


class Unit:
    """The records of some documents, sorted and spilled together."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner, self.rows = aligner, []
        self.single: list[np.ndarray] = []  # a record for each link
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, rows: list[tuple], pairs: np.ndarray, row: np.ndarray, links: np.ndarray) -> None:
        """Some documents; pairs, the row that holds them, and their links."""
        self.put(pairs, row + len(self.rows), links)
        self.rows += [(len(self.rows) + n, *r) for n, r in enumerate(rows)]

    def put(self, pairs: np.ndarray, doc: int | np.ndarray, links: np.ndarray | None, most: int = 0) -> None:
        record = pairs << _DOC_BITS | doc
        if links is None:
            self.single.append(record)
        else:
            self.counted.append((record, links))
        self.held += len(record)
        if most and self.held > most:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """(records ascending, links): each record once."""
        record = np.sort(np.concatenate([np.empty(0, np.int64), *self.single]))
        starts = np.flatnonzero(np.diff(record, prepend=-1))
        links, record = np.diff(starts, append=len(record)), record[starts]
        if self.counted:
            record = np.concatenate([record, *(r for r, _ in self.counted)])
            links = np.concatenate([links, *(n for _, n in self.counted)])
            order = np.argsort(record, kind="stable")
            record, links = record[order], links[order]
            starts = np.flatnonzero(np.diff(record, prepend=-1))
            record, links = record[starts], np.add.reduceat(links, starts) if len(starts) else links
        self.single, self.counted, self.held = [], [(record, links)], len(record)
        return record, links

    def full(self, limit: int) -> bool:
        """Whether the unit is to be spilled: sorted first, as a pair of a document may have come many times."""
        if self.held >= limit:
            self.compact()
            return self.held >= limit // 2
        return len(self.rows) >= 1 << (_DOC_BITS - 1)

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(radix, keys, members) for each radix that has records."""
        record, links = self.compact()
        pair, doc = record >> _DOC_BITS, record & ((1 << _DOC_BITS) - 1)
        width = self.aligner.of_radix << self.aligner.bits_b
        edges = np.searchsorted(pair, np.arange(self.aligner.radices + 1) * width)
        for radix, (i, j) in enumerate(zip(edges, edges[1:])):
            if i == j:
                continue
            starts = np.flatnonzero(np.diff(pair[i:j], prepend=-1))
            docs = np.diff(starts, append=j - i)
            yield radix, pack_keys(pair[i:j][starts], docs), pack_pair(doc[i:j], links[i:j])


_WORDS: dict[tuple, Words] = {}
_SPILLED = (
    "unit long, radix int, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, keys binary, members binary"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _words(paths: tuple[str, str], radices: int) -> Words:
    """Lasts as long as the Python worker."""
    return once(_WORDS, (*paths, radices), lambda: Words(Aligner(ByteLevel(paths[0]), Pieces(paths[1]), radices)))


def _by_bytes(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    ids, rows, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if rows and (size + len(t) > most or len(rows) == 1 << 16):
                yield ids, rows
                ids, rows, size = [], [], 0
            ids.append(i)
            rows.append(t)
            size += len(t)
    if rows:
        yield ids, rows


def _spill(paths: tuple[str, str], radices: int, limit: int) -> Callable:
    schema = _arrow(_SPILLED)

    def emit(unit: Unit, number: int) -> Iterator[pa.RecordBatch]:
        rows = [(number, -1, *row, None, None) for row in unit.rows]
        yield _table(rows, schema)
        for radix, keys, members in unit.runs():
            yield _table([(number, radix, *[None] * 7, keys, members)], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _words(paths, radices)
        number = TaskContext.get().partitionId() << 32
        unit = Unit(kept.aligner)
        for ids, rows in _by_bytes(batches, BATCH_BYTES):
            found, *records = kept.texts(rows)
            unit.add([(i, *r) for i, r in zip(ids, found)], *records)
            if unit.full(limit):
                yield from emit(unit, number)
                unit, number = Unit(kept.aligner), number + 1
        if unit.rows:
            yield from emit(unit, number)

    return run


# --- counting ----------------------------------------------------------------------------------


class Cursor:
    """A run, read frame by frame."""

    def __init__(self, frames: list[bytes]) -> None:
        self.frames, self.next = frames, 0
        self.load()

    def load(self) -> bool:
        if self.next >= len(self.frames):
            return False
        self.pairs, self.docs = unpack_keys(self.frames[self.next])
        self.frames[self.next] = b""
        self.next += 1
        self.at = 0
        return True

    def take(self, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The entries below ``end``."""
        while True:
            to = int(np.searchsorted(self.pairs, end))
            if to > self.at:
                yield self.pairs[self.at : to], self.docs[self.at : to]
            self.at = to
            if to < len(self.pairs) or not self.load():
                return

    def done(self) -> bool:
        return self.at >= len(self.pairs)


def merged(runs_: list[list[bytes]], bits_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way heap merge, A-major: all pairs of one A id with their documents, added up over the runs."""
    cursors = [Cursor(frames) for frames in runs_ if frames]
    heap = [(int(c.pairs[0]) >> bits_b, k) for k, c in enumerate(cursors)]
    heapq.heapify(heap)
    while heap:
        a, parts = heap[0][0], []
        while heap and heap[0][0] == a:
            k = heap[0][1]
            parts += cursors[k].take((a + 1) << bits_b)
            if cursors[k].done():
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (int(cursors[k].pairs[cursors[k].at]) >> bits_b, k))
        if len(parts) == 1:
            yield parts[0]
            continue
        pairs, docs = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(pairs, kind="stable")
        pairs, docs = pairs[order], docs[order]
        starts = np.flatnonzero(np.diff(pairs, prepend=-1))
        yield pairs[starts], np.add.reduceat(docs, starts)


def _grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, rows as dicts) of sorted batches; the rows of a key must be used up before the next."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for small in fixed_rows([batch], 64):
                yield from small.to_pylist()

    return groupby(rows(), key=lambda r: tuple(r[k] for k in keys))


def _merge(bits_b: int, keys: list[str], last: bool) -> Callable:
    """One run out of all runs of a key.  The last round marks each A id's highest counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow("radix int, run long, seq int, keys binary" + (", best binary" if last else ""))
        for key, rows in _grouped(batches, keys):
            of: dict[int, list[bytes]] = {}
            for r in rows:
                of.setdefault(r["run"], []).append(r["keys"])
            held: list[tuple] = []
            size = seq = 0

            def frame() -> pa.RecordBatch:
                pairs, docs = (np.concatenate(x) for x in list(zip(*held))[:2])
                best = [pack(np.concatenate([h[2] for h in held]))] if last else []
                return _table([(key[0], key[1] if len(key) > 1 else 0, seq, pack_keys(pairs, docs), *best)], schema)

            for pairs, docs in merged(list(of.values()), bits_b):
                held.append((pairs, docs, (docs == docs.max()).astype(np.int64)) if last else (pairs, docs))
                size += len(pairs)
                if size >= FRAME:
                    yield frame()
                    held, size, seq = [], 0, seq + 1
            if held:
                yield frame()

    return run


def pair_table(spilled: DataFrame, bits_b: int, units: int, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, run, seq, keys, best): the counts of all pairs, frames in A-major order."""
    n = int(spilled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs_ = spilled.filter("radix >= 0").select("radix", F.col("unit").alias("run"), F.lit(0).alias("seq"), "keys")
    while units > fan_in:
        units = ceil(units / fan_in)
        salt = F.pmod(F.xxhash64("run"), F.lit(units))
        dealt = runs_.withColumn("salt", salt).repartition(n, "radix", "salt").sortWithinPartitions("radix", "salt", "run", "seq")
        merged_ = dealt.mapInArrow(_merge(bits_b, ["radix", "salt"], False), "radix int, run long, seq int, keys binary")
        runs_ = store(merged_, "counted-runs")
    dealt = runs_.repartition(n, "radix").sortWithinPartitions("radix", "run", "seq")
    return store(dealt.mapInArrow(_merge(bits_b, ["radix"], True), "radix int, run long, seq int, keys binary, best binary"), "pair-counts")


def _contribute() -> Callable:
    """What the records of each run add to the documents of its unit."""
    schema = _arrow("unit long, radix int, doc int, added binary, best binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, ["radix", "salt"]):
            frames, table = [], None
            for r in rows:
                if r["unit"] is None:  # the table's frames come first
                    frames.append((*unpack_keys(r["keys"]), unpack(r["members"])))
                    continue
                if table is None:
                    table = [np.concatenate(x) for x in zip(*frames)]
                pairs, docs = unpack_keys(r["keys"])
                doc, links = unpack_pair(r["members"])
                at = np.repeat(np.searchsorted(table[0], pairs), docs)
                own, place = np.unique(doc, return_inverse=True)
                added, best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                np.add.at(added, place, links * table[1][at])
                np.add.at(best, place, links * table[2][at])
                yield _table([(r["unit"], r["radix"], None, pack_pair(own, added), pack(best))], schema)

    return run


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _return() -> Callable:
    schema = _arrow(_RESULT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, ["unit"]):
            own: list[dict] = []
            added = best = np.zeros(0, np.int64)
            for r in rows:
                if r["radix"] < 0:  # the documents come first, in their order
                    own.append(r)
                    continue
                if len(added) < len(own):
                    added, best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                doc, more = unpack_pair(r["added"])
                added[doc] += more
                best[doc] += unpack(r["best"])
            if len(added) < len(own):
                added = best = np.zeros(len(own), np.int64)
            for i in range(0, len(own), 4096):
                out = [
                    (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], int(best[i + j]), int(added[i + j]), r["groups_sha256"])
                    for j, r in enumerate(own[i : i + 4096])
                ]
                yield _table(out, schema)

    return run


def align(
    docs: DataFrame,
    paths: tuple[str, str] | None = None,
    unit_records: int = UNIT_RECORDS,
    radices: int = RADICES,
    fan_in: int = FAN_IN,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row for each row of ``docs`` (doc_id, text), as op13 returns it; and the counts.

    The counts are (radix, run, seq, keys, best) frames; ``pair_counts`` reads them.
    """
    spark = docs.sparkSession
    ship(spark)
    paths = paths or tuple(public_tokenizers.path(v) for v in VOCABULARIES)
    bits_b = max(1, (_pieces(paths[1]) - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts().alias("text"))
    spilled = store(rows.mapInArrow(_spill(paths, radices, unit_records), _SPILLED), "alignment-runs")
    units = spilled.filter("radix < 0").agg(F.approx_count_distinct("unit", 0.02)).first()[0]
    table = pair_table(spilled, bits_b, units, fan_in)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = ceil(max(units, 1) / RUNS_OF_TABLE)
    salt = F.pmod(F.xxhash64("unit"), F.lit(salts)).cast("int")
    streamed = spilled.filter("radix >= 0").select("radix", salt.alias("salt"), "unit", F.lit(0).alias("seq"), "keys", "members")
    counts = table.select(
        "radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("unit"), "seq", "keys", F.col("best").alias("members")
    )
    dealt = streamed.unionByName(counts).repartition(n, "radix", "salt")
    dealt = dealt.sortWithinPartitions("radix", "salt", F.col("unit").asc_nulls_first(), "seq")
    added = dealt.mapInArrow(_contribute(), "unit long, radix int, doc int, added binary, best binary")
    own = spilled.filter("radix < 0").select("unit", "radix", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    home = own.unionByName(added, allowMissingColumns=True).repartition(n, "unit").sortWithinPartitions("unit", "radix", "doc")
    return home.mapInArrow(_return(), _RESULT), table


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def pair_counts(table: DataFrame, paths: tuple[str, str] | None = None, radices: int = RADICES) -> DataFrame:
    """(a, b, docs, best) of ``align``'s second table: every linked id pair, its documents, whether none of A's is higher."""
    paths = paths or tuple(public_tokenizers.path(v) for v in VOCABULARIES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _words(paths, radices).aligner
        for batch in fixed_rows(batches, 1):
            for keys, best in zip(batch.column("keys").to_pylist(), batch.column("best").to_pylist()):
                pairs, docs = unpack_keys(keys)
                a, b = aligner.ids(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(docs), pa.array(unpack(best) > 0)], names=["a", "b", "docs", "best"])

    return table.mapInArrow(run, "a long, b long, docs long, best boolean")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment figures of all documents."""
    return align(read(spark, sf_dir, "documents", "doc_id", "text"))[0]
