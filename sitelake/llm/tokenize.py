"""Encoding a corpus with a public byte-level BPE, in constant memory per text.

Every text is read in chunks by two transducers, one behind the other, each of
which holds back only what later input may still change:

* the pre-tokenizer passes on the pre-tokens whose end no later character can move.
  One that grows beyond LONG_PIECE characters is passed on in parts while it lasts;
* the encoder of such a long pre-token keeps the last token of each prefix. That of
  the next prefix follows from those of shorter ones and from whether two tokens may
  stand side by side in the merge list's output. A token is emitted once the chains
  of all prefixes that a later token can begin at agree on it.

How far the last change can reach back, the sufficient lookahead, comes from the
merge list: a merge is undone only by one of an earlier rank that overlaps its end,
so the longest chain of overlapping tokens of falling rank bounds it.

A short pre-token is one step of the merge loop; its tokens are kept for the next time.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
#: Characters read at a time.
CHUNK = 1 << 16
#: Characters from which a pre-token is encoded in parts.
LONG_PIECE = 4096
#: Different short pre-tokens whose tokens a task keeps, and pairs of tokens.
KEPT_PIECES, KEPT_PAIRS = 1 << 18, 1 << 20
#: Fixed value: the pre-token pattern of the public 50k vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a long pre-token consists of, by the first of these that its last character belongs to.
_RUNS = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*")]
_SPACES = _RUNS[2]


class ByteBpe:
    """A vocabulary of tiktoken ranks. Strings that look like special tokens are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.rank_of = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(PATTERN)
        self._known: dict[str, list[int]] = {}
        self._pairs: dict[int, bool] = {}

    @cached_property
    def lookahead(self) -> int:
        """Bytes behind a token after which no later byte changes it: the longest chain of tokens of falling rank, each overlapping the end of the one before."""
        reach_of: dict[bytes, int] = {}  # by the beginning of a token of an earlier rank
        most = self.longest
        for token, _ in sorted(self.rank_of.items(), key=lambda x: x[1]):
            n = len(token)
            reach = max([n, *(k + r for k in range(1, n) if (r := reach_of.get(token[k:])))])
            most = max(most, reach)
            for k in range(1, n):
                if reach_of.get(token[:k], 0) < reach:
                    reach_of[token[:k]] = reach
        return most

    @cached_property
    def ends(self):
        """An automaton that finds all tokens that end at each byte, longest first."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for token, rank in self.rank_of.items():
            found.add_word(token.decode("latin-1"), (rank, len(token)))
        found.make_automaton()
        return found

    def beside(self, left: int, right: int) -> bool:
        """Whether the merge list leaves the two tokens as they are, side by side."""
        key = left << 32 | right
        if (found := self._pairs.get(key)) is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self.encoding._encode_single_piece(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    # encoding
    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self._parts(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)):
            out += part
        return out

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Token ids of the chunks' concatenation, emitted as soon as they are stable."""
        for part in self._parts(c[i : i + CHUNK] for c in chunks for i in range(0, len(c), CHUNK)):
            yield from part

    def _parts(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        held, run, inside = "", None, None  # run: the pattern of a long pre-token that goes on, inside: its encoder
        for chunk in chunks:
            held += _scalar_values(chunk)
            if run is not None:
                end = run.match(held).end()
                goes_on = end == len(held)
                if run is _SPACES:  # its last character may belong to what follows
                    end -= 1
                if end > 0:
                    yield inside.feed(held[:end].encode("utf-8"))
                    held = held[end:]
                if goes_on:
                    continue
                yield inside.close()
                run = inside = None
            pieces = self.pattern.findall(held)
            rest = len(held)
            while pieces and (rest == len(held) or pieces[-1][0] == "'" and rest - len(pieces[-1]) + 3 > len(held)):
                rest -= len(pieces.pop())
            yield self._short(pieces)
            held = held[rest:]
            if len(held) >= LONG_PIECE:
                run, inside = next(r for r in _RUNS if r.fullmatch(held[-1])), PieceStream(self)
                cut = len(held) - (run is _SPACES)
                yield inside.feed(held[:cut].encode("utf-8"))
                held = held[cut:]
        if run is not None:
            yield inside.feed(held.encode("utf-8"))
            yield inside.close()
        elif held:
            yield self._short(self.pattern.findall(held))

    def _short(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        known = self._known.get
        for piece in pieces:
            ids = known(piece)
            if ids is None:
                ids = self._piece(piece)
            out += ids
        return out

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        if len(piece) >= LONG_PIECE:
            inside = PieceStream(self)
            return inside.feed(raw) + inside.close()
        if len(self._known) >= KEPT_PIECES:
            self._known.clear()
        ids = self.encoding._encode_single_piece(raw)
        if len(piece) <= 64:
            self._known[piece] = ids
        return ids

    # decoding
    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, each character emitted once its last byte is read; what is no text becomes U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := state.decode(self.bytes_of[i]):
                yield part
        if part := state.decode(b"", True):
            yield part


class PieceStream:
    """The tokens of one pre-token of any length, from the last tokens of its prefixes; what it holds does not grow."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.search = bpe.ends.iter("")
        self.last: list[int] = []  # last token of each prefix that ends behind what is emitted
        self.left: int | None = None  # the token emitted last
        self.base = 0  # bytes emitted
        self.most = bpe.lookahead + bpe.longest + 1024  # bytes held at most
        self.due = 1024

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(raw), 1024):
            self._step(raw[at : at + 1024])
            if len(self.last) >= self.due:
                out += self._stable()
                self.due = len(self.last) + 1024
                if len(self.last) > self.most:
                    raise AssertionError("the merge list's lookahead does not hold")
        return out

    def _step(self, raw: bytes) -> None:
        last, left, base, beside = self.last, self.left, self.base, self.bpe.beside
        done = base + len(last)  # prefixes that have a token
        self.search.set(raw.decode("latin-1"))
        for end, (token, size) in self.search:
            if end < done:
                continue
            start = end + 1 - size - base
            if start > 0:
                before = last[start - 1]
                if not beside(before, token):
                    continue
            elif start < 0 or left is not None and not beside(left, token):
                continue
            last.append(token)
            done = end + 1

    def _stable(self) -> list[int]:
        """The tokens on which the chains of all prefixes within the longest token's reach agree."""
        n, size_of = len(self.last), self.bpe.bytes_of
        heads = set(range(max(0, n - self.bpe.longest + 1), n + 1))
        at = n
        while len(heads) > 1:
            while at not in heads:
                at -= 1
            heads.discard(at)
            heads.add(at - len(size_of[self.last[at - 1]]))
        return self._emit(heads.pop())

    def _emit(self, end: int) -> list[int]:
        out, at = [], end
        while at > 0:
            out.append(self.last[at - 1])
            at -= len(self.bpe.bytes_of[out[-1]])
        if out:
            self.left = out[0]
            del self.last[:end]
            self.base += end
        return out[::-1]

    def close(self) -> list[int]:
        return self._emit(len(self.last))


def _scalar_values(text: str) -> str:
    """`text` with lone surrogates, which have no UTF-8 form, replaced."""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


@lru_cache(4)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each document's text, without special tokens.

    Null and empty texts give an empty list. Blank texts have the ids of their
    white space. Repeated rows are encoded each time; extra columns are ignored.
    """
    path = path or vocabulary_path()

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            ids = [bpe.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids, like empty ones, give an empty text. Ids that the vocabulary lacks are an error."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts = ["".join(bpe.decode_stream(ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
