"""Byte-level BPE by a lazily determinised finite-state transducer.

Fact used: a token sequence is the BPE encoding of its bytes exactly if every
adjacent pair encodes to itself, and the encoding of a prefix is a prefix chain:
for each position there is one last token, and following it leftwards gives the
encoding of the prefix. The transducer's state is what the future can still
change: the token before the last settled boundary and the bytes since. On a
byte it finds the one last token of the longer prefix, drops starting points that
no vocabulary entry can still reach, and emits every token up to the boundary that
all chains of the remaining starting points share. Lookahead is so bounded by the longest
vocabulary entry. States and transitions are made on first use and kept in a
table of bounded size; once it is full, what is left of a short piece whose next transition is not
in it takes the same steps without making states, and of a long one the states made are not kept.

A piece that is itself an entry is one token. Which entries merging does not lead to is found once for a table of ranks (usually none): only those are
looked up, all other pieces go through the transducer.

Texts of any length are read whole; a piece without a boundary (a run of letters, say) is
encoded in time linear in its length and not remembered. Null or empty text: no tokens, hashes of the empty string. Repeated rows give
repeated results; other input columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import base64
import gc
import re
import struct
from bisect import insort
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: At most so many states and remembered pieces a worker, and pieces of so many characters, so that both tables stay within some 150 MB.
MAX_STATES, MAX_PIECES, MAX_REMEMBERED = 50_000, 400_000, 48
#: Bytes of a piece that may be held without settling boundaries.
SHORT = 4 * MAX_REMEMBERED
#: Below this code point the pieces are cut by a pattern with its classes spelt out, which is faster.
PLAIN = 0x250


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is in the table."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def not_their_own_encoding(ranks: dict[bytes, int]) -> frozenset[bytes]:
    """The entries that merging does not lead to. A piece that is such an entry is one token all the same, which no transducer of merges can tell; every other entry comes out of it as one token."""
    return frozenset(t for t, i in ranks.items() if merge_pairs(t, ranks) != [i])


class MergeTransducer:
    """A state is [token before, bytes since, last token by position, positions at which an entry may still start, its steps, its final output]."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, exceptions: frozenset[bytes] | None = None):
        self.ranks, self.max_states = ranks, max_states
        self.exceptions = not_their_own_encoding(ranks) if exceptions is None else exceptions
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        #: By bytes: 2 * (token + 1, 0 if none), and 1 more if a longer entry begins with them.
        self.known = {t[:i]: 1 for t in ranks for i in range(1, len(t))}
        for t, i in ranks.items():
            self.known[t] = self.known.get(t, 0) + 2 * (i + 1)
        self.pair: dict[int, bool] = {}
        self.first = [-1, b"", (), (0,), {}, ()]
        self.made = {(-1, b""): self.first}

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, joined, encode to themselves; left -1: none."""
        joined = (self.tokens[left] if left >= 0 else b"") + self.tokens[right]
        out = merge_pairs(joined, self.ranks) == ([left, right] if left >= 0 else [right])
        if len(self.pair) > 4 * self.max_states:
            self.pair.clear()
        self.pair[left << 32 | right] = out
        return out

    def step(self, state: list, byte: int) -> tuple[list, tuple[int, ...]]:
        before, buf, last, live, steps, _ = state
        buf += bytes((byte,))
        known, pair, token, going = self.known, self.pair, -1, []
        for q in live:
            if found := known.get(buf[q:]):
                if found & 1:
                    going.append(q)
                if token < 0 and found > 1:
                    left, t = last[q - 1] if q else before, (found >> 1) - 1
                    fits = pair.get(left << 32 | t)
                    if fits or fits is None and self.fits(left, t):
                        token = t
        if token < 0:
            raise ValueError("the table lacks a single byte")
        last += (token,)
        going.append(len(buf))
        settled, out = going[0], ()
        if settled:
            if len(going) > 1:
                settled = self.meeting(going, last)
            if settled:
                out = self.chain(last, settled)
                before, buf, last, going = last[settled - 1], buf[settled:], last[settled:], [q - settled for q in going]
        if (to := self.made.get((before, buf))) is None:
            to = [before, buf, last, going, {}, None]
            if len(self.made) < self.max_states:
                self.made[before, buf] = to
        if len(self.made) < self.max_states:
            steps[byte] = to, out
        return to, out

    def rest(self, state: list, piece: bytes, at: int) -> list[int]:
        """What is left to emit from this state on for piece[at:], by the same steps without making states: no boundary is settled before the end."""
        before, buf, last, live, _, _ = state
        piece, last, known, pair = piece[at - len(buf) :], list(last), self.known, self.pair
        for end in range(len(buf) + 1, len(piece) + 1):
            token, going = -1, []
            for q in live:
                if found := known.get(piece[q:end]):
                    if found & 1:
                        going.append(q)
                    if token < 0 and found > 1:
                        left, t = last[q - 1] if q else before, (found >> 1) - 1
                        fits = pair.get(left << 32 | t)
                        if fits or fits is None and self.fits(left, t):
                            token = t
            if token < 0:
                raise ValueError("the table lacks a single byte")
            last.append(token)
            going.append(end)
            live = going
        return list(self.chain(last, len(piece)))

    def meeting(self, ends: list[int], last: tuple[int, ...]) -> int:
        """Where the chains from all these positions have met: the largest steps back until one is left."""
        ends = ends.copy()
        while len(ends) > 1:
            q = ends.pop()
            q -= self.lengths[last[q - 1]]
            if q not in ends:
                insort(ends, q)
        return ends[0]

    def chain(self, last: Sequence[int], q: int) -> tuple[int, ...]:
        out = []
        while q > 0:
            out.append(last[q - 1])
            q -= self.lengths[last[q - 1]]
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> list[int]:
        if self.exceptions and piece in self.exceptions:
            return [self.ranks[piece]]
        state, out = self.first, []
        for at, byte in enumerate(piece):
            if (made := state[4].get(byte)) is None:
                if len(piece) <= SHORT and len(self.made) >= self.max_states:
                    return out + self.rest(state, piece, at)
                made = self.step(state, byte)
            state, emitted = made
            if emitted:
                out += emitted
        if (end := state[5]) is None:
            end = state[5] = self.chain(state[2], len(state[1]))
        out += end
        return out


def class_of(code: str) -> str:
    """A character class below PLAIN, spelt out as ranges."""
    return "".join(f"\\u{i:04x}" for i in range(PLAIN) if regex.match(code, chr(i)))


@lru_cache(1)
def plain_pattern() -> re.Pattern:
    letter, number, space = class_of(r"\p{L}"), class_of(r"\p{N}"), class_of(r"\s")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Splitter:
    """Cuts a text into the pattern's matches."""

    def __init__(self, pattern: str):
        import public_tokenizers

        self.general = regex.compile(pattern)
        self.plain = plain_pattern() if pattern == public_tokenizers.PATTERN else None
        self.beyond = re.compile(f"[^\\u0000-\\u{PLAIN - 1:04x}]")

    def __call__(self, text: str) -> list[str]:
        if self.plain is not None and not self.beyond.search(text):
            return self.plain.findall(text)
        return self.general.findall(text)


class _Pieces(dict):
    """Piece to its ids as little-endian 32-bit integers."""

    def __init__(self, transducer: MergeTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MAX_REMEMBERED:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = out
        return out


class Utf8Stream:
    """Incremental UTF-8 state machine: bytes in any portions to text.

    The state is the bytes of an unfinished character, three at most. Bytes
    that no character can hold become U+FFFD, as in whole-text decoding.
    """

    def __init__(self):
        self.rest = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.rest + data
        keep = 0
        for back in range(1, min(4, len(data) + 1)):  # the last lead byte tells how many bytes are due
            byte = data[-back]
            if byte >= 0xC0:
                due = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                tail = data[-back:]
                keep = back if due > back and self.may_go_on(tail) else 0
            if byte >= 0xC0 or byte < 0x80:
                break
        if final:
            keep = 0
        self.rest = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def may_go_on(tail: bytes) -> bool:
        """Whether the lead byte and the continuation bytes so far begin a well-formed character."""
        lead = tail[0]
        if not 0xC2 <= lead <= 0xF4:
            return False
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
        return len(tail) == 1 or low <= tail[1] <= high


class Codec:
    def __init__(self, path: str, pattern: str | None = None, exceptions: frozenset[bytes] | None = None):
        import public_tokenizers

        self.ranks = read_ranks(path)
        self.vocabulary = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.vocabulary[i] = token
        self.split = Splitter(pattern or public_tokenizers.PATTERN)
        self.pieces = _Pieces(MergeTransducer(self.ranks, exceptions=exceptions))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode_bytes(self, ids: bytes, portion: int = 1 << 16) -> Iterator[bytes]:
        for at in range(0, len(ids), 4 * portion):
            part = ids[at : at + 4 * portion]
            yield b"".join(map(self.vocabulary.__getitem__, memoryview(part).cast("I")))

    def decode(self, portions: Iterable[bytes]) -> Iterator[str]:
        """Text of a stream of decoded bytes, whole characters at a time."""
        stream = Utf8Stream()
        for part in portions:
            yield stream.feed(part)
        yield stream.feed(b"", final=True)


@lru_cache(4)
def exceptions_of(path: str) -> frozenset[bytes]:
    """Found once, on the driver."""
    return not_their_own_encoding(read_ranks(path))


@lru_cache(2)
def codec(path: str, pattern: str | None = None, exceptions: frozenset[bytes] | None = None) -> Codec:
    own = Codec(path, pattern, exceptions)
    gc.freeze()  # the tables live as long as the worker: collections need not walk them
    return own


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def _digest(own: Codec):

    def one(doc_id, text, ids=None):
        text = text or ""
        ids = own.encode(text) if ids is None else ids
        seen, back = sha256(), []
        stream = Utf8Stream()
        for part in own.decode_bytes(ids):
            seen.update(part)
            back.append(stream.feed(part))
        back.append(stream.feed(b"", final=True))
        return doc_id, len(ids) // 4, sha256(ids).hexdigest(), seen.hexdigest(), "".join(back) == text

    return one


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """A row a document: number of tokens, hash of the ids, hash of the bytes decoded from them, whether the text came back."""
    exceptions = exceptions_of(ranks_path)
    return map_rows(docs, ["doc_id", "text"], OUT, lambda: _digest(codec(ranks_path, pattern, exceptions)))


PACKED = pa.schema([*OUT, ("ids", pa.binary())])


def encode_packed(docs: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """The digests and the ids themselves, as little-endian unsigned 32-bit integers."""

    exceptions = exceptions_of(ranks_path)

    def make():
        own = codec(ranks_path, pattern, exceptions)
        digest = _digest(own)
        return lambda doc_id, text: (*digest(doc_id, text, ids := own.encode(text or "")), ids)

    return map_rows(docs, ["doc_id", "text"], PACKED, make)


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """A row a document: its token ids."""

    exceptions = exceptions_of(ranks_path)

    def make():
        own = codec(ranks_path, pattern, exceptions)
        return lambda doc_id, text: (doc_id, memoryview(own.encode(text or "")).cast("I").tolist())

    return map_rows(docs, ["doc_id", "text"], IDS, make)


TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """A row a document: the text of its ids (null ids: empty)."""

    exceptions = exceptions_of(ranks_path)

    def make():
        own = codec(ranks_path, pattern, exceptions)
        return lambda doc_id, ids: (doc_id, "".join(own.decode(own.decode_bytes(struct.pack(f"<{len(ids or [])}I", *(ids or []))))))

    return map_rows(encoded, ["doc_id", "ids"], TEXT, make)
