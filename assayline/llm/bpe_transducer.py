"""Byte-level BPE by a transducer whose states are made as texts need them, and the way back.

A text is cut into matches of the tokenizer's pattern; a match that is a token is
that token, any other is read byte by byte. What may follow a read prefix is a
set of branches, one for each place where a token may have begun that is still
open: the tokens up to that place and the open token's bytes so far. Two
facts make the set small and exact. The tokens of each prefix are unique, and a
sequence of tokens is the encoding of its bytes if and only if each token stands
(its own bytes merge into it) and no merge would cross from one token into the next,
which depends on these two alone. The set is a state of a deterministic
machine; its moves are worked out once and kept. What all branches
share is emitted: no branch is older than the longest token, so that bounds the lookahead.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B

_NEVER = 1 << 62
#: The state before any byte: no token, and one branch at the root.
_FIRST = array("i", [-1, 0, 0]).tobytes()
#: So many of a match's first bytes are read in one step.
_START = 6


@dataclass(frozen=True)
class BpeParams:
    """``ranks``: a file of base64 tokens and ranks; ``pattern`` cuts texts into matches.

    ``max_states`` and ``max_matches`` bound what a Python worker keeps: when there are
    more, it forgets all and works them out anew; first bytes of matches are kept up to ``max_states`` too. ``step_ids``: ids that are decoded at a time.
    """

    ranks: str
    pattern: str
    max_states: int = 1 << 18
    max_matches: int = 1 << 17
    step_ids: int = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary needs a token for each byte")
    return ranks


#: What a worker's encoder and decoder share.
_ranks = lru_cache(maxsize=1)(read_ranks)


class Merges:
    """What the ranks say of tokens: whether one stands, and whether two stay apart."""

    def __init__(self, ranks: dict[bytes, int], max_pairs: int = 1 << 18) -> None:
        self.ranks, self.max_pairs = ranks, max_pairs
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._logs: dict[int, tuple[tuple[int, ...], tuple[bytes, ...], tuple[bytes, ...]]] = {}
        self._apart: dict[int, bool] = {}

    def log(self, token: int) -> tuple[tuple[int, ...], tuple[bytes, ...], tuple[bytes, ...]]:
        """How a token's bytes merge, lowest rank first: each step's rank, and the first and the last part before it."""
        found = self._logs.get(token)
        if found is None:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            steps, first, last = [], [], []
            while True:
                first.append(parts[0])
                last.append(parts[-1])
                rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)), default=(_NEVER, 0))
                steps.append(rank)
                if rank == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self._logs[token] = (tuple(steps), tuple(first), tuple(last))
        return found

    def stands(self, token: int) -> bool:
        return len(self.log(token)[0]) == len(self.bytes_of[token])

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses from ``left`` into ``right``: both go their own steps, lowest rank first, the left one first on ties."""
        key = left << 32 | right
        found = self._apart.get(key)
        if found is None:
            steps, _, edge = self.log(left)
            other_steps, other_edge, _ = self.log(right)
            i = k = 0
            while True:
                across = self.ranks.get(edge[i] + other_edge[k], _NEVER)
                if across < steps[i] and across <= other_steps[k]:
                    found = False
                    break
                if steps[i] == other_steps[k] == _NEVER:
                    found = True
                    break
                if steps[i] <= other_steps[k]:
                    i += 1
                else:
                    k += 1
            if len(self._apart) >= self.max_pairs:
                self._apart.clear()
            self._apart[key] = found
        return found


class Transducer:
    """The deterministic machine.

    Nodes (read parts of tokens) and states are numbers, and what is known of them is in flat tables of
    numbers, which Python's garbage collector passes by. ``whats[state]`` holds, packed, the token emitted last (-1: none) and then, for each
    branch, its node, how many tokens it has and these tokens; the last branch is the one whose tokens end here, and has them in ``ends`` too.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int) -> None:
        self.merges, self.max_states = Merges(ranks), max_states
        self.child: dict[int, int] = {}
        self.token, self.more = array("q", [-1]), bytearray(1)
        for data, token in ranks.items():
            node = 0
            for byte in data:
                self.more[node] = 1
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.more.append(0)
            if self.merges.stands(token):
                self.token[node] = token
        self._forget(_FIRST)

    def _forget(self, what: bytes) -> int:
        """Forgets all but the first state and the one of ``what``, whose new number it returns."""
        self.states: dict[bytes, int] = {}
        self.whats: list[bytes] = []
        self.ends: list[tuple[int, ...]] = []
        #: ``state << 8 | byte`` to the next state, itself times 256; or, if ids are emitted, to ``~i``, where both stand at ``jumps[i]``.
        self.moves: dict[int, int] = {}
        self.jumps: list[tuple[int, tuple[int, ...]]] = []
        #: A match's first bytes to the state after them, times 256, and the ids emitted by then.
        self.starts: dict[bytes, tuple[int, tuple[int, ...]]] = {}
        self._state(_FIRST, ())
        branches, at = array("i", what).tolist(), 1
        while at + 2 + branches[at + 1] < len(branches):
            at += 2 + branches[at + 1]
        return self._state(what, tuple(branches[at + 2 :]))

    def _state(self, what: bytes, ends: tuple[int, ...]) -> int:
        found = self.states.setdefault(what, len(self.whats))
        if found == len(self.whats):
            self.whats.append(what)
            self.ends.append(ends)
        return found

    def _move(self, state: int, byte: int) -> int:
        what = array("i", self.whats[state]).tolist()
        emitted, at, ended, alive = what[0], 1, None, []
        child, apart = self.child, self.merges.apart
        while at < len(what):
            upto = at + 2 + what[at + 1]
            node = child.get(what[at] << 8 | byte)
            if node is not None:
                if ended is None and (token := self.token[node]) >= 0:
                    # Branches stand from the oldest, so the first that may end here is the only one.
                    before = what[upto - 1] if what[at + 1] else emitted
                    if before < 0 or apart(before, token):
                        ended = [*what[at + 2 : upto], token]
                if self.more[node]:
                    alive.append((node, what[at + 2 : upto]))
            at = upto
        if ended is None:
            raise AssertionError("each prefix of a match has an encoding")
        # How many tokens all branches share; the oldest branch has the fewest that it could.
        n = min(map(len, (ended, *(tokens for _, tokens in alive))))
        while n and any(tokens[:n] != ended[:n] for _, tokens in alive):
            n -= 1
        # The last token is asked for by branches that have none of their own.
        bare = len(ended) == n or any(len(tokens) == n for _, tokens in alive)
        following = [(ended[n - 1] if n else emitted) if bare else -1]
        for node, tokens in alive:
            following += (node, len(tokens) - n, *tokens[n:])
        rest = ended[n:]
        following += (0, len(rest), *rest)
        move = self._state(array("i", following).tobytes(), tuple(rest)) << 8
        if n:
            self.jumps.append((move, tuple(ended[:n])))
            move = -len(self.jumps)
        self.moves[state << 8 | byte] = move
        return move

    def _after(self, first: bytes) -> tuple[int, tuple[int, ...]]:
        """The state after a match's first bytes, times 256, and the ids emitted by then; kept for the next match that begins so."""
        at, out = 0, []
        for byte in first:
            move = self.moves.get(at | byte)
            if move is None:
                move = self._move(at >> 8, byte)
            if move >= 0:
                at = move
            else:
                at, ids = self.jumps[~move]
                out += ids
        if len(self.starts) >= self.max_states:
            self.starts.clear()
        found = self.starts[first] = at, tuple(out)
        return found

    def encode(self, data: bytes) -> array:
        """The ids of one match, as unsigned 32-bit integers."""
        if len(self.whats) > self.max_states:
            self._forget(_FIRST)
        first = data[:_START]
        at, ids = self.starts.get(first) or self._after(first)
        out, moves, jumps = array("I", ids), self.moves, self.jumps
        for i, byte in enumerate(data[_START:]):
            move = moves.get(at | byte)
            if move is None:
                if i & 0xFFF == 0xFFF and len(self.whats) > self.max_states:
                    # A very long match goes on from its own state among fresh ones.
                    at = self._forget(self.whats[at >> 8]) << 8
                    moves, jumps = self.moves, self.jumps
                move = self._move(at >> 8, byte)
            if move >= 0:
                at = move
            else:
                at, ids = jumps[~move]
                out.extend(ids)
        out.extend(self.ends[at >> 8])
        return out


class _Matches(dict):
    """Little-endian ids of the matches met lately: those since the last turn here, those of the turn before in ``older``."""

    def __init__(self, ranks: dict[bytes, int], params: BpeParams) -> None:
        super().__init__()
        self.ranks, self.transducer, self.most, self.older = ranks, Transducer(ranks, params.max_states), params.max_matches // 2, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            data = match.encode()
            whole = self.ranks.get(data)
            found = array("I", [whole]) if whole is not None else self.transducer.encode(data)
            if sys.byteorder == "big":
                found.byteswap()
            ids = found.tobytes()
        if len(match) <= 64:
            self[match] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


def stand_ins() -> dict[int, int]:
    """Code points that the tokenizer library takes for another class than ``regex`` does, as the two know Unicode versions of their own.

    Each is mapped to a character that ``regex`` puts into the library's class: a letter, a number, white space or none of them.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    out: dict[int, int] = {}
    for kind, stand_in in ((r"[^\s\p{L}\p{N}]", 0xE000), (r"\p{L}", 0x4E00), (r"\p{N}", 0xB9), (r"\s", 0xA0)):
        library = tiktoken.Encoding("classes", pat_str=kind + "+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        own = regex.compile(kind + "+")
        for at in range(0, len(every), 1 << 12):
            some = every[at : at + (1 << 12)]
            # What isn't matched is left out, so the ids are the bytes of the characters of this class.
            theirs, ours = bytes(library.encode_ordinary(some)).decode(), "".join(own.findall(some))
            if theirs != ours:
                out |= dict.fromkeys(map(ord, set(theirs).difference(ours)), stand_in)
    return out


def _any_of(points: list[int]) -> str:
    """A character class of ascending code points."""
    runs = np.split(np.array(points), np.flatnonzero(np.diff(points) > 1) + 1)
    return "[" + "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs) + "]"


class Encoder:
    """Encodes texts with one transducer; patterns may tell letters, numbers and white space apart, but no finer classes."""

    #: Longer texts are matched piece by piece, without a list of all matches.
    long_text = 1 << 20

    def __init__(self, params: BpeParams) -> None:
        import regex

        self.pattern = regex.compile(params.pattern)
        self.matches = _Matches(_ranks(params.ranks), params)
        self.stand_ins = stand_ins()
        unlike = sorted(self.stand_ins)
        self.unlike = re.compile(_any_of(unlike) if unlike else "(?!)")
        # Most texts have no character that comes so late.
        self.late = re.compile(f"[\\U{unlike[0]:08x}-\\U0010ffff]" if unlike else "(?!)")

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        self.matches.turn()
        shadow = text.translate(self.stand_ins) if not text.isascii() and self.late.search(text) and self.unlike.search(text) else text
        if len(text) <= self.long_text and shadow is text:
            return b"".join(map(self.matches.__getitem__, self.pattern.findall(text)))
        found, out = (text[m.start() : m.end()] for m in self.pattern.finditer(shadow)), []
        while some := b"".join(map(self.matches.__getitem__, islice(found, 1 << 14))):
            out.append(some)
            self.matches.turn()
        return b"".join(out)


def _leads() -> list[tuple[int, int, int]]:
    """For each first byte: how many bytes follow, and the bounds of the next one; -1 for bytes that begin no character."""
    out = [(0, 0, 0)] * 0x80 + [(-1, 0, 0)] * 0x42 + [(1, 0x80, 0xBF)] * 0x1E + [(2, 0x80, 0xBF)] * 0x10 + [(3, 0x80, 0xBF)] * 5 + [(-1, 0, 0)] * 11
    # Shortest forms only, no surrogates, nothing above the last code point.
    out[0xE0], out[0xED], out[0xF0], out[0xF4] = (2, 0xA0, 0xBF), (2, 0x80, 0x9F), (3, 0x90, 0xBF), (3, 0x80, 0x8F)
    return out


_LEADS = _leads()


class Utf8Machine:
    """Text from bytes that come in parts of any length: a character that a part leaves open waits for the next part.

    What is no UTF-8 becomes U+FFFD, one for each longest piece that begins like a character; ``broken`` counts them.
    """

    def __init__(self) -> None:
        self.part, self.left, self.low, self.high, self.broken = b"", 0, 0, 0, 0

    def _step(self, byte: int) -> str:
        out = ""
        if self.left:
            if self.low <= byte <= self.high:
                self.part += bytes([byte])
                self.left, self.low, self.high = self.left - 1, 0x80, 0xBF
                return "" if self.left else self.part.decode()
            out, self.left, self.broken = "�", 0, self.broken + 1
        self.left, self.low, self.high = _LEADS[byte]
        if self.left < 0:
            self.left, self.broken = 0, self.broken + 1
            return out + "�"
        self.part = bytes([byte])
        return out if self.left else out + chr(byte)

    def feed(self, data: bytes) -> str:
        at, out = 0, []
        while self.left and at < len(data):
            out.append(self._step(data[at]))
            at += 1
        # Up to the last first byte that still waits, no state is needed.
        whole = len(data)
        for back in range(1, min(3, len(data) - at) + 1):
            if data[-back] >= 0xC0:
                whole = len(data) - back if _LEADS[data[-back]][0] >= back else whole
                break
        body = data[at:whole]
        text = body.decode("utf-8", "replace")
        self.broken += text.count("�") - body.count(b"\xef\xbf\xbd")
        out.append(text)
        out += map(self._step, data[whole:])
        return "".join(out)

    def finish(self) -> str:
        out, self.broken = ("�", self.broken + 1) if self.left else ("", self.broken)
        self.left = 0
        return out


class Decoder:
    def __init__(self, params: BpeParams) -> None:
        ranks = _ranks(params.ranks)
        self.tokens, self.step = {rank: token for token, rank in ranks.items()}, params.step_ids

    def decode(self, ids: np.ndarray) -> tuple[str, int]:
        """``(text, broken)``; an id that the vocabulary doesn't have raises an error."""
        machine = Utf8Machine()
        parts = [machine.feed(b"".join(map(self.tokens.__getitem__, ids[i : i + self.step].tolist()))) for i in range(0, len(ids), self.step)]
        return "".join(parts) + machine.finish(), machine.broken


@lru_cache(maxsize=1)
def _encoder(params: BpeParams) -> Encoder:
    """One for all tasks of a Python worker; the file mustn't change meanwhile."""
    return Encoder(params)


@lru_cache(maxsize=1)
def _decoder(params: BpeParams) -> Decoder:
    return Decoder(params)


def _encoded(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for piece in B.slices(batch):
        ids = [encoder.encode(text) for text in piece.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
        )


def _decoded(decoder: Decoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for piece in B.slices(batch, "ids"):
        found = [decoder.decode(np.frombuffer(ids or b"", "<u4")) for ids in piece.column("ids").to_pylist()]
        texts, broken = [x for x, _ in found], [n for _, n in found]
        yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string()), pa.array(broken, pa.int64())], [*piece.schema.names, "text", "broken"])


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


_ENCODED = "doc_id long, n_tokens long, ids binary"
_DECODED = f"{_ENCODED}, text string, broken long"


def encode_bpe(docs: DataFrame, params: BpeParams) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of ``docs(doc_id, text)``, one row a row; ``ids`` are little-endian unsigned 32-bit integers.

    Nothing is shuffled: a row is encoded where it is read, and a lost task is done again from its input. Null
    and empty texts have no ids. Very long texts are matched piece by piece. Repeated rows and null doc_ids give a row each;
    other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(params)
        for batch in batches:
            yield from _encoded(encoder, batch)

    return _slim(docs).mapInArrow(run, _ENCODED)


def decode_bpe(encoded: DataFrame, params: BpeParams) -> DataFrame:
    """``(doc_id, n_tokens, ids, text, broken)`` of rows of ``encode_bpe``: the text that the ids stand for.

    Bytes that are no UTF-8 become U+FFFD and are counted in ``broken``; null ids count as none. An id outside the vocabulary raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(params)
        for batch in batches:
            yield from _decoded(decoder, batch)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, _DECODED)


def bpe_round_trip(docs: DataFrame, params: BpeParams) -> DataFrame:
    """``decode_bpe(encode_bpe(docs))`` in one pass: a task has one Python worker that does both, so an executor holds half as many machines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(params), _decoder(params)
        for batch in batches:
            for ids in _encoded(encoder, batch):
                yield from _decoded(decoder, ids)

    return _slim(docs).mapInArrow(run, _DECODED)
