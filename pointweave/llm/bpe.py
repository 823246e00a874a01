"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

Encoding of one match of the split pattern.  A token sequence is the BPE encoding of its bytes exactly if
each neighbouring pair is the encoding of the pair's own bytes.  This gives a non-deterministic transducer: a
hypothesis is (last token, trie node of the token being read).  A byte either extends the node or first closes
the token there, if it may follow the last one.  The subset construction is done lazily: a state is the set of
live hypotheses with the tokens that each has not yet emitted; what all of them share is emitted at once, so
output lags by a bounded lookahead.  States and transitions are kept in a table of bounded size that starts
anew when full, which changes time and never results.

Defined results
    * null text: encoded as the empty text: no tokens, digests of nothing.
    * very long matches: one step for each byte, whatever the length.
    * repeated rows: each row gets its own result.  Empty input: no rows.  Extra columns are not read.
    * undecodable bytes (only from ids that no text gives): U+FFFD, as Python's ``errors="replace"``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of each memory that an encoder keeps (states, pairs, matches, chunks).
MEMORY = 600_000
#: Longest chunk of text whose result is remembered.
REMEMBERED = 48


class Memory(dict):
    """Remembers the results of a function of strings, in two generations of at most ``entries``."""

    def __init__(self, function: Callable, entries: int, longest: int = 48):
        super().__init__()
        self.function, self.entries, self.longest, self.older = function, entries, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key, self)
        if value is self:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Transducer:
    """Encodes byte strings by ranks; one instance serves a Python worker for its lifetime."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {v: k for k, v in ranks.items()}
        # trie: node -> child by byte; node -> token that ends there, if that token encodes itself
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                at = self.child[node].get(b)
                if at is None:
                    at = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = at
            self.ends[node] = rank
        self.itself: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((-1, 0, ()),)
        self.states: list[tuple] = [start]  # the hypotheses of a state
        self.number: dict[tuple, int] = {start: 0}
        self.moves: dict[int, tuple[tuple[int, ...], int]] = {}  # by 256 * state + byte

    def merge(self, piece: bytes, stop: int = 1) -> list[int]:
        """The encoding by repeated lowest-rank merges, down to ``stop`` parts: the definition."""
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joined = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while len(joined) >= stop and (best := min(joined)) < none:
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(joined):
                joined[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge is the last one within a token; of a single byte the token twice."""
        known = self.halves.get(token)
        if known is None:
            piece, known = self.token_bytes[token], (token, token)
            if len(piece) > 1:
                two = self.merge(piece, stop=2)
                known = (two[0], two[1]) if len(two) == 2 else (-1, -1)  # -1: its merges do not lead to it
            self.halves[token] = known
        return known

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether the merges of both tokens' bytes end in just these tokens.

        Each token is undone from its last merge on, the younger merge first.  The pair holds unless two
        tokens that touch at the border would merge before the merges that keep them apart.
        """
        own = self.itself.get(token)
        if own is None:
            own = self.itself[token] = self.merge(self.token_bytes[token]) == [token]
        if last >= 0 and own:
            left, right, limit = last, token, 1 << 60
            while True:
                joined = self.ranks.get(self.token_bytes[left] + self.token_bytes[right])
                if joined is not None and joined < limit:
                    own = False
                    break
                a, b = self._halves(left)[1], self._halves(right)[0]
                if a != left and (left > right or b == right):
                    limit, left = left, a
                elif b != right:
                    limit, right = right + 1, b
                else:
                    break
        if len(self.pairs) >= 2 * MEMORY:
            self.pairs.clear()
        self.pairs[last << 32 | token] = own
        return own

    def _move(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        live: dict[tuple[int, int], tuple[int, ...]] = {}
        child, ends, pairs, first = self.child, self.ends, self.pairs, self.child[0].get(byte)
        for last, node, pending in self.states[state]:
            further = child[node].get(byte)
            if further is not None:
                live[last, further] = pending
            token = ends[node]
            if token >= 0 and first is not None:
                follows = pairs.get(last << 32 | token)
                if self._may_follow(last, token) if follows is None else follows:
                    live[token, first] = (*pending, token)
        if len(live) == 1:  # one hypothesis: all its tokens are certain
            ((last, node), emitted), = live.items()
            after = ((last, node, ()),)
        else:
            n = 0
            for column in zip(*live.values(), strict=False):
                if len(set(column)) > 1:
                    break
                n += 1
            emitted = next(iter(live.values()), ())[:n]
            after = tuple(sorted([(last, node, out[n:]) for (last, node), out in live.items()]))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        return emitted, number

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) >= MEMORY:
            self._forget()
        moves, state, out = self.moves, 0, []
        for byte in piece:
            at = state << 8 | byte
            step = moves.get(at)
            if step is None:
                step = moves[at] = self._move(state, byte)
            emitted, state = step
            if emitted:
                out += emitted
        ended = []
        for last, node, pending in self.states[state]:
            token = self.ends[node]
            if token >= 0:
                follows = self.pairs.get(last << 32 | token)
                if self._may_follow(last, token) if follows is None else follows:
                    ended.append((*pending, token))
        if len(ended) != 1:
            raise ValueError(f"the ranks give {len(ended)} encodings of {piece!r}")
        out += ended[0]
        return out


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any portions, gives the text that is complete so far."""

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many last bytes begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:  # a continuation byte: look further back
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            if need <= back:
                return 0
            if back >= 2:  # the second byte has tighter bounds after some first bytes
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        keep = self.open_tail(data)
        self.rest = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


class Tokenizer:
    """Text to ids and back, for a rank file and a split pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.of_match = Memory(self._ids, MEMORY, REMEMBERED)
        self.of_chunk = Memory(self._chunk, MEMORY, REMEMBERED)
        self.bytes_of = {str(v): k for k, v in ranks.items()}

    def _matches(self, text: str) -> str:
        return ",".join(map(self.of_match.__getitem__, self.pattern.findall(text)))

    def _chunk(self, chunk: str) -> str | None:
        """Ids of a space and a chunk; None where the space may belong to a longer run of white space."""
        if not chunk or chunk != chunk.strip():
            return None
        found = self.pattern.findall(" " + chunk)
        if len(found) == 1:  # the chunk's own entry remembers it
            return self.of_match.get(found[0]) or self._ids(found[0])
        return ",".join(map(self.of_match.__getitem__, found))

    def _ids(self, match: str) -> str:
        return ",".join(map(str, self.transducer.encode(match.encode("utf-8", "surrogatepass"))))

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas.

        A single space between two other characters always begins a match, so most texts are put together from
        remembered chunks; a text with other spacing is matched as a whole.
        """
        first, *rest = text.split(" ")
        if rest and first and first == first.strip():
            ids = list(map(self.of_chunk.__getitem__, rest))
            if None not in ids:
                return ",".join([self._matches(first), *ids])
        return self._matches(text)

    def decode(self, ids: Iterable[str], block: int = 8192) -> Iterator[str]:
        """The text of ids, in portions, each complete in itself."""
        machine, waiting = Utf8Machine(), list(ids)
        for i in range(0, len(waiting), block):
            yield machine.feed(b"".join(map(self.bytes_of.__getitem__, waiting[i : i + block])))
        yield machine.close()


@functools.lru_cache(maxsize=2)
def tokenizer(rank_file: str, pattern: str) -> Tokenizer:
    """One tokenizer for a Python worker, kept between its tasks."""
    return Tokenizer(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, decimal and joined by commas."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(rank_file, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.large_string())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids string")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids, and digests both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(rank_file, pattern)
        for b in batches:
            counts, ids_hex, text_hex = [], [], []
            for t in b.column(1):
                ids = own.encode(t.as_py() or "")
                decoded = hashlib.sha256()
                listed = ids.split(",") if ids else []
                for portion in own.decode(listed):
                    decoded.update(portion.encode())
                counts.append(len(listed))
                ids_hex.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hex.append(decoded.hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
