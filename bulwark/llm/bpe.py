"""Byte-level BPE as a streaming transducer, and its inverse.

Encoding reads a text in windows of bounded size and cuts it into pieces (words with their space,
runs of digits, signs or white space). Every piece runs through a transducer that needs only the
merge list's sufficient lookahead; the tokens of short pieces are remembered. A token that covers the next byte starts at most ``lookahead`` bytes back (the longest
token's length), so only the encodings of the last ``lookahead`` prefixes can still matter. For
every prefix the last token is the one whose neighbour on the left is *stable* beside it, that
is, merging the two tokens' bytes together gives the two tokens again; it is unique. A token is
emitted once the encodings of all prefixes in the lookahead agree on it. Memory depends on the
merge list alone, not on the text.

Decoding feeds token bytes to an incremental UTF-8 state machine, which holds at most three bytes
between tokens and turns malformed bytes into U+FFFD.

Cases: a null text is encoded as empty (no tokens, empty text); texts of any length; added tokens
written in a text become their ids; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import mapped, utf8

#: Characters read at a time.
WINDOW = 1 << 16
#: Pieces whose tokens a worker remembers, and the bytes up to which it remembers one.
CACHED = 400_000
REMEMBERED = 256

#: Little-endian unsigned 32-bit integers.
PACKED = "<u4"
ID_BITS = 32
ID_MASK = (1 << ID_BITS) - 1
NEVER = 1 << 62


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


#: The split before merging: contractions, letters, numbers, other signs, white space.
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same for texts in ASCII.
_ASCII_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


class Merges(dict):
    """Vocabulary and merge list of a byte-level BPE file; as a dict, the packed tokens of pieces."""

    def __init__(self, file: bytes) -> None:
        super().__init__()
        spec = json.loads(file)
        byte_of = _byte_letters()
        vocab = spec["model"]["vocab"]

        def raw(token: str) -> bytes:
            return bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

        self.pieces: dict[int, bytes] = {i: raw(token) for token, i in vocab.items()}
        self.single = [vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        #: Of each pair: its rank in the high bits, the id of the joined token in the low ones.
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((vocab[left], vocab[right]), rank << ID_BITS | vocab[left + right])
        reachable = {*self.single, *(x & ID_MASK for x in self.merge.values())}
        self.token_of = {self.pieces[t]: t for t in reachable}
        #: Sufficient lookahead in bytes: no token is longer.
        self.lookahead = max(map(len, self.token_of))
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.pieces |= {i: token.encode() for token, i in self.added.items()}
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._beside: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Tokens of the bytes of one or two tokens: lowest-ranked pair first, from the left."""
        single, merge = self.single, self.merge.get
        tokens = [single[b] for b in data]
        ranks = [merge(pair, NEVER) for pair in zip(tokens, tokens[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            token = best & ID_MASK
            tokens[at] = token
            del tokens[at + 1], ranks[at]
            if at:
                ranks[at - 1] = merge((tokens[at - 1], token), NEVER)
            if at < len(ranks):
                ranks[at] = merge((token, tokens[at + 1]), NEVER)
        return tuple(tokens)

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are merged together."""
        pair = (left, right)
        known = self._beside.get(pair)
        if known is None:
            if len(self._beside) >= CACHED:
                self._beside.clear()
            known = self._beside[pair] = self.merged(self.pieces[left] + self.pieces[right]) == pair
        return known

    def alone(self, token: int) -> bool:
        """Whether the token's own bytes merge to it."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.merged(self.pieces[token]) == (token,)
        return known

    def in_view(self, data: bytes) -> list[int]:
        """Tokens of a piece no longer than the lookahead, by the same rule as ``streamed``.

        Nothing is stable before such a piece ends, and its end alone decides, so only the prefixes that
        the last tokens ask for are looked at.
        """
        token_at, alone, beside = self.token_of.get, self._alone, self._beside
        back: dict[int, tuple[int, int]] = {}

        def last(end: int) -> tuple[int, int]:
            for start in range(end):
                token = token_at(data[start:end])
                if token is None:
                    continue
                if start:
                    pair = ((back.get(start) or last(start))[0], token)
                    fits = beside.get(pair)
                    if fits is None:
                        fits = self.stable(*pair)
                else:
                    fits = alone.get(token)
                    if fits is None:
                        fits = self.alone(token)
                if fits:
                    back[end] = found = (token, start)
                    return found
            raise ValueError(f"no tokens for {data[:end]!r}")

        tokens, end = [], len(data)
        while end:
            token, end = back.get(end) or last(end)
            tokens.append(token)
        return tokens[::-1]

    def streamed(self, data: bytes) -> Iterator[int]:
        """Tokens of one piece of any length, each as soon as no later byte can change it.

        Only one last token fits a prefix, so the order of trying is free: the longest first.
        """
        size, token_at, stable, beside = self.lookahead, self.token_of.get, self.stable, self._beside
        if len(data) <= size:
            yield from self.in_view(data)
            return
        emitted, boundary = 0, -1  # what is out so far ends here, in all live encodings alike
        back: dict[int, tuple[int, int]] = {}  # of a prefix: its last token, where that starts
        live: deque = deque([0])

        def path(end: int) -> list[tuple[int, int]]:
            steps = []
            while end > emitted:
                token, start = back[end]
                steps.append((end, token))
                end = start
            return steps[::-1]

        for end in range(1, len(data) + 1):
            while end - live[0] > size:
                live.popleft()
            for start in live:
                token = token_at(data[start:end])
                if token is None:
                    continue
                if not start:
                    fits = self.alone(token)
                else:
                    left = back[start][0] if start in back else boundary
                    fits = beside.get((left, token))
                    if fits is None:
                        fits = stable(left, token)
                if fits:
                    back[end] = (token, start)
                    live.append(end)
                    break
            else:
                continue
            if len(back) >= 4 * size:
                common = path(live[0])
                for other in list(live)[1:]:
                    steps = path(other)
                    same = 0
                    while same < min(len(common), len(steps)) and common[same] == steps[same]:
                        same += 1
                    common = common[:same]
                if common:
                    yield from (token for _, token in common)
                    emitted, boundary = common[-1]
                    needed = {emitted}
                    for end_of in live:
                        while end_of > emitted and end_of not in needed:
                            needed.add(end_of)
                            end_of = back[end_of][1]
                    back = {e: link for e, link in back.items() if e in needed}
        yield from (token for _, token in path(len(data)))

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        tokens = array("I", self.streamed(data)).tobytes()
        if len(data) <= REMEMBERED:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = tokens
        return tokens

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed token ids of a text, window by window."""
        start = 0
        for found in self.split_added.finditer(text) if self.split_added else ():
            yield from self._plain(text, start, found.start())
            yield np.array([self.added[found[0]]], dtype=PACKED).tobytes()
            start = found.end()
        yield from self._plain(text, start, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        pattern = _ASCII_PIECES if text.isascii() else _PIECES
        tokens_of = self.__getitem__
        while start < end:
            cut = end if end - start <= WINDOW else _boundary(text, start, start + WINDOW)
            if cut > start:
                pieces = pattern.findall(text, start, cut)
            else:  # no boundary in the window: follow the pieces one by one until past it
                pieces, cut = [], start
                while cut < min(end, start + WINDOW):
                    found = pattern.match(text, cut, end)
                    pieces.append(found[0])
                    cut = found.end()
            yield b"".join(map(tokens_of, pieces))
            start = cut

    def decode(self, windows: Iterable[bytes]) -> Iterator[str]:
        """Text of packed token ids, window by window."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        bytes_of = self.pieces.__getitem__
        for packed in windows:
            yield machine.decode(b"".join(map(bytes_of, np.frombuffer(packed, dtype=PACKED).tolist())))
        yield machine.decode(b"", True)


def _boundary(text: str, start: int, stop: int) -> int:
    """The last place before ``stop`` where a piece surely starts: a lone space between signs."""
    at = text.rfind(" ", start + 1, stop)
    while at > start:
        if not text[at - 1].isspace() and at + 1 < len(text) and not text[at + 1].isspace():
            return at
        at = text.rfind(" ", start + 1, at)
    return start


_loaded: dict[str, Merges] = {}


def _merges(shared) -> Merges:
    """The merge list of a broadcast file, built once in a worker."""
    file = shared.value
    key = hashlib.sha256(file).hexdigest()
    if key not in _loaded:
        _loaded[key] = Merges(file)
    return _loaded[key]


def _broadcast(df: DataFrame, file: str):
    """The vocabulary file (1.5 MB; fixed size) for the executors, which need no copy of it."""
    with open(file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(
    docs: DataFrame, file: str, id: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """(id, n_tokens, ids): one row per row of ``docs``; ids are little-endian 32-bit integers.

    With ``decoded`` a column of that name holds the text that the ids decode to.
    """
    shared = _broadcast(docs, file)

    def work(batch: pa.RecordBatch) -> dict:
        merges = _merges(shared)
        packed, texts = [], []
        for data in batch.column(1).to_pylist():
            windows = list(merges.encode(data.decode("utf-8", "replace")))
            packed.append(b"".join(windows))
            if decoded:
                texts.append("".join(merges.decode(windows)))
        out = {id: batch.column(0), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()), "ids": pa.array(packed, pa.binary())}
        return out | ({"decoded": pa.array(texts, pa.string())} if decoded else {})

    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, n_tokens long, ids binary" + (", decoded string" if decoded else "")
    return mapped(docs.select(F.col(id), utf8(text).alias("_text")), work, schema)


def decode(tokens: DataFrame, file: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) of packed ids; null ids decode to the empty text."""
    shared = _broadcast(tokens, file)

    def work(batch: pa.RecordBatch) -> dict:
        merges = _merges(shared)
        texts = ["".join(merges.decode([p])) for p in batch.column(1).to_pylist()]
        return {id: batch.column(0), "text": pa.array(texts, pa.string())}

    kind = tokens.schema[id].dataType.simpleString()
    return mapped(tokens.select(F.col(id), F.coalesce(F.col(ids), F.lit(b"")).alias("_ids")), work, f"`{id}` {kind}, text string")


def digests(encoded: DataFrame, id: str = "doc_id") -> DataFrame:
    """SHA-256 of the packed ids and of the decoded text."""
    return encoded.select(
        id,
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
