"""Fill-in-middle texts, assembled by a secondary sort.

A unit is a run of ASCII letters or one other code point. The digest of a document's id gives two
cut points and a form. Every text leaves its task as pieces of at most ``UNITS`` units, keyed by
(row, output position). One repartition by row with a sort inside the partitions (the DataFrame form
of repartitionAndSortWithinPartitions) brings the pieces of an output side by side, and they stream
into an incremental digest, one piece at a time. What streams past is also parsed again: the
markers in the output say where each part belongs, so that its bytes leave with their original
position. A second sort inside the same partitions, without a shuffle, streams the restored text
into its own digest. No step holds more than a batch of pieces, whatever the length of the text.

A text that holds a marker is left plain, so the markers of an output are unambiguous; two of them
can't overlap, as none ends with what another starts with.

Cases: a null text counts as empty and is plain with n = 0; a null id counts as an empty number;
texts of any length, also one unit of many megabytes, travel in pieces of at most ``BYTES`` bytes;
equal rows give equal rows; an empty table gives an empty result; other columns are ignored. Rows are
told apart by a number given while reading, so the input has to be re-readable in the same order, as
files and stored tables are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import ROWS_AT_ONCE, utf8

#: Units and bytes of a piece at most.
UNITS = 1024
BYTES = 1 << 13
#: Bytes looked at together while units are counted.
BLOCK = 1 << 20
#: Bytes that a step hands on together, about.
HANDED = 1 << 21

# The markers, the order of the parts in an output, and the shares of the forms.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
CHANGED, SPM = 90, 20
#: Where each part stands in the original text.
RANK = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
MARKER = 3

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def unit_starts(codes: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places in [low, high) of UTF-8 bytes where a unit starts."""
    part = codes[max(low - 1, 0) : high]
    letter = _LETTER[part]
    starts = (part & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    if low:
        starts = starts[1:]
    elif len(starts):
        starts[0] = True
    return np.flatnonzero(starts) + low


class Units:
    """Number and places of a text's units, counted block by block."""

    def __init__(self, data: bytes) -> None:
        self.codes = np.frombuffer(data, dtype=np.uint8)
        counts = [len(unit_starts(self.codes, at, at + BLOCK)) for at in range(0, len(data), BLOCK)]
        self.before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.n = int(self.before[-1])

    def place(self, unit: int) -> int:
        """The byte where a unit starts; the end of the text for the unit after the last."""
        if unit >= self.n:
            return len(self.codes)
        block = int(np.searchsorted(self.before, unit, "right")) - 1
        return int(unit_starts(self.codes, block * BLOCK, (block + 1) * BLOCK)[unit - self.before[block]])

    def chars(self, low: int, high: int) -> int:
        """Code points of the bytes [low, high)."""
        return sum(
            int(np.count_nonzero((self.codes[at : min(at + BLOCK, high)] & 0xC0) != 0x80)) for at in range(low, high, BLOCK)
        )

    def cuts(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """[low, high) as pieces of at most UNITS units and BYTES bytes."""
        for block in range(low, high, BLOCK):
            stop = min(block + BLOCK, high)
            edges = unit_starts(self.codes, block, stop)[UNITS::UNITS].tolist()
            for a, b in zip([block, *edges], [*edges, stop]):
                for at in range(a, b, BYTES):
                    yield at, min(at + BYTES, b)


def plan(id: object, data: bytes) -> tuple[int, str, int, int, Units]:
    """(n, form, end of the prefix, end of the middle, units) of a text; ends are places of bytes."""
    units = Units(data)
    digest = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not data or any(mark in data for mark in RANK) or h3 % 100 >= CHANGED:
        return units.n, "plain", 0, 0, units
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    return units.n, "spm" if h4 % 100 < SPM else "psm", units.place(first), units.place(second), units


def output_pieces(data: bytes, form: str, first: int, second: int, units: Units) -> Iterator[bytes]:
    """The output of a text, piece by piece and in order; there is at least one piece."""
    if form == "plain":
        yield from (data[a:b] for a, b in units.cuts(0, len(data))) if data else (b"",)
        return
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(data))}
    for mark in ORDERS[form]:
        head = mark
        for a, b in units.cuts(*spans[mark]):
            yield head + data[a:b]
            head = b""
        if head:
            yield head


class Restorer:
    """Reads an output as a stream and says where in the original text its bytes belong."""

    def __init__(self, form: str) -> None:
        self.marks = list(ORDERS.get(form, ()))
        self.rank = 0
        self.rest = b""

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        """(rank of the part, bytes). Two bytes stay back while a marker may follow."""
        data = self.rest + data
        while self.marks:
            at = data.find(self.marks[0])
            if at < 0:
                break
            if at:
                yield self.rank, data[:at]
            self.rank = RANK[self.marks.pop(0)]
            data = data[at + MARKER :]
        held = MARKER - 1 if self.marks else 0
        sure = max(len(data) - held, 0)
        self.rest = data[sure:]
        if sure:
            yield self.rank, data[:sure]

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.rest:
            yield self.rank, self.rest


class _Rows:
    """Columns of rows to hand on, in batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self._clear()

    def _clear(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, size: int) -> bool:
        """Whether it is time to take a batch."""
        self.rows.append(row)
        self.bytes += size
        return self.bytes >= HANDED or len(self.rows) >= 64 * ROWS_AT_ONCE

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * len(self.schema)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self._clear()
        return batch


_HEAD = "n long, form string, prefix_chars long, middle_chars long"
_HEAD_ARROW = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def arranged(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all outputs: (row, place, id, n, form, prefix_chars, middle_chars, data).

    A row's pieces stand together and in order, one after the other in one partition. What is known
    of the document stands in its first piece only.
    """
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), utf8(text).alias("data"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if out is None:
                out = _Rows(pa.schema([("row", pa.int64()), ("place", pa.int64()), ("id", batch.schema.field(1).type), *_HEAD_ARROW, ("data", pa.binary())]))
            for row, key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_py()
                n, form, first, second, units = plan(key, data)
                chars = (None, None) if form == "plain" else (units.chars(0, first), units.chars(first, second))
                head = (key, n, form, *chars)
                for place, piece in enumerate(output_pieces(data, form, first, second, units)):
                    if out.add((row, place, *head, piece), len(piece)):
                        yield out.take()
                    head = (None,) * len(head)
        if out is not None and out.rows:
            yield out.take()

    pieces = rows.mapInArrow(cut, f"row long, place long, id {kind}, {_HEAD}, data binary")
    return pieces.repartition("row").sortWithinPartitions("row", "place")


def restorable(pieces: DataFrame) -> DataFrame:
    """Streams the outputs into digests and sorts their bytes back.

    (row, rank, place, id, n, form, prefix_chars, middle_chars, output_sha256, data): a row's first
    piece (rank -1) holds what is known of the document, the others its text in the original order.
    """
    kind = pieces.schema["id"].dataType.simpleString()

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = current = None
        head, digest, restorer, place = (), hashlib.sha256(), Restorer("plain"), 0

        def closing() -> Iterator[tuple]:
            nothing = (None,) * (len(head) + 1)
            for rank, data in restorer.end():
                yield (current, rank, place, *nothing, data)
            yield (current, -1, 0, *head, digest.hexdigest(), b"")

        for batch in batches:
            if out is None:
                fields = [("row", pa.int64()), ("rank", pa.int32()), ("place", pa.int64()), ("id", batch.schema.field(2).type)]
                out = _Rows(pa.schema([*fields, *_HEAD_ARROW, ("output_sha256", pa.string()), ("data", pa.binary())]))
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                row, data = values[0], values[-1]
                if row != current:
                    if current is not None:
                        for closed in closing():
                            if out.add(closed, len(closed[-1])):
                                yield out.take()
                    current, head, digest, place = row, values[2:-1], hashlib.sha256(), 0
                    restorer = Restorer(head[2])
                digest.update(data)
                for rank, part in restorer.feed(data):
                    if out.add((row, rank, place, *(None,) * (len(head) + 1), part), len(part)):
                        yield out.take()
                    place += 1
        if current is not None:
            for closed in closing():
                out.add(closed, len(closed[-1]))
        if out is not None and out.rows:
            yield out.take()

    schema = f"row long, rank int, place long, id {kind}, {_HEAD}, output_sha256 string, data binary"
    return pieces.mapInArrow(stream, schema).sortWithinPartitions("row", "rank", "place")


def digests(pieces: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of arranged pieces.

    The second digest is that of the text rebuilt from the output and its form alone.
    """
    kind = pieces.schema["id"].dataType.simpleString()

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, digest = None, None, hashlib.sha256()
        for batch in batches:
            if out is None:
                fields = [(id, batch.schema.field(3).type), *_HEAD_ARROW, ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
                out = _Rows(pa.schema(fields))
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                if values[1] == -1:
                    if head is not None and out.add((*head, digest.hexdigest()), 256):
                        yield out.take()
                    head, digest = values[3:-1], hashlib.sha256()
                else:
                    digest.update(values[-1])
        if head is not None:
            out.add((*head, digest.hexdigest()), 256)
        if out is not None and out.rows:
            yield out.take()

    schema = f"`{id}` {kind}, {_HEAD}, output_sha256 string, restored_sha256 string"
    return restorable(pieces).mapInArrow(stream, schema)


def outputs(pieces: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of arranged pieces, for writing.

    One output at a time is put together, as a row of a table has to hold it whole.
    """
    kind = pieces.schema["id"].dataType.simpleString()

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, head, parts = None, None, (), []
        text = lambda: b"".join(parts).decode("utf-8", "replace")
        for batch in batches:
            if out is None:
                out = _Rows(pa.schema([(id, batch.schema.field(2).type), *_HEAD_ARROW, ("output", pa.string())]))
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                if values[0] != current:
                    if current is not None and out.add((*head, text()), sum(map(len, parts))):
                        yield out.take()
                    current, head, parts = values[0], values[2:-1], []
                parts.append(values[-1])
        if current is not None:
            out.add((*head, text()), 0)
            yield out.take()

    return pieces.mapInArrow(stream, f"`{id}` {kind}, {_HEAD}, output string")


def restored(table: DataFrame, id: str = "doc_id", form: str = "form", output: str = "output") -> DataFrame:
    """(id, text): the original texts of rows that hold an output and its form."""
    kind = table.schema[id].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for shape, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                restorer, parts = Restorer(shape), ([], [], [])
                for rank, part in [*restorer.feed(data), *restorer.end()]:
                    parts[rank].append(part)
                texts.append(b"".join(part for rank in parts for part in rank).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({id: batch.column(0), "text": pa.array(texts, pa.string())})

    return table.select(F.col(id), F.col(form), utf8(output)).mapInArrow(work, f"`{id}` {kind}, text string")
