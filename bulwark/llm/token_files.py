"""Token ids of a corpus as ORC files, and reading them back.

Format. A folder of ORC files. Rows stand in ascending order of the document's id, nulls first and
ties by a hash of the text, through all parts in turn. Columns:

* ``doc``: the document's id. Bloom filters and row indexes (least and largest value of every
  ``INDEXED`` rows) let a reader skip stripes and row groups that can't hold an id;
* ``part``: number of the part that holds the row, and ``at``: ids of the part before it. The ids
  before a part are the sum of the parts before, which a reader gets from the narrow columns;
* ``n_tokens``: ids of the document, with the end id;
* ``ids``: array of integers, written with ORC's integer run-length encoding.

A stripe has an index and a footer of its own, so that several tasks read one file by stripes.

Encoding. Documents are dealt into ranges of ids first, and each range is encoded and written as it
is sorted, so texts cross the network once and token ids not at all. The tokenizers library encodes.
It takes some 15 us for a word, so each distinct word is encoded once in a slice of texts and what it
gave is remembered. Where the vocabulary file drops white space between pieces and splits, lower-cases
and composes without regard to what stands beyond (``separable``), a text is the sequence of its
words. Words of ASCII and Latin-1 letters are lower-cased and cut into pieces here, by the file's own
rule, and the library's model merges the distinct pieces; all other words, and texts with combining
marks or what may be an added token, go through the whole library.

Cases: a null text is empty and has the end id alone; texts of any length; null ids come first and
are kept; repeated ids are kept, in the order of their texts' hashes; equal rows follow each other
and differ in ``start`` alone; an empty table writes no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bulwark.llm.common import utf8
from bulwark.session import scratch

#: Bytes of a stripe before it is compressed, and rows between two entries of its index.
STRIPE = 16 << 20
INDEXED = 1_000
#: Share of absent ids that a Bloom filter lets pass.
FALSE_PASSES = 0.01
#: Strings in a generation of a worker's memory.
CACHED = 150_000
#: Bytes of texts encoded together, and pieces given to the library together.
SLICE = 8 << 20
TOGETHER = 10_000
#: The id that ends every document.
END = 1
#: Files up to which the table of parts is broadcast.
BROADCAST_FILES = 100_000

PACKED = "<u4"
ID_BYTES = 4
# Fixed value: what the vocabulary file writes behind the last letter of a word.
WORD_END = "</w>"


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


# The rule by which the vocabulary file cuts normalised texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Lower-case letters of ASCII and Latin-1, and the same rule on them: a space behind each piece.
LOWER = r"a-z\x{df}-\x{f6}\x{f8}-\x{ff}"
PIECE = rf"('s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[0-9]|[^\s0-9{LOWER}]+)"
#: What words that the rule fits don't hold: all but ASCII signs, and letters from U+00C0.
FOREIGN = r"[^\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]"
#: Texts in which lower-casing before composing, or cutting at white space, could matter.
ODD = r"[\x{300}-\x{37f}]|<\|"


def separable(file: bytes) -> bool:
    """Whether a vocabulary file is one whose texts are the sequence of their words."""
    known = json.loads(file)
    steps = (known.get("normalizer") or {}).get("normalizers", [])
    splits = (known.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        known["model"]["type"] == "BPE"
        and known["model"]["end_of_word_suffix"] == WORD_END
        and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": SPLIT}
        and splits[0]["behavior"] == "Removed"
        and splits[0]["invert"]
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and all(t["content"].startswith("<|") for t in known["added_tokens"])
        and known["post_processor"] is None
    )


def _pieces_only(file: bytes) -> bytes:
    """The vocabulary file for pieces that are normalised and cut already, one space between them."""
    known = json.loads(file)
    known["normalizer"] = None
    known["pre_tokenizer"]["pretokenizers"][0] = {"type": "CharDelimiterSplit", "delimiter": " "}
    return json.dumps(known).encode()


class Memory:
    """What was found for the last strings: two generations of at most ``size`` each."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fill(self, wanted: dict[str, bytes | None]) -> list[str]:
        """Put what is known into ``wanted``; gives the strings that are not."""
        unknown = []
        for s in wanted:
            ids = self.young.get(s)
            if ids is None:
                ids = self.old.get(s)
                if ids is None:
                    unknown.append(s)
                    continue
                self.young[s] = ids
            wanted[s] = ids
        return unknown

    def keep(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
            if len(self.old) > 2 * self.size:
                self.old = {}


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Packed ids as lists."""
    sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // ID_BYTES
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.frombuffer(b"".join(packed), dtype=np.int32))


class Encoder:
    """The library's ids of whole texts."""

    def __init__(self, file: bytes, end: int = END) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = np.array([end], dtype=PACKED).tobytes()
        self.whole = not separable(file)
        if not self.whole:
            self.merger = Tokenizer.from_buffer(_pieces_only(file))
            ids = self.library.get_vocab()
            self.ends = np.zeros(max(ids.values()) + 1, dtype=bool)
            self.ends[[i for s, i in ids.items() if s.endswith(WORD_END)]] = True
            self.pieces, self.words = Memory(CACHED), Memory(CACHED)

    def _by_library(self, strings: list[str]) -> list[bytes]:
        found = self.library.encode_batch(strings, add_special_tokens=False)
        return [np.array(e.ids, dtype=PACKED).tobytes() for e in found]

    def _by_merger(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, which are told apart by the tokens that end a word; of no piece, none."""
        if "" in pieces:
            at = pieces.index("")
            return [*self._by_merger(pieces[:at]), b"", *self._by_merger(pieces[at + 1 :])]
        out: list[bytes] = []
        for start in range(0, len(pieces), TOGETHER):
            part = pieces[start : start + TOGETHER]
            ids = np.array(self.merger.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=PACKED)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(stops) != len(part):
                raise RuntimeError("a piece without an end of word")
            packed = ids.tobytes()
            out += [packed[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]
        return out

    def _known(self, strings: list[str], memory: Memory, ask) -> pa.ListArray:
        """Ids of distinct strings, from ``memory`` or else from the library."""
        wanted: dict[str, bytes | None] = dict.fromkeys(strings)
        unknown = memory.fill(wanted)
        found = dict(zip(unknown, ask(unknown)))
        memory.keep(found)
        wanted.update(found)
        return _lists(list(wanted.values()))

    def _of_words(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of distinct words whose ASCII letters are lower-case; the end's ids after the last."""
        foreign = pc.match_substring_regex(words, FOREIGN)
        spaced = pc.replace_substring_regex(pc.utf8_lower(words.filter(pc.invert(foreign))), PIECE, r"\1 ")
        cut = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(spaced))
        named = cut.values.dictionary_encode()
        of_piece = self._known(named.dictionary.to_pylist(), self.pieces, self._by_merger)
        of_place = of_piece.take(named.indices)
        of_plain = pa.ListArray.from_arrays(of_place.offsets.take(cut.offsets), of_place.values)
        of_foreign = self._known(words.filter(foreign).to_pylist(), self.words, self._by_library)
        table = pa.concat_arrays([of_plain, of_foreign, _lists([self.end])])
        first = np.argsort(foreign.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(words) + 1, dtype=np.int32)
        place[first], place[-1] = np.arange(len(words)), len(words)
        return table.take(pa.array(place))

    def _separated(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose words stand for themselves, each text with its end."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        named = words.values.dictionary_encode()
        table = self._of_words(named.dictionary)
        stops = words.offsets.to_numpy()
        stops = stops[1:] - stops[0]
        # Every text's words, then its end.
        order = np.insert(named.indices.to_numpy(), stops, len(table) - 1)
        found = table.take(pa.array(order))
        places = found.offsets.to_numpy()[np.concatenate(([0], stops + np.arange(1, len(stops) + 1)))]
        return np.diff(places).astype(np.int64), found.flatten().to_numpy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text with its end, all ids) of an array of UTF-8 bytes."""
        try:
            strings = texts.cast(pa.string())
        except pa.ArrowInvalid:
            strings = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
        odd = np.ones(len(strings), dtype=bool) if self.whole else pc.match_substring_regex(strings, ODD).to_numpy(zero_copy_only=False)
        runs = np.concatenate(([0], np.flatnonzero(np.diff(odd)) + 1, [len(odd)]))
        lengths, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for a, b in zip(runs[:-1], runs[1:]):
            if a == b:
                continue
            if odd[a]:
                packed = [p + self.end for p in self._by_library(strings.slice(a, b - a).to_pylist())]
                lengths.append(np.array([len(p) // ID_BYTES for p in packed], dtype=np.int64))
                ids.append(np.frombuffer(b"".join(packed), dtype=np.int32))
            else:
                some, flat = self._separated(strings.slice(a, b - a))
                lengths.append(some)
                ids.append(flat)
        return np.concatenate(lengths), np.concatenate(ids)


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(shared, end: int) -> Encoder:
    key = (hashlib.sha256(shared.value).hexdigest(), end)
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value, end)
    return _encoders[key]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of a batch in slices of about SLICE bytes, one text at least."""
    size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(total, total[start] - size[start] + SLICE, "right")))
        yield batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
        start = stop


def write(docs: DataFrame, path: str, file: str, id: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Encode ``docs`` with the vocabulary ``file`` and write the files into the folder ``path``."""
    with open(file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # 3.5 MB; fixed size
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("doc"), utf8(text).alias("data"))
    # Equal rows differ in the last key alone, so that any number of them spreads over ranges.
    keys = (F.col("doc").asc_nulls_first(), F.col("tie"), F.col("copy"))
    ranged = (
        rows.withColumn("tie", F.xxhash64("data")).withColumn("copy", F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc", "data")
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(shared, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, texts in _slices(batch):
                sizes, flat = encoder.encode(texts)
                starts = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc": ids,
                        "part": pa.array(np.full(len(sizes), part, dtype=np.int32)),
                        "at": pa.array(starts[:-1] + at),
                        "n_tokens": pa.array(sizes),
                        "ids": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat)),
                    }
                )
                at += int(starts[-1])

    schema = f"doc {kind}, part int, at long, n_tokens long, ids array<int>"
    (
        ranged.mapInArrow(encode, schema).write
        .option("orc.stripe.size", STRIPE)
        .option("orc.row.index.stride", INDEXED)
        .option("orc.bloom.filter.columns", "doc")
        .option("orc.bloom.filter.fpp", FALSE_PASSES)
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, n_tokens, ids) of the files; ``start`` is the number of ids before the document.

    Filters on ``doc`` reach the files' indexes and Bloom filters. The table of parts that gives the
    starts has one row per file and is read from the narrow columns.
    """
    files = spark.read.orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if len(files.inputFiles()) <= BROADCAST_FILES:  # one row of two numbers for each
        parts = F.broadcast(parts)
    return files.join(parts, "part").select("doc", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def look_up(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """(doc, n_tokens, ids) of some documents; stripes whose index or Bloom filter lacks them stay unread."""
    return spark.read.orc(path).where(F.col("doc").isin(ids)).select("doc", "n_tokens", "ids")


def checksums(table: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of rows as ``read`` gives them."""
    kind = table.schema["doc"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values = ids.values.to_numpy(zero_copy_only=False).astype(PACKED, copy=False)
            offsets = ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_pydict(
                {id: batch.column(0), "start": batch.column(1), "n_tokens": batch.column(2), "ids_crc32": pa.array(sums, pa.int64())}
            )

    schema = f"`{id}` {kind}, start long, n_tokens long, ids_crc32 long"
    return table.select("doc", "start", "n_tokens", "ids").mapInArrow(work, schema)


def round_trip(docs: DataFrame, file: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` into a new folder of the shared space, read the files back and digest them."""
    path = scratch(docs.sparkSession, "token-files")
    write(docs, path, file, id, text)
    return checksums(read(docs.sparkSession, path), id)
