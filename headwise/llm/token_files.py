"""Token ids in compressed binary blocks: a static range asymmetric numeral system with interleaved lanes.

Documents are ordered by doc_id over all files (a range shuffle), tokenized, and cut into blocks of whole documents. The
frequencies of all ids make one table, shared by all blocks. Each block is encoded and decoded on its own: ids are dealt
in turn to `LANES` coder states, so one step works on a vector of lanes. A block is

    header      magic "HWT1", ids, documents, lanes, checkpoint interval, crc32 of the ids, crc32 of what follows
    lengths     ids of each document, 32 bits each
    states      of all lanes before the first step and before every checkpoint, 64 bits each
    offsets     into the stream at these places, 32 bits each
    stream      32-bit words in the order in which decoding reads them

all little-endian. Decoding can begin at any checkpoint (`decode_from`), and fails if a checksum differs. Blocks are
rows of Parquet files with their place in the order, beside the frequency table; `read` needs only these files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwise.llm import storage, training

#: Slots of the frequency table are 2 ** PRECISION; every id of the vocabulary has one at least.
PRECISION = 20
LANES = 2048
#: Steps between checkpoints, and ids of a block (a longer document is a block of its own).
INTERVAL, BLOCK_IDS = 64, 1 << 18
END_ID = 1
MAGIC = b"HWT1"
_HEADER = struct.Struct("<4s6I")
_LOW = np.uint64(1 << 31)
_P, _WORD = np.uint64(PRECISION), np.uint64(32)


def normalised(counts: np.ndarray) -> np.ndarray:
    """Slots of each id in proportion to its count, 2 ** PRECISION in all, none without."""
    size, slots = len(counts), 1 << PRECISION
    share = 1 + np.floor(counts / max(counts.sum(), 1) * (slots - size)).astype(np.int64)
    share[int(np.argmax(counts))] += slots - share.sum()
    return share


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, slots: np.ndarray):
        self.freq = slots.astype(np.uint64)
        self.start = (np.cumsum(slots) - slots).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(slots), dtype=np.uint32), slots)

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> bytes:
        steps = -(-len(ids) // LANES)
        x = np.full(LANES, _LOW, np.uint64)
        words: list[np.ndarray] = []
        states, sizes = [], []
        written = 0
        for step in range(steps - 1, -1, -1):
            part = ids[step * LANES : (step + 1) * LANES]
            freq, start, lane = self.freq[part], self.start[part], x[: len(part)]
            full = lane >= freq << np.uint64(63 - PRECISION)
            out = lane[full]
            words.append(out.astype("<u4"))
            written += len(out)
            lane[full] = out >> _WORD
            quotient = lane // freq
            x[: len(part)] = (quotient << _P) + (lane - quotient * freq) + start
            if step % INTERVAL == 0:
                states.append(x.copy())
                sizes.append(written)
        states.reverse()
        offsets = written - np.array(sizes[::-1], np.int64)
        body = b"".join(
            [lengths.astype("<u4").tobytes(), *[s.astype("<u8").tobytes() for s in states], offsets.astype("<u4").tobytes()]
            + [w.tobytes() for w in reversed(words)]
        )
        head = (len(ids), len(lengths), LANES, INTERVAL, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
        return _HEADER.pack(MAGIC, *head) + body

    def decode(self, block: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and the lengths of its documents; raises if a checksum differs."""
        n, docs, _, _, ids_crc, body_crc = _checked(block)
        if zlib.crc32(memoryview(block)[_HEADER.size :]) != body_crc:
            raise ValueError("the block is damaged")
        ids = self.decode_from(block, 0)
        if len(ids) != n or zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("the block was written with another frequency table")
        return ids, np.frombuffer(block, "<u4", docs, _HEADER.size).astype(np.int64)

    def decode_from(self, block: bytes, checkpoint: int) -> np.ndarray:
        """The ids from a checkpoint on: those from checkpoint * lanes * interval."""
        n, docs, lanes, interval, _, _ = _checked(block)
        steps = -(-n // lanes)
        points = -(-steps // interval)
        if checkpoint >= points:
            return np.zeros(0, np.uint32)
        at = _HEADER.size + 4 * docs
        x = np.frombuffer(block, "<u8", lanes, at + 8 * lanes * checkpoint).astype(np.uint64)
        at += 8 * lanes * points
        place = int(np.frombuffer(block, "<u4", points, at)[checkpoint])
        stream = np.frombuffer(block, "<u4", -1, at + 4 * points)
        first = checkpoint * interval
        ids = np.empty(n - first * lanes, np.uint32)
        mask = np.uint64((1 << PRECISION) - 1)
        for step in range(first, steps):
            part = ids[(step - first) * lanes : (step - first + 1) * lanes]
            lane = x[: len(part)]
            slot = lane & mask
            found = self.symbol[slot]
            part[:] = found
            lane[:] = self.freq[found] * (lane >> _P) + slot - self.start[found]
            short = np.flatnonzero(lane < _LOW)
            lane[short] = lane[short] << _WORD | stream[place : place + len(short)]
            place += len(short)
        return ids


def _checked(block: bytes) -> tuple:
    magic, *head = _HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    return tuple(head)


#: What a tokenizer must do to texts before its merges for these to be cut into pieces.
_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MATCHES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _MATCHES}, "behavior": "Removed", "invert": True}
#: Kinds of characters. Two neighbours stay in one piece if the first's upper half shares a bit with the other's lower half.
SPACE, LETTER, SIGN, APOSTROPHE, DIGIT, OPEN = 0x00, 0x11, 0x22, 0x32, 0x84, 0xFF
_GAP = re.compile("[ \n]")


def _starters() -> Iterator[str]:
    """Assigned characters of some European scripts that never combine with one before them."""
    block = [chr(c) for c in (*range(0x590), *range(0x2010, 0x2028))]
    return (c for c in block if not unicodedata.combining(c) and unicodedata.category(c) != "Cn")


class Tokenizer:
    """Ids of whole texts, by the tokenizers library.

    This tokenizer's matches are runs of letters, single digits, runs of signs, and some letters after an apostrophe. So
    no token reaches over a change of kind except behind an apostrophe, and a text's ids are those of the pieces between
    such places, one after another. What the library itself tells about single characters says where a text can be cut
    and which letters are alike; a character that it wasn't asked about, and one before it, are never cut off or changed.
    The pieces of many texts are named by Arrow; those not seen before go to the library in groups. Texts with a special
    token are encoded whole, as are all texts by a tokenizer that is set up otherwise.
    """

    MEMO, GROUP = 300_000, 500
    #: Characters of texts that are cut at once.
    TOGETHER = 1 << 20

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Library.from_file(path)
        self.size = max(self.library.get_vocab_size(), END_ID + 1)
        self.memo = training.Memo(self.MEMO, self._ids)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.mark = self._mark()
        setup = json.loads(self.library.to_str())
        self.cuts = self._known(setup, ByteLevel.alphabet())
        if self.cuts:
            self._ask()
            spaces = {"type": "CharDelimiterSplit", "delimiter": " "}
            setup |= {"normalizer": None, "added_tokens": [], "post_processor": None}
            setup["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [spaces, _BYTES]}
            #: The same merges for pieces that are one match each and normalised, with spaces between them.
            self.merges = Library.from_str(json.dumps(setup))
            suffix, vocab = setup["model"]["end_of_word_suffix"], setup["model"]["vocab"]
            self.closes = np.zeros(self.size, bool)
            self.closes[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            # Special tokens are looked for before anything is changed, so no piece may turn into one.
            self.cuts = all(len(self._pieces([x])[0]) > 1 for x in self.special)

    def _known(self, setup: dict, alphabet: list[str]) -> bool:
        """Whether the tokenizer is of the one kind that is cut into pieces."""
        model, before, split = setup["model"], setup["normalizer"] or {}, setup["pre_tokenizer"] or {}
        suffix = model.get("end_of_word_suffix")
        return (
            before.get("normalizers") == _NORMALIZER
            and split.get("pretokenizers") == [_SPLIT, _BYTES]
            and not any(setup[x] for x in ("truncation", "padding"))
            and not any(x["normalized"] for x in setup["added_tokens"])
            and (model["type"], model["dropout"], model["continuing_subword_prefix"]) == ("BPE", None, None)
            # The last token of every match ends with the suffix, and no other does: no match has signs and letters.
            and suffix == "</w>"
            and all(x + suffix in model["vocab"] for x in alphabet)
        )

    def _ask(self) -> None:
        """Kinds of single characters, by code unit, and what they are normalised to."""
        self.kind, self.lower = np.full(1 << 16, OPEN, np.uint8), np.arange(1 << 16, dtype="<u2")
        matches = lambda x: len(self.library.pre_tokenizer.pre_tokenize_str(x))
        normal = self.library.normalizer.normalize_str
        starters = set(_starters())
        single: dict[int, str] = {LETTER: "", SIGN: "", DIGIT: ""}
        for c in sorted(starters):
            x = normal(c)
            if x not in starters or normal(x) != x:
                continue
            alone = [k for k, n in ((LETTER, matches(f"a{x}a")), (SIGN, matches(f"!{x}!")), (DIGIT, matches(x * 2) - 1)) if n == 1]
            if not matches(x):
                self.kind[ord(c)] = SPACE
            elif c == "'":
                self.kind[ord(c)] = APOSTROPHE
            elif alone:
                self.kind[ord(c)] = alone[0]
            if alone and x == c:
                single[alone[0]] += c
            if alone:
                self.lower[ord(c)] = ord(x)
        letters, signs, digits = (re.escape(single[k]) for k in (LETTER, SIGN, DIGIT))
        self.one_match = re.compile(f"[{letters}]+|[{signs}]+|[{digits}]").fullmatch

    def _mark(self) -> tuple[str, int] | None:
        """A special token that can't run into what stands beside it, and its id."""
        special = self.library.get_added_tokens_decoder()
        names = [x.content for x in special.values()]
        for id_, x in special.items():
            first = x.content[:1]
            apart = not (x.lstrip or x.rstrip or x.single_word or x.normalized) and x.special
            alone = all(n[:1] == first and first not in n[1:] for n in names)
            if apart and alone and sum(n.startswith(x.content) for n in names) == 1:
                return x.content, id_
        return None

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, names: list[bytes]) -> list[bytes]:
        if not names:
            return []
        pieces = b"\n\0".join(names).decode("utf-16-le").split("\n")  # a line feed is a space
        plain = [x for x in pieces if self.one_match(x)]
        other = list(set(pieces).difference(plain))
        found = dict(zip(plain, self._grouped(plain, " ", self.merges), strict=True))
        if self.mark:
            found.update(zip(other, self._grouped(other, self.mark[0], self.library), strict=True))
        else:
            found.update(zip(other, self._each(other), strict=True))
        return [found[x] for x in pieces]

    def _grouped(self, pieces: list[str], between: str, library) -> list[bytes]:
        """Ids of pieces that are given to the library in groups, as one text each."""
        groups = [pieces[i : i + self.GROUP] for i in range(0, len(pieces), self.GROUP)]
        out: list[bytes] = []
        joined = library.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)
        for group, encoded in zip(groups, joined, strict=True):
            flat = np.array(encoded.ids, np.uint32)
            if library is self.merges:
                ends = np.flatnonzero(self.closes[flat]) + 1
                begins = np.append(0, ends[:-1])
            else:
                ends = np.append(np.flatnonzero(flat == self.mark[1]), len(flat))
                begins = np.append(0, ends[:-1] + 1)
            if len(ends) != len(group):  # the text itself has the mark
                out += self._each(group)
                continue
            data = flat.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return out

    def _pieces(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """All pieces, spaces left out, and how many there are up to the end of each text."""
        units = [x.encode("utf-16-le") for x in texts]
        text_ends = np.cumsum([len(x) // 2 + 1 for x in units])
        text = np.frombuffer(b" \0".join([*units, b""]), "<u2")
        kind = self.kind[text]
        kind[:-1][(kind[1:] == OPEN) & (kind[:-1] != SPACE)] = OPEN  # it may combine with what follows
        text = np.where(kind == OPEN, text, self.lower[text])
        inside = kind != SPACE
        starts = inside.copy()
        starts[1:] &= (kind[:-1] >> 4) & kind[1:] == 0
        kept = text[inside]
        offsets = 2 * np.append(np.flatnonzero(starts[inside]), len(kept))
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(kept)]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).dictionary_encode()
        return pieces, np.searchsorted(np.flatnonzero(starts), text_ends)

    def _encode_groups(self, groups: list[list[str]]) -> Iterator[np.ndarray]:
        cut = [self._pieces(x) for x in groups]
        named = pa.concat_arrays([x.dictionary for x, _ in cut]).dictionary_encode()
        found = self.memo.values(named.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), np.uint32)
        rows = named.indices.to_numpy()
        for pieces, text_ends in cut:
            own, rows = rows[: len(pieces.dictionary)], rows[len(pieces.dictionary) :]
            codes = own[pieces.indices.to_numpy()]
            n = sizes[codes]
            ends = np.cumsum(n)
            ids = pool[np.repeat(first[codes] - ends + n, n) + np.arange(n.sum())]
            yield from np.split(ids, np.append(0, ends)[text_ends[:-1]])

    def _parts(self, text: str) -> Iterator[str]:
        """A text; a long one in parts, cut at spaces or line feeds."""
        begin = 0
        while found := _GAP.search(text, begin + self.TOGETHER):
            yield text[begin : found.end()]
            begin = found.end()
        yield text[begin:]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, closed by END_ID."""
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        whole: list[int] = []
        owners: list[int] = []
        groups: list[list[str]] = []
        room = 0
        for i, text in enumerate(texts):
            if not self.cuts or any(x in (text or "") for x in self.special):
                whole.append(i)
                continue
            for part in self._parts(text or ""):
                if not groups or len(part) > room:
                    groups.append([])
                    room = self.TOGETHER
                groups[-1].append(part)
                owners.append(i)
                room -= len(part) + 1
        for i, own in zip(owners, self._encode_groups(groups) if groups else [], strict=True):
            ids[i].append(own)
        for i, own in zip(whole, self._each([texts[i] or "" for i in whole]), strict=True):
            ids[i].append(np.frombuffer(own, np.uint32))
        return [np.concatenate([*own, [END_ID]], dtype=np.uint32, casting="unsafe") for own in ids]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker, which keeps what it has looked up."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


_IDS = "part int, block int, offset long, n_ids long, doc_ids array<long>, lengths binary, ids binary"
_BLOCKS = "part int, block int, offset long, n_ids long, doc_ids array<long>, payload binary"


def _staged_type(size: int) -> str:
    """Of ids between the steps."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _tokenized(path: str):
    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, offset = TaskContext.get().partitionId(), 0, 0
        kind = _staged_type(tokenizer(path).size)
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        filled = 0

        def row() -> pd.DataFrame:
            flat, lengths = np.concatenate(ids), np.array([len(x) for x in ids], "<u4")
            values = (part, block, offset, len(flat), docs, lengths.tobytes(), flat.astype(kind).tobytes())
            return pd.DataFrame([values], columns=["part", "block", "offset", "n_ids", "doc_ids", "lengths", "ids"])

        for batch in batches:
            names = [None if x is None else int(x) for x in batch["doc_id"]]
            for name, own in zip(names, tokenizer(path).encode(batch["text"].tolist()), strict=True):
                if ids and filled + len(own) > BLOCK_IDS:
                    yield row()
                    block, offset = block + 1, offset + filled
                    ids, docs, filled = [], [], 0
                ids.append(own)
                docs.append(name)
                filled += len(own)
        if ids:
            yield row()

    return tokenize


def _counted(size: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                total += np.bincount(np.frombuffer(ids, _staged_type(size)), minlength=size)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"id": found.astype(np.int64), "n": total[found]})

    return count


def _encoded(slots: np.ndarray):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, kind = Coder(slots), _staged_type(len(slots))
        for batch in batches:
            payload = [
                coder.encode(np.frombuffer(ids, kind), np.frombuffer(lengths, "<u4"))
                for ids, lengths in zip(batch["ids"], batch["lengths"], strict=True)
            ]
            yield batch.drop(columns=["ids", "lengths"]).assign(payload=payload)

    return encode


def _decoded(slots: np.ndarray):
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(slots)
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, lengths = coder.decode(row.payload)
                ends = np.cumsum(lengths)
                flat = ids.astype("<u4").tobytes()
                yield pd.DataFrame(
                    {
                        "doc_id": [None if x is None or x != x else str(int(x)) for x in row.doc_ids],
                        "part": row.part,
                        "start": row.offset + ends - lengths,
                        "ids": [flat[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)],
                    }
                )

    return decode


def write(documents: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write the ids of all texts, in ascending order of doc_id, to `path`/blocks and their table to `path`/table.

    A null text is an empty one: it has END_ID alone. A null doc_id comes before all others; rows that share a doc_id
    are ordered by their texts' hashes, then texts. An empty table gives a table of frequencies and no block. Other
    columns are ignored.
    """
    spark = documents.sparkSession
    storage.small_batches(spark)
    size = tokenizer(tokenizer_path).size
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("text")]
    sorted_texts = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("hash"))
        .sortWithinPartitions(*order)
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    )
    ids = storage.staged(sorted_texts.mapInPandas(_tokenized(tokenizer_path), _IDS), "ids")
    found = ids.select("ids").mapInPandas(_counted(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for id_, n in found.collect():  # no more rows than the vocabulary has ids
        counts[id_] = n
    slots = normalised(counts)
    table = spark.createDataFrame(pd.DataFrame({"id": np.arange(size), "slots": slots}))
    table.coalesce(1).write.parquet(f"{path}/table")
    ids.mapInPandas(_encoded(slots), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    storage.drop(ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents back from the files alone: doc_id, start (ids of all documents before it), ids (32 bits each)."""
    table = spark.read.parquet(f"{path}/table").orderBy("id").toPandas()  # a row for each id of the vocabulary
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # One row for each partition that wrote; the ids before it are summed over these.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    docs = blocks.drop("n_ids", "block").mapInPandas(
        _decoded(table["slots"].to_numpy()), "doc_id string, part int, start long, ids binary"
    )
    placed = docs.join(F.broadcast(parts), "part")
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("before") + F.col("start")).alias("start"), "ids")
