"""Best-fit packing with certified bin counts.

Whole texts become token ids; documents longer than a sequence are cut, and the
rest is bin packing. Items are dealt to partitions, each packs its own by
best-fit decreasing and holds its bin count against lower bounds from dual
feasible functions (Fekete & Schepers, 2001). A partition whose count equals a
bound is certified. Partitions with a gap keep their full bins and
exchange the documents of all others, and certified ones those of their emptiest
bin; these are dealt anew among partitions and packed again, until an exchange
saves no bin. Partitions hold some PART items in every round, whatever the size
of the table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored

LENGTH = 1024
END = 2
#: Items of a partition, about; its columns take some 40 bytes an item.
PART = 10_000
#: Words an encoder remembers before it starts afresh.
MEMO = 300_000
#: Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_table() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of the vocabulary in a tokenizer's JSON file, as bytes of little-endian unsigned 32-bit integers.

    Text is encoded by space-separated words, which are remembered: a space
    after a character that is not white space always begins a new token. A text
    with other white space beside a space is encoded as a whole. The file's
    added tokens are cut out of a text first and give their own ids, as the
    file's tokenizer does by default.
    """

    def __init__(self, path: str):
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens") or ()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        table = byte_table()
        ranks = {bytes(table[c] for c in token): k for token, k in vocab.items() if all(c in table for c in token) and token != "<|endoftext|>"}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.beside = re.compile(r"\s ")
        encode = self.encode

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = encode(" " + word)
                if len(word) < 64:
                    self[word] = ids
                return ids

        self.words = Words()

    def encode(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return b"".join(self.added[part] if part in self.added else self.encode(part) for part in self.parts.split(text))
        first, *rest = text.split(" ")
        if not rest or not first or text[-1] == " " or self.beside.search(text):
            return self.encode(text)
        if len(self.words) > MEMO:
            self.words.clear()
        return self.encode(first) + b"".join(map(self.words.__getitem__, rest))


def cut(ids: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first of several may be short."""
    if ids <= length:
        return [(0, ids)]
    first = ids % length or length
    return [(0, first)] + [(at, length) for at in range(first, ids, length)]


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every whole text, null as empty, with the end id."""
    end = np.array([END], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for k, text in enumerate(batch.column(1)):
                ids = memoryview(encoder(text.as_py() or "") + end)
                for piece, (start, size) in enumerate(cut(len(ids) // 4, length)):
                    rows.append(k)
                    for column, value in zip(out, (piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tokenise, "id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray) -> int:
    """A lower bound on the bins for counts[s] items of each size s; the last index is the bin's size.

    The largest sum under the dual feasible functions U(eps), which lift sizes
    over 1 - eps to 1 and drop those under eps, and u(k) after U(eps).
    """
    size = len(counts) - 1
    x, n = np.arange(size + 1), counts.astype(object if counts.sum() > 2**40 else np.int64)
    best = -(-int((x * n).sum()) // size)
    for eps in range(0, size // 2 + 1):
        lifted = np.where(x > size - eps, size, np.where(x < eps, 0, x))
        best = max(best, -(-int((lifted * n).sum()) // size))
        if eps % 16 == 0:
            for k in (1, 2, 3, 4, 5, 7, 9):
                whole = (lifted * (k + 1)) % size == 0
                # u(k) in units of 1 / (size * k)
                unit = np.where(whole, lifted * k, (lifted * (k + 1) // size) * size)
                best = max(best, -(-int((unit * n).sum()) // (size * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the free room of each bin; the open bins are kept by their room."""
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    some, bins = 0, 0
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[int] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[k])
        if fitting := some >> s:
            r = s + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
        else:
            b, r = bins, length
            bins += 1
            room.append(length)
        bin_of[k], offset[k] = b, length - r
        room[b] = r - s
        if r > s:
            by_room[r - s].append(b)
            some |= 1 << (r - s)
    return bin_of, offset, np.array(room, np.int64)


def fitting(length: int, turn: int):
    """The function that packs one partition: which of its items are settled, and whether its count is certified."""

    def fit(key, table):
        sizes = table.column("length").to_numpy()
        bin_of, offset, room = best_fit_decreasing(sizes, length)
        certified = len(room) == lower_bound(np.bincount(sizes, minlength=length + 1))
        # a certified partition gives its emptiest sequence to the exchange, as others may fill it
        settled = bin_of != room.argmax() if certified else room[bin_of] == 0
        first = np.zeros(len(sizes), np.int64)
        first[np.unique(bin_of, return_index=True)[1]] = 1
        sequence = (turn << 56) + (key[0].as_py() << 32) + bin_of
        return (table.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
                .append_column("certified", pa.array((room[bin_of] == 0) | certified)).append_column("settled", pa.array(settled)).append_column("opens", pa.array(first)))

    return fit


def pack(items: DataFrame, length: int = LENGTH, part: int = PART) -> DataFrame:
    """items (any columns, and length) with sequence_id, offset and certified.

    certified is true in sequences that are full, which waste nothing, and in
    those of partitions packed into as few as their bound allows.
    At least two partitions exchange, unless there are too few items for two.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    whole = items.where(F.col("length") >= length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))
    done, rest, turn, before, last = [whole], items.where(F.col("length") < length), 0, None, None
    n = rest.count()
    while n:
        parts = max(-(-n // part), 2 if turn == 0 and n > 1 else 1)
        # every kind of size in every partition: dealt by the item, not by its size
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), *items.columns), F.lit(parts)))
        packed = dealt.groupBy("part").applyInArrow(fitting(length, turn), f"{schema}, sequence_id long, offset long, certified boolean, settled boolean, opens long")
        packed = stored(packed, f"pack-{turn}")
        bins, left, open_bins = packed.agg(F.sum("opens"), F.count_if(~F.col("settled")), F.sum(F.when(~F.col("settled"), F.col("opens")))).first()
        columns = [*items.columns, "sequence_id", "offset", "certified"]
        if before is not None and bins >= before:
            # the exchange saved no bin: the packing before it stands
            done.append(last.select(*columns))
            break
        done.append(packed.where("settled").select(*columns))
        if not left:
            break
        last, before = packed.where("not settled"), open_bins
        rest, n, turn = last.select(*items.columns), left, turn + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset, certified), one row per piece of every row of docs.

    A null or empty text is the end id alone; a repeated row is packed again, so
    that ties stand in for each other; a null id is kept; a very long text is cut
    into as many pieces as it takes. Extra columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    items = stored(pieces(docs, vocabulary, length, text_col, id_col), "pack-pieces")
    return pack(items, length).withColumnRenamed("id", id_col)
