"""Sentence pieces with the byte spans of the original text, and back."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, with_package

MODEL = "piece_bpe_32k.model"
#: Units (a word with the spaces before it) whose ids a worker remembers.
MEMO_UNITS = 500_000
SPACE = "▁"
#: White space first, then everything up to the next white space: no piece reaches over the start of such a unit.
UNITS = re.compile(rb" +[^ ]*")


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7]
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double array of prefixes, each with its replacement, matched longest first."""

    def __init__(self, compiled: bytes):
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4).tolist()
            self.replacements = compiled[4 + size :]
        else:
            self.units, self.replacements = [], b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest prefix in the map, if any."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            unit = self.units[node]
            if unit & (1 << 31 | 0xFF) != text[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & ((1 << 31) - 1)
                found = k + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Normaliser:
    """The model's normalisation, recording for each byte of its result where it comes from."""

    def __init__(self, spec: bytes):
        held = dict(_fields(spec))
        self.map = CharacterMap(held.get(2, b""))
        self.prefix = bool(held.get(3, 1))
        self.squeeze = bool(held.get(4, 1))
        self.escape = bool(held.get(5, 1))

    @property
    def plain(self) -> bool:
        """Whether spaces alone are rewritten."""
        return not self.map.units and self.prefix and not self.squeeze and self.escape

    def __call__(self, text: bytes, prefix: bool | None = None) -> tuple[bytes, list[int]]:
        """(normalised bytes, source offset of each of them and of the end); prefix: whether a space is put in front."""
        out, source, at = bytearray(), [], 0
        space = SPACE.encode() if self.escape else b" "
        parts = []  # (replacement, from, to)
        while at < len(text):
            hit = self.map.longest(text, at)
            if hit is None:
                size = 1 if text[at] < 0xC0 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
                same = text[at : at + size]
                hit = len(same), same  # shorter where the text breaks off inside a character
            parts.append((hit[1], at, at + hit[0]))
            at += hit[0]
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
        if not parts:
            return b"", [len(text)]
        if self.prefix if prefix is None else prefix:
            out += space
            source += [parts[0][1]] * len(space)
        blank = self.squeeze
        for new, lo, _ in parts:
            if blank:
                new = new.lstrip(b" ")
            if new:
                for byte in new:
                    piece = space if byte == 0x20 else bytes([byte])
                    out += piece
                    source += [lo] * len(piece)
                blank = self.squeeze and new.endswith(b" ")
        end = parts[-1][2]
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = source[len(out)]
                del source[len(out) :]
        return bytes(out), [*source, end]


    def spaces(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """What calling this without a prefix gives, for many units at once, where spaces alone are rewritten (plain)."""
        space, data = SPACE.encode(), np.frombuffer(text, dtype=np.uint8)
        # bytes inside a character come from where it begins
        begins = np.maximum.accumulate(np.where(data & 0xC0 == 0x80, 0, np.arange(len(data))))
        return text.replace(b" ", space), np.append(np.repeat(begins, np.where(data == 0x20, len(space), 1)), len(text))


class Pieces:
    """A model: ids of a text, the original byte span of each, and the text of ids."""

    def __init__(self, name: str):
        import sentencepiece

        path = public_tokenizers.path(name)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            self.normalise = Normaliser(next((v for k, v in _fields(file.read()) if k == 3), b""))
        lengths = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            lengths.append(1 if self.library.is_byte(i) else len(piece.encode()))
        self.lengths = np.asarray(lengths, dtype=np.int64)  # in normalised bytes
        inner = (self.library.id_to_piece(i) for i in range(len(lengths)))
        self.by_unit = self.normalise.plain and not any(SPACE in p.lstrip(SPACE) for p in inner)
        self.memo: dict[bytes, tuple[bytes, bytes, bytes]] = {}

    def projected(self, ids: np.ndarray, normal: bytes, source: list[int], text: str) -> np.ndarray:
        """Where each id's piece ends in the source of the normalised bytes."""
        ends = np.cumsum(self.lengths[ids])
        if len(ends) and ends[-1] != len(normal):  # unknown pieces: the library tells their surfaces
            surfaces = self.library.encode(text, out_type=str)
            ends = np.cumsum([1 if self.library.is_byte(i) else len(p.encode()) for i, p in zip(ids.tolist(), surfaces, strict=True)])
        # bytes that are no UTF-8 are longer to the library, as U+FFFD: there, spans are only held within the text
        return np.asarray(source, dtype=np.int64)[np.minimum(ends, len(normal))]

    def fill(self, units: set[bytes]) -> None:
        """Encode the unknown ones of many units: each is normalised with its alignment, and its normal form encoded.

        The library puts the first space back that it is not given, and takes the others as spaces again.
        """
        unknown = list(units.difference(self.memo))
        if len(self.memo) + len(unknown) > MEMO_UNITS:
            self.memo.clear()
            unknown = list(units)
        space = self.library.piece_to_id(SPACE)
        for lo in range(0, len(unknown), 16384):
            part = unknown[lo : lo + 16384]
            stream = b"\0".join(part)  # no unit holds a zero byte, and each begins with a space
            normal, source = self.normalise.spaces(stream)
            given = ("\0" + normal.decode("utf-8", "replace").replace(SPACE, " ")).split("\0 ")[1:]
            found = [ids or [space] for ids in self.library.encode(given, num_threads=1)]  # a lone space leaves the library nothing
            decimals = repr(found)[2:-2].replace(", ", ",").encode().split(b"],[")
            many = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            last = np.cumsum(many)
            first = last - many
            flat = np.fromiter(itertools.chain.from_iterable(found), dtype="<u4", count=int(last[-1]))
            # where each unit lies in the stream and in its normal form, then where each piece ends in both
            sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            begin = np.cumsum(sizes + 1) - sizes - 1
            cut = np.flatnonzero(np.frombuffer(normal, dtype=np.uint8) == 0)
            start, stop = np.append(0, cut + 1), np.append(cut, len(normal))
            reach = np.cumsum(self.lengths[flat])
            before = np.append(0, reach)[first]
            odd = np.flatnonzero(reach[last - 1] - before != stop - start)  # unknown pieces
            inside = np.minimum(reach + np.repeat(start - before, many), len(normal))
            ends = (source[inside] - np.repeat(begin, many)).astype("<i8")
            for k in odd.tolist():
                form, of = self.normalise(part[k], prefix=False)
                ends[first[k] : last[k]] = self.projected(flat[first[k] : last[k]], form, of, given[k])
            ids_held, ends_held = flat.tobytes(), ends.tobytes()
            for unit, decimal, x, y in zip(part, decimals, first.tolist(), last.tolist(), strict=True):
                self.memo[unit] = ids_held[4 * x : 4 * y], decimal, ends_held[8 * x : 8 * y]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, bytes, np.ndarray]]:
        """(ids, their decimal form, the ends of their pieces in the text's bytes) of each text; a piece begins where the one before ends."""
        out, cut = [], []
        for text in texts:
            if not text:
                cut.append([])
            elif self.by_unit and SPACE.encode() not in text and b"\0" not in text:
                cut.append(UNITS.findall(b" " + text))
            else:
                cut.append(None)
        self.fill({unit for units in cut if units for unit in units})
        for text, units in zip(texts, cut, strict=True):
            if units is None:
                plain = text.decode("utf-8", "replace")
                ids = np.asarray(self.library.encode(plain), dtype=np.int64)
                out.append((ids, ",".join(map(str, ids.tolist())).encode(), self.projected(ids, *self.normalise(text), plain)))
                continue
            known = [self.memo.get(u) or self.one(u) for u in units]
            ids = np.frombuffer(b"".join([k[0] for k in known]), dtype="<u4")
            ends = np.frombuffer(b"".join([k[2] for k in known]), dtype="<i8")
            if units:
                sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
                many = np.fromiter([len(k[0]) // 4 for k in known], dtype=np.int64, count=len(units))
                # the space in front of the first unit has no source
                ends = np.maximum(ends + np.repeat(np.cumsum(sizes) - sizes - 1, many), 0)
            out.append((ids, b",".join([k[1] for k in known]), ends))
        return out

    def one(self, unit: bytes) -> tuple[bytes, bytes, bytes]:
        self.fill({unit})
        return self.memo[unit]


@functools.lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(name)


OUTPUTS = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "begins": ("array<int>", pa.list_(pa.int32())),
    "ends": ("array<int>", pa.list_(pa.int32())),
    "ids_sha256": ("string", pa.string()),
    "decoded": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
    "spans_sha256": ("string", pa.string()),
}


def encode_pieces(docs: DataFrame, outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded"), model: str = MODEL) -> DataFrame:
    """doc_id and the asked-for outputs for every row of docs.

    ids are the model's ids of the whole text; begins and ends are the original byte spans of their pieces, projected
    through the normalisation's alignment; decoded is the text of the ids; spans_sha256 is the hash of all begins, then
    all ends, as little-endian 64-bit numbers.

    Defined cases: null and empty texts have no ids, no spans and the empty decoded text; very long texts are encoded unit by
    unit; rows that repeat a doc_id or a text are encoded each for itself; an empty table gives an empty result; other
    columns are ignored.
    """
    with_package(docs.sparkSession)
    kinds = [OUTPUTS[name] for name in outputs]

    def run(batches):
        held = pieces(model)
        for batch in slices(batches, 512):
            part = batch.column(1).to_pylist()
            columns: dict[str, list] = {name: [] for name in outputs}
            for ids, decimal, ends in held.encode([t or b"" for t in part]):
                begins = np.concatenate(([0], ends[:-1]))[: len(ends)]
                decoded = held.library.decode(ids.tolist()) if "decoded" in columns or "decoded_sha256" in columns else ""
                row = {
                    "n_tokens": len(ids),
                    "ids": ids,
                    "begins": begins,
                    "ends": ends,
                    "decoded": decoded,
                }
                if "ids_sha256" in columns:
                    row["ids_sha256"] = hashlib.sha256(decimal).hexdigest()
                if "decoded_sha256" in columns:
                    row["decoded_sha256"] = hashlib.sha256(decoded.encode()).hexdigest()
                if "spans_sha256" in columns:
                    row["spans_sha256"] = hashlib.sha256(np.concatenate((begins, ends)).astype("<i8").tobytes()).hexdigest()
                for name in outputs:
                    columns[name].append(row[name])
            arrays = [batch.column(0)]
            arrays += [pa.array(columns[name], kind) for name, (_, kind) in zip(outputs, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *outputs])

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{n} {k}" for n, (k, _) in zip(outputs, kinds, strict=True))])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_pieces(docs, ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))
