"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three transducers. The normaliser maps each byte: the space becomes the meta symbol, and one
is put in front. The pieces form a trie with an output and a weight at the end of each. Byte fallback has an arc for
each character that no piece has, which puts out its UTF-8 byte pieces. An input composed with them is a lattice of places and
arcs between them; a path's weight is the sum of its arcs' weights in the tropical semiring (pieces weigh 1, fallback 1 a byte). For a
byte-pair model two pieces may be neighbours only if they encode to themselves together (``bpe.Pairs``); so a state is a place with
the piece that led there, and a pair that may not be weighs infinity. ``shortest_path`` relaxes the arcs from left to right and
reads the least path off backwards. (As a text has one encoding, one path is finite; others meet an infinite pair.)

No piece holds a meta symbol behind another character, so a path may be cut in front of a run of spaces that follows another character,
and at the controls that no piece has; texts are composed in such segments, and the paths of segments that came before are looked up.

Decoding maps ids to bytes, joins them, and undoes the normaliser.

Edge cases: a null or empty text encodes to no ids and decodes to the empty text; a text that holds the meta symbol itself
decodes to spaces there, as with the library; texts are never cut; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Pairs
from .common import col, ship, trim

META = "▁"
META_BYTES = META.encode()
NORMAL, UNKNOWN, BYTE = 1, 2, 6
BPE = 2
INFINITE = 1 << 60
#: Segments that a worker remembers (twice as many at most), the longest of them in bytes, and neighbouring pieces.
KEEP, LONGEST, PAIRS = 200_000, 48, 400_000
#: Bytes of text that are cut into segments, and of texts that are encoded, at a time.
SLICE = 1 << 20


def fields(data: bytes):
    """(number, value) of a protocol-buffer message: ints of varints, else bytes."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Machine(dict):
    """The compiled model; as a dictionary it holds the shortest paths (ids as 32-bit integers) of segments met lately."""

    def __init__(self, file: bytes, keep: int = KEEP):
        super().__init__()
        self.keep, self.old = keep, {}
        self.pieces, self.bytes_of, score, self.byte_id = {}, [], {}, {}
        normalizer, model_type, unknown = {}, 1, 0
        for number, value in fields(file):
            if number == 1:
                p = dict(fields(value))
                piece, kind, i = p[1].decode(), p.get(3, NORMAL), len(self.bytes_of)
                if kind == BYTE:
                    self.byte_id[int(piece[3:5], 16)] = i
                    self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                elif kind == NORMAL:
                    self.pieces[piece] = i
                    score[piece] = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                    self.bytes_of.append(piece.replace(META, " ").encode())
                else:
                    if kind == UNKNOWN:
                        unknown = i
                    self.bytes_of.append(b"")
            elif number == 2:
                model_type = dict(fields(value)).get(3, 1)
            elif number == 3:
                normalizer = dict(fields(value))
        if model_type != BPE or len(self.byte_id) != 256:
            raise ValueError("only byte-pair models with byte fallback are compiled")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only the identity normaliser that keeps white space is compiled")
        if any(META in p.lstrip(META) for p in self.pieces):
            raise ValueError("a piece crosses a word boundary")
        self.prefix = b" " if normalizer.get(3, 1) else b""
        self.unknown = unknown
        rank = {p: -s for p, s in score.items()}
        self.pairs = Pairs(self.pieces.keys(), lambda a, b: rank.get(a + b))
        self.pairs.prefixes = {}
        #: states of the trie: characters to states, 0 to the piece that ends here
        self.trie: dict = {}
        self.name: dict[int, str] = {}
        for p, i in self.pieces.items():
            if self.pairs.usable(p):
                node, self.name[i] = self.trie, p
                for c in p:
                    node = node.setdefault(c, {})
                node[0] = i
        self.neighbours: dict[int, bool] = {}
        # Controls without a piece that are frequent in texts end a segment at once.
        lone = b"".join(re.escape(c).encode() for c in "\n\t\r" if c not in self.trie)
        self.split = re.compile(b" *[^ " + lone + b"]+| +" + (b"|[" + lone + b"]" if lone else b"")).findall
        self.cut = re.compile(b"(?<=[^ ]) ").search

    def __missing__(self, segment: bytes) -> bytes:
        if len(segment) > LONGEST:
            return np.array(self.shortest_path(segment.decode()), np.int32).tobytes()
        if len(self) >= self.keep:  # two generations: what is not asked for while keep others come is forgotten
            self.old = dict(self)
            self.clear()
        value = self.old.get(segment)
        if value is None:
            value = np.array(self.shortest_path(segment.decode()), np.int32).tobytes()
        self[segment] = value
        return value

    def may_follow(self, a: int, b: int) -> bool:
        """Whether two pieces may be neighbours; remembered."""
        if len(self.neighbours) > PAIRS:
            self.neighbours.clear()
        found = self.neighbours[a * len(self.bytes_of) + b] = self.pairs.valid(self.name[a], self.name[b])
        if len(self.pairs.known) > 10_000:
            self.pairs.known.clear()
        return found

    def shortest_path(self, segment: str) -> list[int]:
        """The ids on the path of least weight through the segment's lattice.

        States are places with the piece that led there; of a place's states the least is kept, which is the only
        finite one. Fallback may follow and be followed by anything, as no merge spans it.
        """
        s = segment.replace(" ", META)
        n, size, known, trie = len(s), len(self.bytes_of), self.neighbours, self.trie
        weight, last, back = [INFINITE] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0
        for i in range(n):
            here, before = weight[i], last[i]
            if here == INFINITE:
                continue
            node, j, row = trie.get(s[i]), i + 1, before * size
            if node is None:
                cost = here + len(s[i].encode())
                if cost < weight[j]:
                    weight[j], last[j], back[j] = cost, -1, i
                continue
            here += 1
            while True:
                piece = node.get(0)
                if piece is not None and here < weight[j]:
                    ok = before < 0 or known.get(row + piece)
                    if ok is None:
                        ok = self.may_follow(before, piece)
                    if ok:
                        weight[j], last[j], back[j] = here, piece, i
                if j == n:
                    break
                node = node.get(s[j])
                if node is None:
                    break
                j += 1
        out, j = [], n
        while j:
            i = back[j]
            if last[j] < 0:
                out += [self.byte_id[b] for b in reversed(s[i].encode())]
            else:
                out.append(last[j])
            j = i
        out.reverse()
        return out

    def encoded(self, text: bytes) -> bytes:
        """The ids of a text as 32-bit integers."""
        if not text:
            return b""
        # A meta symbol in the text stands for a space from here on.
        normal = self.prefix + (text.replace(META_BYTES, b" ") if META_BYTES in text else text)
        if len(normal) <= SLICE:
            return b"".join(map(self.__getitem__, self.split(normal)))
        parts, at = [], 0
        while at < len(normal):  # cut where segments end
            found = self.cut(normal, at + SLICE)
            end = found.start() if found else len(normal)
            parts.append(b"".join(map(self.__getitem__, self.split(normal[at:end]))))
            at = end
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text.encode()), np.int32).tolist()

    def decoded(self, ids) -> bytes:
        whole = b"".join(map(self.bytes_of.__getitem__, ids))
        return whole[1:] if self.prefix and whole.startswith(b" ") else whole

    def decode(self, ids) -> str:
        return self.decoded(ids).decode(errors="replace")


_compiled: dict[int, Machine] = {}


def compiled(file: bytes) -> Machine:
    key = hash(file)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Machine(file)
    return _compiled[key]


def forgotten() -> None:
    """A worker outlives its tasks, and what it holds is missing elsewhere."""
    _compiled.clear()
    trim()


def as_bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of some SLICE bytes of text."""
    size = np.concatenate(([0], np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, size[at] + SLICE, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


RESULT = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("round_trip", T.BooleanType())])


def _model(spark: SparkSession, path: str):
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a model, of fixed size


def encoder(spark: SparkSession, path: str):
    """UDF from text to token ids."""
    file = _model(spark, path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = compiled(file.value)
        for texts in batches:
            for part in slices(texts):
                found = [machine.encoded(t) for t in as_bytes(part)]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
                del found, ends
        del machine
        forgotten()

    return ids


def decoder(spark: SparkSession, path: str):
    """UDF from token ids to text."""
    file = _model(spark, path)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        machine = compiled(file.value)
        return pa.array([machine.decode(x or []) for x in ids.to_pylist()], pa.string())

    return text


def digester(spark: SparkSession, path: str):
    """UDF from text to the number of its ids, a digest of them, and whether decoding them gives the text back."""
    file = _model(spark, path)

    @F.arrow_udf(RESULT)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = compiled(file.value)
        for texts in batches:
            for part in slices(texts):
                n, digests, back = [], [], []
                for t in as_bytes(part):
                    ids = machine.encoded(t)
                    n.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    back.append(machine.decoded(np.frombuffer(ids, np.int32).tolist()) == t)
                yield pa.StructArray.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.bool_())], names=RESULT.names)
        del machine
        forgotten()

    return digest


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token_ids of every row."""
    return docs.select(col("doc_id").alias("doc_id"), encoder(docs.sparkSession, path)(col("text")).alias("token_ids"))


def encode_counted(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of every row."""
    ids = encoder(docs.sparkSession, path)(col("text"))
    return docs.select(col("doc_id").alias("doc_id"), ids.alias("token_ids")).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of encode()."""
    return encoded.select("doc_id", decoder(encoded.sparkSession, path)(F.col("token_ids")).alias("text"))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip of every row."""
    found = digester(docs.sparkSession, path)(col("text"))
    return docs.select(col("doc_id").alias("doc_id"), found.alias("_found")).select("doc_id", "_found.*")
