"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts every text into chunks at places that depend on the bytes near the cut alone, so passages
that documents share are cut alike. A chunk that occurs more than once in the corpus is encoded once, in the
document that holds its first occurrence, and its token ids reach the other documents by a join; other chunks
are encoded where they lie. Joined encodings are repaired at the seams: the text around a seam is encoded
anew, from a place in the left chunk to a place in the right chunk, and the places move outwards until the new
tokens agree exactly with both sides.

Spark plan: chunk digests are counted (partial aggregation, 20 bytes a chunk), texts are dealt out once by a
digest of the row (the owners' join and the last one read the same exchange), the tokens of shared chunks are
joined by chunk digest and then by row.
"""

from __future__ import annotations

import hashlib
import unicodedata
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import BYTE_VALUES, pick, row_slices, staged, text_bytes
from labelscan.llm.pretokens import Splitter, read_tokenizer

#: Bytes of the rolling hash's window; chunks have LEAST to MOST bytes, about LEAST + 2**CUT_BITS on average.
WINDOW, CUT_BITS, LEAST, MOST = 32, 10, 512, 16384
#: Encoded pre-tokens that a worker remembers before it starts anew.
MOST_WORDS = 400_000


def cut(data: np.ndarray) -> list[int]:
    """Offsets that cut UTF-8 bytes into chunks, both ends included ([0] for no bytes)."""
    n = len(data)
    if n <= LEAST:
        return [0, n] if n else [0]
    roll = BYTE_VALUES[data].astype(np.uint32)
    width = 1
    while width < WINDOW:  # the hash of 2w bytes is that of the last w plus the shifted one of the w before
        roll[width:] += roll[:-width] << np.uint32(width)
        width *= 2
    places = np.flatnonzero((roll >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, at = [0], 0
    k = 0
    while n - at > LEAST:
        k += int(np.searchsorted(places[k:], at + LEAST))
        end = min(int(places[k]) if k < len(places) else n, at + MOST, n)
        while end < n and data[end] & 0xC0 == 0x80:  # not inside a character
            end += 1
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


class Encoder:
    """Encodes and decodes with the vocabulary; whole pre-tokens are remembered."""

    _kept: dict = {}

    @classmethod
    def of(cls, key: str, spec) -> Encoder:
        """The worker's own encoder for this tokenizer, kept between tasks."""
        if key not in cls._kept:
            cls._kept = {key: cls(spec.value)}
        return cls._kept[key]

    def __init__(self, spec: dict):
        import tiktoken

        self.split = Splitter(spec)
        self.special = spec["special"]
        self.bytes = dict(spec["tokens"]) | {i: t.encode() for t, i in self.special.items()}
        rules = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks={b: i for i, b in spec["tokens"].items()}, special_tokens={})
        self.merge = rules._core_bpe.encode_single_piece
        self.words: dict[bytes, bytes] = {}

    def encode(self, raw: bytes) -> bytes:
        """Ids (little-endian, 32 bits each) of text without special tokens."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        _, at = self.split(raw.decode(), np.zeros(1, np.int64))
        words = self.words
        out = []
        for a, b in pairwise(at.tolist()):
            word = raw[a:b]
            ids = words.get(word)
            if ids is None:
                ids = np.array(self.merge(word), "<u4").tobytes()
                if b - a <= 64:
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")

    def seam(self, left: bytes, left_ids: bytes, right: bytes, right_ids: bytes) -> bytes:
        """Ids of ``left + right`` from those of both, by encoding the text around the seam anew.

        From the places found, the fresh ids must begin like the left ids' end and finish like the right ids'
        beginning, on a stretch that starts, and on one that ends, with a token that both encodings have.
        """
        reach = 16
        while True:
            a, b = self._back(left, reach), self._ahead(right, reach)
            tail, head = left[a:], right[:b]
            tail_ids, head_ids = self.encode(tail), self.encode(head)
            if left_ids.endswith(tail_ids) and right_ids.startswith(head_ids):
                fresh = self.encode(tail + head)
                return left_ids[: len(left_ids) - len(tail_ids)] + fresh + right_ids[len(head_ids) :]
            reach *= 4  # no agreement yet (whole chunks always agree)

    @staticmethod
    def _is_place(raw: bytes, i: int) -> bool:
        """Whether a pre-token starts at byte ``i``, whatever stands further left or right.

        True where white space follows another character, and where punctuation follows a letter or digit.
        """
        here, before = raw[i], raw[i - 1]
        if 0x80 <= here < 0xC0:
            return False
        char, last = chr(here), chr(before)
        if here >= 0x80:
            char = raw[i : i + 4].decode(errors="ignore")[:1]
        if before >= 0x80:
            last = raw[max(0, i - 4) : i].decode(errors="ignore")[-1:]
        if char in " \n\t":
            return not last.isspace()
        return unicodedata.category(char)[0] == "P" and unicodedata.category(last) in ("Ll", "Lu", "Lo", "Nd")

    @classmethod
    def _back(cls, raw: bytes, reach: int) -> int:
        """The last place that is ``reach`` bytes before the end at least (0: none but the start)."""
        return next((i for i in range(len(raw) - reach, 0, -1) if cls._is_place(raw, i)), 0)

    @classmethod
    def _ahead(cls, raw: bytes, reach: int) -> int:
        """The first place that is ``reach`` bytes after the start at least (the end, if there is none)."""
        return next((i for i in range(reach, len(raw)) if cls._is_place(raw, i)), len(raw))

    def parts(self, raw: bytes) -> list[bytes | int]:
        """Text between special tokens, as bytes, and the special tokens, as ids."""
        found: list[bytes | int] = [raw]
        for mark, number in self.special.items():
            if mark.encode() in raw:
                split = [x if isinstance(x, int) else [y for z in x.split(mark.encode()) for y in (number, z)][1:] for x in found]
                found = [y for x in split for y in (x if isinstance(x, list) else [x])]
        return [x for x in found if x != b""]

    def chunks(self, raw: bytes) -> list[bytes | int]:
        """The parts of a text, cut into chunks."""
        out: list[bytes | int] = []
        for part in self.parts(raw):
            if isinstance(part, int):
                out.append(part)
            else:
                out += [part[a:b] for a, b in pairwise(cut(np.frombuffer(part, np.uint8)))]
        return out

    def assemble(self, raw: bytes, shared: dict[int, bytes]) -> bytes:
        """Ids of a whole text; ``shared`` has those of some of its chunks, by position."""
        out: list[bytes] = []
        text, ids = b"", b""  # the open end of the current part: its last chunk, with all ids that may still change
        for i, chunk in enumerate(self.chunks(raw)):
            if isinstance(chunk, int):
                out += [ids, chunk.to_bytes(4, "little")]
                text, ids = b"", b""
                continue
            own = shared[i] if i in shared else self.encode(chunk)
            if not text:
                text, ids = chunk, own
                continue
            joined = self.seam(text, ids, chunk, own)
            # only the last chunk can change at the next seam, unless it holds no place to start from
            start = self._back(chunk, 1)
            if start:
                rest = self.encode(chunk[start:])
                if joined.endswith(rest):
                    out.append(joined[: len(joined) - len(rest)])
                    text, ids = chunk[start:], rest
                    continue
            text, ids = text + chunk, joined
        out.append(ids)
        return b"".join(out)


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def encode_decode(docs: DataFrame, tokenizer: str, more: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Token ids and decoded text of every row of ``docs`` (doc_id, text).

    Columns: doc_id long, n_tokens long, ids_sha256 string (of the ids as little-endian 32-bit numbers),
    decoded_sha256 string (of the decoded text in UTF-8) and those of ``more``: ids binary (the same 32-bit
    numbers), decoded string. Null text counts as empty. Rows with null or repeated doc_id are encoded row
    by row; exact repeats of a row give one row each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    found = read_tokenizer(tokenizer)
    key, spec = found["key"], spark.sparkContext.broadcast(found)  # about 1 MB, fixed by the file
    digest_of = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))))
    # never null, so that both joins below ask for the texts alike and Spark deals them out once for the two
    row = F.coalesce(digest_of, F.lit(b""))
    rows = pick(docs, doc_id="long", text="string").select(row.alias("row"), "doc_id", "text")

    def digests(batches):
        encoder = Encoder.of(key, spec)
        for batch in batches:
            who, at, what = [], [], []
            for i, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                for k, chunk in enumerate(encoder.chunks(raw or b"")):
                    if not isinstance(chunk, int):
                        who.append(i)
                        at.append(k)
                        what.append(digest(chunk))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(at, pa.int32()), pa.array(what, pa.binary())], names=["row", "at", "chunk"])

    # repeated rows give the same places twice, so a chunk counts as shared by its distinct places
    places = staged(rows.select("row", "text").mapInArrow(digests, "row binary, at int, chunk binary"))
    place = F.struct("row", "at")
    shared = places.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    uses = staged(places.join(shared, "chunk").select("row", "at", "chunk", (F.col("first") == place).alias("owner")))

    def encode_owned(batches):
        encoder = Encoder.of(key, spec)
        for batch in batches:
            what, ids = [], []
            for raw, owned in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                chunks = encoder.chunks(raw or b"")
                for k in set(owned):
                    what.append(digest(chunks[k]))
                    ids.append(encoder.encode(chunks[k]))
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.binary()), pa.array([pack(x) for x in ids], pa.binary())], names=["chunk", "ids"])

    owned = uses.where("owner").groupBy("row").agg(F.collect_set("at").alias("owned"))  # at most the chunks of one text
    dictionary = rows.join(owned, "row").select("doc_id", "text", "owned").mapInArrow(encode_owned, "chunk binary, ids binary").dropDuplicates(["chunk"])
    given = uses.join(dictionary, "chunk").groupBy("row").agg(F.collect_set(F.struct("at", "ids")).alias("shared"))

    def assemble(batches):
        encoder = Encoder.of(key, spec)
        for batch in batches:
            _, offs = text_bytes(batch.column(1))
            for i, j in row_slices(offs):
                part = batch.slice(i, j - i)
                ids, texts = [], []
                for raw, pieces in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    ids.append(encoder.assemble(raw or b"", {p["at"]: unpack(p["ids"]) for p in pieces or ()}))
                    texts.append(encoder.decode(ids[-1]))
                out = {
                    "doc_id": part.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                    "ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string()),
                }
                yield pa.RecordBatch.from_pydict({name: out[name] for name in kinds})

    kinds = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    kinds |= {name: {"ids": "binary", "decoded": "string"}[name] for name in more}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return rows.join(given, "row", "left").select("doc_id", "text", "shared").mapInArrow(assemble, schema)


def pack(ids: bytes) -> bytes:
    """Ids as they travel: 16 bits each where all fit."""
    values = np.frombuffer(ids, "<u4")
    return b"\x02" + values.astype("<u2").tobytes() if not len(values) or values.max() < 1 << 16 else b"\x04" + ids


def unpack(packed: bytes) -> bytes:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype("<u4").tobytes()
