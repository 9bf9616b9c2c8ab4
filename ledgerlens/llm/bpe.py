"""BPE encoding and decoding with a public tokenizer file, whole texts of any length.

Encoding a text:

* A single blank between two non-space characters always starts a new pre-token, so a text
  can be cut there. Texts without long stretches between such places are encoded whole.
* A long stretch without such a place ("long unsplit text") is encoded by tree concatenation:
  halves are encoded apart, down to ``leaf_chars``; at each join a window of tokens on both
  sides is re-encoded and grows until its outer halves agree exactly with both sides.
* Texts over ``piece_chars`` are cut into pieces that different Spark tasks encode, and
  the pieces' tokens are joined by the same tree.

Decoding is a table of the vocabulary's byte strings, then UTF-8 with replacement.

The tokenizer file is read once on the driver and sent to the tasks (a fixed-size file).

Defined cases: null text is empty and has no tokens; null ids decode to an empty text; ids
outside the vocabulary are skipped; repeated rows are kept; an empty table gives no rows; an
input column of the output's name is replaced, all other columns are kept.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stored

# a blank between two non-space characters: what follows it is encoded on its own
SAFE_BLANK = re.compile(r" (?<=\S )(?=\S)")
# how byte-level pre-tokenisation splits a text (fixed value)
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters outside blocks whose classes (letter, number, space) have been settled in Unicode
# for long (fixed values): texts with them are left to the file's own library, as another one
# may know another version of Unicode.
UNSETTLED = re.compile("[^\x00-\u024f\u0370-\u0373\u0386-\u03ce\u0400-\u045f\u2000-\u2064\u20a0-\u20ac\u2190-\u21ff"
                       "\u3000-\u303f\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3]")
BATCH_CHARS = 1_000_000


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, spec: str, leaf_chars: int = 8192):
        self.spec = spec
        self.leaf_chars = leaf_chars
        self._bytes: list[bytes] | None = None
        self._settings = json.loads(spec)
        self.ranked = self._ranked(self._settings)

    @cached_property
    def tok(self):
        """The file in its own library, loaded when a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tok = Tokenizer.from_str(self.spec)
        tok.no_truncation()
        tok.no_padding()
        return tok

    # -- encoding ---------------------------------------------------------------------
    def _ranked(self, spec: dict):
        """The same vocabulary in the faster library that merges by id, if that is the same
        algorithm: plain byte-level BPE whose merges, in order, make the ids 256, 257, ..."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") in (None, "BPE") and spec.get("normalizer") is None
                 and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                 and not before.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        vocab = model.get("vocab", {})
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
                     for t in spec.get("added_tokens", []))
        if not (plain and simple and all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merges))):
            return None
        ranks = {self.table()[i]: i for token, i in vocab.items() if token not in added}
        if sorted(ranks.values()) != list(range(256 + len(merges))):
            return None
        import tiktoken
        return tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=added)

    def _encode(self, text: str) -> list[int]:
        if self.ranked is not None and not UNSETTLED.search(text):
            return self.ranked.encode(text, allowed_special="all")
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode_tree(self, text: str) -> list[int]:
        """Ids of ``text`` by halves; equal to encoding it in one go."""
        if len(text) <= self.leaf_chars:
            return self._encode(text)
        mid = len(text) // 2
        return self.join(self.encode_tree(text[:mid]), self.encode_tree(text[mid:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two adjacent stretches of text together, from the ids of each."""
        width = 16
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            raw = self.raw(left[a:] + right[:b])
            try:
                window = raw.decode("utf-8")
            except UnicodeDecodeError:  # a window edge inside a character
                if a == 0 and b == len(right):
                    raise
                width += 1
                continue
            ids, agree = self._encode(window), width // 2
            if ((a == 0 or ids[:agree] == left[a:a + agree])
                    and (b == len(right) or ids[-agree:] == right[b - agree:b])):
                return left[:a] + ids + right[b:]
            width *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i]
                     for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode_text(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self._encode(text)
        chunks = SAFE_BLANK.split(text)
        if max(map(len, chunks)) < self.leaf_chars:
            return self._encode(text)
        chunks[1:] = [" " + c for c in chunks[1:]]
        ids, short = [], []
        for c in chunks:
            if len(c) <= self.leaf_chars:
                short.append(c)
                continue
            ids += self._encode("".join(short))
            short = []
            ids += self.encode_tree(c)
        return ids + self._encode("".join(short))

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes."""
        return [np.array(self.encode_text(t), np.int32).tobytes() for t in texts]

    # -- decoding ---------------------------------------------------------------------
    def table(self) -> list[bytes]:
        """Byte string of every id. Byte-level vocabularies write a byte as a printable
        character: printable Latin-1 bytes as themselves, the others from 256 up."""
        if self._bytes is None:
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = [x for x in range(256) if x not in set(plain)]
            back = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}
            added = {t["content"]: t["id"] for t in self._settings.get("added_tokens", [])}
            vocab = {**self._settings["model"]["vocab"], **added}
            table = [b""] * (max(vocab.values(), default=-1) + 1)
            for token, i in vocab.items():
                table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            self._bytes = table
        return self._bytes

    def raw(self, ids: list[int]) -> bytes:
        table = self.table()
        return b"".join([table[i] for i in ids])

    def decode(self, ids: np.ndarray) -> str:
        table = self.table()
        if len(ids) and (ids.min() < 0 or ids.max() >= len(table)):
            ids = ids[(ids >= 0) & (ids < len(table))]
        return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(spec, leaf_chars: int) -> Codec:
    """One codec per worker process and tokenizer."""
    key = (spec.id if hasattr(spec, "id") else id(spec), leaf_chars)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec.value, leaf_chars)
    return _CODECS[key]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``BATCH_CHARS`` bytes of text (or one row)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > BATCH_CHARS:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def _replaced(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [values],
                                      names=[batch.schema.names[i] for i in keep] + [name])


def _id_lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids",
           leaf_chars: int = 8192, piece_chars: int = 1 << 20) -> DataFrame:
    """``df`` with a column ``ids``: the token ids of its column ``text``."""
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    df = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))

    def encode_batches(batches, column):
        codec = _codec(spec, leaf_chars)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(column))
            for a, b in _slices(col):
                encoded = codec.encode_texts(col.slice(a, b - a).to_pylist())
                part = batch.slice(a, b - a)
                yield _with(part, ids, _id_lists(encoded))

    def join_batches(batches):
        codec = _codec(spec, leaf_chars)
        for batch in batches:
            parts = batch.column(batch.schema.get_field_index("__ll_parts"))
            joined = [np.array(codec.join_all([list(x["ids"]) for x in p.as_py()]), np.int32).tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists(joined)], names=["__ll_uid", ids])

    id_list = T.ArrayType(T.IntegerType())
    schema = _replaced(df.schema, ids, id_list)
    short = map_batches(df.filter(F.length(text) <= piece_chars), lambda it: encode_batches(it, text), schema)

    # long texts: pieces over many tasks, joined per text
    long = stored(df.filter(F.length(text) > piece_chars).withColumn("__ll_uid", F.monotonically_increasing_id()))
    n_pieces = F.ceil(F.length(text) / piece_chars)
    pieces = (long.select("__ll_uid", text, F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)).alias("__ll_k"))
              .select("__ll_uid", "__ll_k", F.substr(F.col(text), (F.col("__ll_k") * piece_chars + 1).cast("int"),
                                             F.lit(piece_chars)).alias("__ll_piece"))
              .repartition("__ll_uid", "__ll_k"))
    parts = map_batches(pieces, lambda it: encode_batches(it, "__ll_piece"), _replaced(pieces.schema, ids, id_list))
    gathered = parts.groupBy("__ll_uid").agg(F.sort_array(F.collect_list(F.struct("__ll_k", F.col(ids).alias("ids")))).alias("__ll_parts"))
    joined = map_batches(gathered, join_batches,
                         T.StructType([T.StructField("__ll_uid", T.LongType()), T.StructField(ids, id_list)]))
    rest = long.drop(ids).join(joined, "__ll_uid").drop("__ll_uid")
    return short.unionByName(rest.select(short.columns))


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with a column ``text``: its ids decoded, special tokens included."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def decode_batches(batches):
        codec = _codec(spec, 8192)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            for a in range(0, batch.num_rows, 500):
                part = lists.slice(a, 500)
                flat = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                texts = [codec.decode(flat[e - n:e]) for n, e in zip(sizes, ends)]
                yield _with(batch.slice(a, 500), text, pa.array(texts, pa.string()))

    return map_batches(df, decode_batches, _replaced(df.schema, text, T.StringType()))
