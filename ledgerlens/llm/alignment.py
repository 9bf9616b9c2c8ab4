"""Cross-tokenizer alignment: where two tokenizers' tokens of one text end together.

1. Each text is encoded whole by a byte-level BPE file (A, on a space and the text) and a
   sentence-piece model (B, which adds that space itself). Token lengths in bytes add up to
   ends, which ascend; B's ends are looked up among A's, and the ends that both have slice both
   id lists into groups.
   Output: ids of both sides and the number of tokens of every group, in order.
2. A link is a pair of one A and one B token that end together: the last tokens of a group
   (no token is empty). Links are counted by id pair over the whole corpus, pre-aggregated in
   each task.
3. Every document's links look their pair's count up, and whether it is the highest of its B
   id. The counted pairs are sent to the tasks in sorted arrays of at most ``BROADCAST_PAIRS``;
   more pairs are looked up in several rounds of their own, then added up per document.

Texts are plain text: strings of special tokens in them have no meaning. A task holds about one
megabyte of texts, or one text, at a time; texts over ``LONG_TEXT`` go to B in stretches cut at
a space behind another character, which no piece of the model spans (checked on its pieces,
else the text goes whole).

Defined cases: texts that are null, empty, or whose tokens' bytes differ from the space and the
text (a model that changes characters) have no tokens, no groups and no links; repeated rows
are counted as often as they occur; an empty table gives no rows; other columns are kept, those
named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import UNSETTLED, Codec
from .common import map_batches, stored
from .hashing import text_slices

BATCH_BYTES = 1_000_000
LONG_TEXT = 200_000
SLICE_ROWS = 250
PENDING_PAIRS = 1_000_000
BROADCAST_PAIRS = 2_000_000
SPACE_MARK = "▁"
CUT = re.compile(r"(?<=[^ ▁]) (?=.)", re.DOTALL)
SHIFT = 32
OUTPUT = ("ids_a", "ids_b", "sizes_a", "sizes_b")


class PlainCodec(Codec):
    """A byte-level BPE file, strings of special tokens being plain text."""

    def _encode(self, text: str) -> list[int]:
        if self.ranked is not None and not UNSETTLED.search(text):
            return self.ranked.encode_ordinary(text)
        self.tok.encode_special_tokens = True
        return self.tok.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf_chars and self.ranked is not None and not UNSETTLED.search(text):
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        return np.array(self.encode_text(text), np.int32)


class PieceCodec:
    """A sentence-piece model given by its bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        self.table = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
                      else self.model.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in ids]
        # a space only begins a piece, or pieces are spaces throughout, and spaces stay as given
        self.separable = (all(not p.rstrip(b" ") or b" " not in p.lstrip(b" ") for p in self.table)
                          and b"".join(self.table[i] for i in self.model.encode(" a  b ")) == b"  a  b ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts = [self._stretches(t) if len(t) > LONG_TEXT and self.separable else [t] for t in texts]
        coded = iter(self.model.encode([s for part in parts for s in part], num_threads=1))
        return [np.fromiter(chain.from_iterable([next(coded) for _ in part]), np.int32) for part in parts]

    @staticmethod
    def _stretches(text: str) -> list[str]:
        """Stretches whose encodings, each with its space in front, make that of the text."""
        out, at = [], 0
        while at < len(text):
            cut = CUT.search(text, at + LONG_TEXT)
            end = cut.start() if cut else len(text)
            out.append(text[at:end])
            at = end + 1
        return out


class TokenBytes:
    """Byte strings of a vocabulary as one array, to compare many ids with their text."""

    def __init__(self, table: list[bytes]):
        self.size = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(table), np.uint8)

    def spell(self, ids: np.ndarray, given: bytes) -> bool:
        """Whether the tokens' bytes are ``given``."""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or ends[-1] != len(given):
            return not len(ids) and not given
        at = np.repeat(self.start[ids] - (ends - sizes), sizes) + np.arange(len(given))
        return bool((self.raw[at] == np.frombuffer(given, np.uint8)).all())


def common_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each side up to each common end, from the ends of both sides, which ascend: B's
    ends are looked up among A's."""
    if not len(ends_a):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    found = np.minimum(np.searchsorted(ends_a, ends_b), len(ends_a) - 1)
    common = np.flatnonzero(ends_a[found] == ends_b)
    return (found[common] + 1).astype(np.int32), (common + 1).astype(np.int32)


class Aligner:
    def __init__(self, spec_a: str, model_b: bytes):
        self.a, self.b = PlainCodec(spec_a), PieceCodec(model_b)
        self.bytes_a, self.bytes_b = TokenBytes(self.a.table()), TokenBytes(self.b.table)

    def align(self, texts: list[str | None]) -> list[tuple[np.ndarray, ...]]:
        """Of each text: ids of both sides, and tokens of each side in every group."""
        filled = [t for t in texts if t]
        coded = iter(self.b.encode(filled) if filled else ())
        out = []
        for text in texts:
            ids_a = ids_b = a = b = np.zeros(0, np.int32)
            if text:
                given = b" " + text.encode()
                ids_a, ids_b = self.a.ids(" " + text), next(coded)
                # merges of a plain byte-level file only join bytes
                if (self.a.ranked or self.bytes_a.spell(ids_a, given)) and self.bytes_b.spell(ids_b, given):
                    a, b = common_groups(np.cumsum(self.bytes_a.size[ids_a]), np.cumsum(self.bytes_b.size[ids_b]))
                else:
                    ids_a = ids_b = ids_a[:0]
            out.append((ids_a, ids_b, np.diff(a, prepend=np.int32(0)), np.diff(b, prepend=np.int32(0))))
        return out


_ALIGNERS: dict[str, Aligner] = {}


def _list_array(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def align(docs: DataFrame, tokenizer_a: str, model_b: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ids_a, ids_b, sizes_a and sizes_b (see the module)."""
    with open(tokenizer_a, encoding="utf-8") as f, open(model_b, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    key = uuid.uuid4().hex
    others = [c for c in docs.columns if c != text and c not in OUTPUT]

    def run(batches):
        if key not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[key] = Aligner(*sent.value)
        aligner = _ALIGNERS[key]
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in text_slices(sizes, BATCH_BYTES):
                rows = aligner.align(column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(others))]
                    + [_list_array([r[k] for r in rows]) for k in range(4)], names=[*others, *OUTPUT])

    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in OUTPUT])
    return map_batches(docs.select(*others, F.col(text).cast("string").alias("__ll_text")), run, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin (with the end of the last)."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes, dtype=np.int64))


def batch_links(ids_a: pa.Array, ids_b: pa.Array, sizes_a: pa.Array, sizes_b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Links of a batch as numbers (B id above ``SHIFT`` bits, A id below), and each row's first."""
    a, _ = _flat(ids_a)
    b, _ = _flat(ids_b)
    na, first = _flat(sizes_a)
    nb, _ = _flat(sizes_b)
    # every token belongs to a group, so the running sizes are places in the flat ids
    last_a, last_b = np.cumsum(na, dtype=np.int64) - 1, np.cumsum(nb, dtype=np.int64) - 1
    return (b[last_b].astype(np.int64) << SHIFT) | a[last_a].astype(np.int64), first


def link_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, n, best): how many links hold an id pair, and whether no pair of the same B id
    has more."""
    def run(batches):
        def rows(parts):
            pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        _ALIGNERS.clear()
        parts, held = [], 0
        for batch in _slices(batches):
            links, _ = batch_links(*[batch.column(i) for i in range(4)])
            if not len(links):
                continue
            parts.append(np.unique(links, return_counts=True))
            held += len(parts[-1][0])
            if held > PENDING_PAIRS:
                parts = [rows(parts)]
                held = len(parts[0][0])
                if 2 * held > PENDING_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["pair", "n"])
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows(parts)], names=["pair", "n"])

    counted = map_batches(aligned.select(*OUTPUT), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = stored(counted)
    token_b = F.shiftright("pair", SHIFT)
    highest = counted.groupBy(token_b.alias("b")).agg(F.max("n").alias("top"))
    return counted.join(highest, token_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def batch_digests(columns: list[pa.Array], spelled: dict) -> list[pa.Array]:
    """n_a, n_b, n_groups and groups_sha256 of a batch's id lists and sizes."""
    (ids_a, fa), (ids_b, fb), (na, fg), (nb, _) = (_flat(c) for c in columns)
    for side, ids, end in (("a", ids_a, "|"), ("b", ids_b, ";")):
        n = int(ids.max(initial=-1)) + 1
        if n > len(spelled.get(side, ())):
            spelled[side] = np.array([[f"{i},", f"{i}{end}"] for i in range(n)], object).reshape(n, 2)
    # a token's place among all tokens: A of a group, then B of it
    group_a, group_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    end_a, end_b = np.cumsum(na, dtype=np.int64), np.cumsum(nb, dtype=np.int64)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[end_a - 1], last_b[end_b - 1] = 1, 1
    out = np.empty(len(ids_a) + len(ids_b), object)
    if len(out):
        out[np.arange(len(ids_a)) + (end_b - nb)[group_a]] = spelled["a"][ids_a, last_a]
        out[np.arange(len(ids_b)) + end_a[group_b]] = spelled["b"][ids_b, last_b]
    digests = [hashlib.sha256("".join(out[a:b])[:-1].encode()).hexdigest() if b > a else ""
               for a, b in zip((fa + fb)[:-1].tolist(), (fa + fb)[1:].tolist())]
    return [*(pa.array(np.diff(f)) for f in (fa, fb, fg)), pa.array(digests, pa.string())]


LINKS = ("n_links", "n_best", "count_sum")
DIGESTS = ("n_a", "n_b", "n_groups", "groups_sha256")


def _slices(batches):
    for whole in batches:
        for k in range(0, whole.num_rows, SLICE_ROWS):
            yield whole.slice(k, SLICE_ROWS)


def _digest_schema(columns) -> T.StructType:
    return T.StructType([*columns, *(T.StructField(c, T.LongType()) for c in DIGESTS[:3]), T.StructField(DIGESTS[3], T.StringType())])


def link_strength(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS, digest: bool = False) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum (see ``link_counts``). With ``digest`` the id
    lists and sizes give way to n_a, n_b, n_groups and groups_sha256, the digest of
    `a1,a2|b1;a3|b2,b3` (ids of A and B per group, in order), in the same pass."""
    spark = aligned.sparkSession
    counts = stored(counts)
    aligned = aligned.drop(*LINKS, *(DIGESTS if digest else ()))
    n_rounds = max(1, -(-counts.count() // broadcast_pairs))
    while n_rounds > 1:
        number = F.pmod(F.xxhash64("pair"), F.lit(n_rounds))
        if not counts.groupBy(number.alias("r")).count().filter(F.col("count") > broadcast_pairs).take(1):
            break
        n_rounds += 1

    def scored(rows: DataFrame, part: int, digest: bool) -> DataFrame:
        mine = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(n_rounds)) == part).toArrow()
        pair, n, best = (mine.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        sent = spark.sparkContext.broadcast((pair[order], n[order], best[order]))
        kept = [c for c in rows.columns if not digest or c not in OUTPUT]
        places, lists = [rows.columns.index(c) for c in kept], [rows.columns.index(c) for c in OUTPUT]

        def run(batches):
            _ALIGNERS.clear()
            pair, n, best = sent.value
            spelled: dict = {}
            for batch in _slices(batches):
                columns = [batch.column(i) for i in lists]
                links, first = batch_links(*columns)
                at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
                here = pair[at] == links if len(pair) else np.zeros(len(links), bool)
                count = np.where(here, n[at], 0) if len(pair) else np.zeros(len(links), np.int64)
                top = here & best[at] if len(pair) else here
                sums = [np.append(0, np.cumsum(x, dtype=np.int64)) for x in (here, top, count)]
                out = [batch.column(i) for i in places] + [pa.array(s[first[1:]] - s[first[:-1]]) for s in sums]
                names = [*kept, *LINKS]
                if digest:
                    out, names = out + batch_digests(columns, spelled), [*names, *DIGESTS]
                yield pa.RecordBatch.from_arrays(out, names=names)

        schema = [*(rows.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in LINKS)]
        return map_batches(rows, run, _digest_schema(schema) if digest else T.StructType(schema))

    if n_rounds == 1:
        return scored(aligned, 0, digest)
    numbered = stored(aligned.withColumn("__ll_row", F.monotonically_increasing_id()))
    sums = None
    for i in range(n_rounds):
        one = scored(numbered, i, False).select("__ll_row", *LINKS)
        sums = one if sums is None else sums.unionByName(one)
    sums = sums.groupBy("__ll_row").agg(*[F.sum(c).alias(c) for c in LINKS])
    rest = group_digests(numbered) if digest else numbered
    return rest.join(sums, "__ll_row").drop("__ll_row")


def group_digests(aligned: DataFrame) -> DataFrame:
    """``aligned`` with its id lists and sizes replaced by their digest (see ``link_strength``)."""
    kept = [c for c in aligned.columns if c not in OUTPUT and c not in DIGESTS]
    places, lists = [aligned.columns.index(c) for c in kept], [aligned.columns.index(c) for c in OUTPUT]

    def run(batches):
        spelled: dict = {}
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + batch_digests([batch.column(i) for i in lists], spelled),
                                             names=[*kept, *DIGESTS])

    return map_batches(aligned, run, _digest_schema(aligned.schema[c] for c in kept))
