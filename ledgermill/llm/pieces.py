"""SentencePiece encoding and decoding: a batched numpy Viterbi over a public model's pieces and scores.

A text gets a space in front and its spaces become the word mark, as the model's files ask; no piece reaches across the start of a
word, so words are segmented apart and the whole is the best segmentation of the text. The distinct words of a chunk of texts are sorted by
length; words of equal length advance together: hashes of all their substrings probe the sorted keys of the pieces of that length, and at
each place a maximum over the lengths stores the backpointers. A character that no piece covers becomes its bytes, by the model's byte pieces.

The public 32k model was trained by merges; its scores are minus the merge rank. This encoder finds the segmentation with the greatest sum
of scores, which is what the library's unigram encoder gives for these pieces and scores, not the order of merges.

Defined cases: a null text has null ids, an empty text none; decoding gives back every text exactly, the word mark itself, odd spaces and
newlines included. Of equal sums, the segmentation with the longest last piece wins. Other columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouping
from . import textarrays as ta

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
#: Stands for a word mark in the text itself; beyond all characters, so no piece has it.
_LITERAL_MARK = 0x110000
#: How much an uncovered character scores below the least piece: the library's value.
UNKNOWN_PENALTY = 10.0
_P = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 2 << 20


@dataclass(frozen=True)
class PieceTable:
    """keys, ids and scores of the pieces of each length; bytes of every id; byte ids; characters that pieces have."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    longest: int
    known: np.ndarray
    unknown_score: np.float32
    byte_ids: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def load(path: str = MODEL_PATH) -> PieceTable:
    """Read a model file on the driver; the table is a few megabytes and is broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, byte_ids, raw = [], np.full(256, -1, np.int32), []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            plain.append((i, piece, model.get_score(i)))
            raw.append(piece.replace(chr(MARK), " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    if any(chr(MARK) in p.lstrip(chr(MARK)) for _, p, _ in plain):
        raise ValueError("a piece of the model reaches across the start of a word")
    by_length = {}
    for n in sorted({len(p) for _, p, _ in plain}):
        own = [x for x in plain if len(x[1]) == n]
        keys = _substring_keys(np.array([[ord(c) for c in p] for _, p, _ in own], np.uint64), n)[:, 0]
        order = np.argsort(keys)
        by_length[n] = (keys[order], np.array([x[0] for x in own], np.int32)[order], np.array([x[2] for x in own], np.float32)[order])
    known = np.array(sorted({ord(c) for _, p, _ in plain for c in p}), np.uint32)
    sizes = np.array([len(x) for x in raw], np.int64)
    lowest = np.float32(min(x[2] for x in plain) - UNKNOWN_PENALTY)
    return PieceTable(by_length, max(by_length), known, lowest, byte_ids, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)


def _substring_keys(rows: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of n characters of equally long words, one row a word."""
    sums = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    for j in range(rows.shape[1]):
        sums[:, j + 1] = sums[:, j] * _P + rows[:, j] + np.uint64(1)
    power = np.uint64(pow(int(_P), n, 1 << 64))
    return ta.mix(sums[:, n:] - sums[:, : sums.shape[1] - n] * power)


def segment(rows: np.ndarray, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of equally long words (a row of characters each): piece ids, and how many of them each has.

    An uncovered character c is given as -1 - c.
    """
    n, length = rows.shape
    reach = min(length, table.longest)
    score = np.full((n, length + 1, reach), -np.inf, np.float32)  # [word, end, reach - piece length]
    piece = np.zeros((n, length + 1, reach), np.int32)
    score[:, 1:, reach - 1] = table.unknown_score
    piece[:, 1:, reach - 1] = -1 - rows.astype(np.int32)
    for size, (keys, ids, scores) in table.by_length.items():
        if size > length:
            continue
        own = _substring_keys(rows, size)
        at = np.minimum(np.searchsorted(keys, own.ravel()), len(keys) - 1).reshape(own.shape)
        word, begin = np.nonzero(keys[at] == own)
        score[word, begin + size, reach - size] = scores[at[word, begin]]
        piece[word, begin + size, reach - size] = ids[at[word, begin]]
    best = np.full((n, length + reach), -np.inf, np.float32)  # shifted by reach - 1, so that windows of starts are slices
    best[:, reach - 1] = 0
    back = np.zeros((n, length + 1), np.int32)
    for end in range(1, length + 1):
        total = best[:, end - 1 : end - 1 + reach] + score[:, end]
        back[:, end] = total.argmax(1)  # the first maximum is the longest piece
        best[:, end + reach - 1] = np.take_along_axis(total, back[:, end : end + 1], 1)[:, 0]
    out = np.zeros((n, length), np.int32)
    counts = np.zeros(n, np.int64)
    live, end = np.arange(n), np.full(n, length)
    while len(live):
        choice = back[live, end]
        out[live, length - 1 - counts[live]] = piece[live, end, choice]
        counts[live] += 1
        end = end - (reach - choice)
        live, end = live[end > 0], end[end > 0]
    return out[np.arange(length) >= length - counts[:, None]], counts


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + size)."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def encode_texts(texts: list[str], table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and how many each has."""
    chars = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    chars[chars == MARK] = _LITERAL_MARK
    chars[chars == 32] = MARK
    at = np.minimum(np.searchsorted(table.known, chars), len(table.known) - 1)
    foreign = table.known[at] != chars
    starts = (chars == MARK) | foreign
    starts[1:] &= ~((chars[1:] == MARK) & (chars[:-1] == MARK)) | foreign[1:]
    starts[1:] |= foreign[:-1]
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    begins = np.flatnonzero(starts)
    lengths = np.diff(np.append(begins, len(chars)))
    up, down = ta.powers(len(chars) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((chars + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    keys = ta.mix((sums[begins + lengths] - sums[begins]) * down[begins] + lengths.astype(np.uint64))
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    word_begin, word_length = begins[first], lengths[first]
    order = np.argsort(word_length, kind="stable")
    flat, counts = [], np.zeros(len(first), np.int64)
    for n in np.unique(word_length):
        own = order[np.searchsorted(word_length[order], n) : np.searchsorted(word_length[order], n, "right")]
        step = max(1, (1 << 20) // (int(n) * min(int(n), table.longest)))
        for part in (own[i : i + step] for i in range(0, len(own), step)):
            ids, counts[part] = segment(chars[word_begin[part][:, None] + np.arange(n)].astype(np.uint64), table)
            flat.append(ids)
    flat_ids = np.concatenate(flat)
    place = np.zeros(len(first), np.int64)
    place[order] = np.cumsum(counts[order]) - counts[order]
    tokens = flat_ids[_ranges(place[which], counts[which])]
    text_of = np.repeat(np.repeat(np.arange(len(texts)), sizes)[begins], counts[which])
    uncovered = np.flatnonzero(tokens < 0)
    if len(uncovered):
        code = -1 - tokens[uncovered]
        pieces = [table.byte_ids[list(chr(MARK if c == _LITERAL_MARK else c).encode("utf-8", "surrogatepass"))] for c in np.unique(code)]
        index = np.searchsorted(np.unique(code), code)
        width = np.array([len(x) for x in pieces])[index]
        repeats = np.ones(len(tokens), np.int64)
        repeats[uncovered] = width
        spread, text_of = np.repeat(tokens, repeats), np.repeat(text_of, repeats)
        first_of = np.array([len(x) for x in pieces]).cumsum() - np.array([len(x) for x in pieces])
        spread[spread < 0] = np.concatenate(pieces)[_ranges(first_of[index], width)]
        tokens = spread
    return tokens, np.bincount(text_of, minlength=len(texts))


def decode_ids(ids: np.ndarray, counts: np.ndarray, table: PieceTable) -> list[str]:
    """The texts of consecutive runs of ids."""
    sizes = table.sizes[ids]
    data = table.flat[_ranges(table.starts[ids], sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
    out, begin = [], 0
    for end in ends.tolist():
        out.append(data[begin + (data[begin : begin + 1] == b" ") : end].decode("utf-8", "replace"))
        begin = end
    return out


def encode(docs: DataFrame, table: PieceTable, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """All columns of docs with the ids of their text; check names a column for whether decoding them gives the text again.

    Columns of these names are replaced.
    """
    shared, own = docs.sparkSession.sparkContext.broadcast(table), ta.own_column(docs, "text_to_encode")
    docs = docs.withColumn(own, F.col(text).cast("string")).drop(ids, *([check] if check else []))

    def encoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch, own, CHUNK_BYTES):
            texts = part.column(part.num_columns - 1).to_pylist()
            tokens, counts = encode_texts([t or "" for t in texts], shared.value)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
            columns, names = [*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(tokens))], [*part.schema.names[:-1], ids]
            if check:
                again = decode_ids(tokens, counts, shared.value)
                columns, names = [*columns, pa.array([a == (b or "") for a, b in zip(again, texts)])], [*names, check]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != own), f"`{ids}` array<int>", *([f"`{check}` boolean"] if check else [])])
    return grouping.map_arrow(docs, encoded, schema)


def decode(frame: DataFrame, table: PieceTable, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of the frame with the text of their ids; null ids have a null text. A column of the text's name is replaced."""
    frame = frame if text == ids else frame.drop(text)
    shared, at = frame.sparkSession.sparkContext.broadcast(table), frame.columns.index(ids)

    def decoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            lists = part.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = pa.array(decode_ids(flat, counts, shared.value), pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), f"`{text}` string"])
    return grouping.map_arrow(frame, decoded, schema)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, load(), check="round_trip").select("doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip")
