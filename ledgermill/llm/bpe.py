"""BPE encoding and decoding with a public tokenizer's merges, by one walk through a trie of the distinct words.

A text is normalised and cut into words as the model's file asks: special tokens are taken out of the raw text first, the rest is composed
(NFC) and lower-cased, and its pattern gives the words. Each word is its UTF-8 bytes, the last one marked as a word's end. The distinct words of a chunk of
texts are inserted into a trie depth first, and each new node gets the last token of the encoding of the path that leads to it. That is the only token
which ends the path, and which stands beside the last token of the path before it: two tokens stand side by side if no merge across
their border comes before those within them. The encoding of a word is read back from its end along its path. So what words share is encoded once, by all texts of a task.

The trie of a task begins anew when it has MAX_NODES nodes; that costs time, never a word. Ids are those of the tokenizers library without
added tokens, truncation and padding; decoding gives its decode() without skipped tokens, which for a model without a decoder is the tokens with a space between.

Defined cases: a null text has null ids, a text without a word none; null ids have a null text. Equal texts have equal ids. Words of any length are
encoded whole. Columns of the results' names are replaced, others left as they are.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouping
from . import textarrays as ta
from .pieces import _ranges

TOKENIZERS = "/opt/tokenizers"
MODEL = "word_bpe_49k.json"
CHUNK_BYTES = 2 << 20
MAX_NODES = 1 << 19
#: Symbols are bytes; this is added to a word's last one.
LAST = 256
_NEVER = 1 << 60
#: Letters and digits of Unicode 17, which the library's word patterns don't know yet; to them these are other characters.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capitals of Unicode 16 and 17, which the library lowers and Python doesn't yet, by first, last and the first one's small letter.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWER = {c: small + c - first for first, last, small in LATER_CAPITALS for c in range(first, last + 1)}
_HAS_LATER_CAPITAL = re.compile(f"[{''.join(map(chr, _LOWER))}]")
_A_LATER = re.compile(f"[{LATER}]")
#: No Unicode version has it.
_UNASSIGNED = "\u0378"


def path(name: str = MODEL, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


@dataclass(frozen=True)
class Merges:
    """A model's merges by token id, with its spelling in symbols, and the word pattern and special tokens of its file."""

    left: list[int]
    right: list[int]
    rank: list[int]
    length: list[int]
    pairs: dict[tuple[int, int], int]
    spelled: dict[str, int]
    suffixes: dict[str, int]
    longest: int
    pattern: str
    special: dict[str, int]
    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def side_by_side(self, a: int, b: int, joined: bool = False) -> bool:
        """Whether a and b stay apart; if joined, whether they come to be just before their own merge.

        Both are undone from their last merge on. What then stands on both sides of the border would have been merged there if that merge
        comes before the next one on the left, and not after the next one on the right (of equal ones, the leftmost is first).
        """
        left, right, rank, pairs = self.left, self.right, self.rank, self.pairs
        next_left = next_right = _NEVER
        first = joined
        while True:
            across = None if first else pairs.get((a, b))
            first = False
            if across is not None and across < next_left and across <= next_right:
                return False
            if rank[a] > rank[b]:
                next_left, a = rank[a], right[a]
            elif rank[b] >= 0:
                next_right, b = rank[b], left[b]
            else:
                return True


def load(file: str | None = None) -> Merges:
    """Read a tokenizer file on the driver; what it holds is a few megabytes and is broadcast."""
    with open(file or path(), encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    normal = [x["type"] for x in spec["normalizer"]["normalizers"]]
    if not suffix or spec["decoder"] or normal != ["NFC", "Replace", "Lowercase"] or not split["invert"] or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
        raise ValueError("not a tokenizer of composed, lower-cased words with a mark at their ends")
    vocab: dict[str, int] = model["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    n = max([*vocab.values(), *special.values()]) + 1
    left, right, rank, length = [-1] * n, [-1] * n, [-1] * n, [1] * n
    pairs, spelled = {}, {}
    for byte, char in _byte_characters().items():
        spelled[chr(byte)], spelled[chr(byte + LAST)] = vocab[char], vocab[char + suffix]
    spelling = {i: s for s, i in spelled.items()}
    for r, (a, b) in enumerate(model["merges"]):
        x, y, z = vocab[a], vocab[b], vocab[a + b]
        pairs[x, y], left[z], right[z], rank[z], length[z] = r, x, y, r, length[x] + length[y]
        spelling[z] = spelling[x] + spelling[y]
    names = [""] * n
    for s, i in [*vocab.items(), *special.items()]:
        names[i] = s
    raw = [(s + " ").encode() for s in names]
    sizes = np.array([len(x) for x in raw], np.int64)
    merges = Merges(left, right, rank, length, pairs, spelled, {}, max(length), split["pattern"]["Regex"], special, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    whole = set(spelling) - {i for i in spelling if rank[i] >= 0}
    for i in sorted(spelling.keys() - whole, key=rank.__getitem__):  # a token that its own spelling doesn't lead to never comes up
        if left[i] in whole and right[i] in whole and merges.side_by_side(left[i], right[i], joined=True):
            whole.add(i)
            spelled[spelling[i]] = i
    for word, i in spelled.items():  # every end of a token, with the token that it is, or -1
        for size in range(1, len(word)):
            merges.suffixes.setdefault(word[-size:], -1)
        merges.suffixes[word] = i
    return merges


def _byte_characters() -> dict[int, str]:
    """The printable character by which byte-level files write each byte: itself if it is one, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class Trie:
    """Nodes of words met so far and the last token of each one's path."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.steps: dict[int, int] = {}
        self.last: list[int] = [-1]
        self.neighbours: dict[int, bool] = {}

    def insert(self, words: list[str]) -> list[list[int]]:
        """The tokens of each new word, given as symbols. Words in order are the trie's leaves depth first, so a word begins where it parts from the one before."""
        steps, last, length = self.steps, self.last, self.merges.length
        found: dict[str, list[int]] = {}
        nodes, lasts, before = [0], [-1], ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del nodes[shared + 1 :], lasts[shared + 1 :]
            node = nodes[-1]
            for depth in range(shared, len(word)):
                key = node << 9 | ord(word[depth])
                node = steps.get(key)
                if node is None:
                    node = steps[key] = len(last)
                    last.append(self._last(word, depth + 1, lasts))
                nodes.append(node)
                lasts.append(last[node])
            tokens, place = [], len(word)
            while place:
                tokens.append(lasts[place])
                place -= length[lasts[place]]
            found[word] = tokens[::-1]
            before = word
        return [found[w] for w in words]

    def _last(self, word: str, end: int, lasts: list[int]) -> int:
        """The last token of word[:end]: the longest one that ends it and stands beside the last one of what is before it."""
        suffixes, neighbours = self.merges.suffixes, self.neighbours
        begin, ends = end - 1, []
        token = suffixes.get(word[begin:end])
        while token is not None:
            if token >= 0:
                ends.append((begin, token))
            if not begin:
                break
            begin -= 1
            token = suffixes.get(word[begin:end])
        for begin, token in reversed(ends):
            if not begin:
                return token
            pair = lasts[begin] << 20 | token
            fits = neighbours.get(pair)
            if fits is None:
                if len(neighbours) >= MAX_NODES:
                    neighbours.clear()
                fits = neighbours[pair] = self.merges.side_by_side(lasts[begin], token)
            if fits:
                return token
        raise ValueError("the model has no token for a byte")


class Encoder:
    """The words met by a task, each with its tokens; words are numbered as they come."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.pattern = regex.compile(merges.pattern)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in merges.special) + ")").split if merges.special else None
        self.begin()

    def begin(self) -> None:
        self.trie, self.numbers = Trie(self.merges), _Numbers()
        for token in self.merges.special:
            self.numbers[" " + token]  # no word has a space
        self.numbers.new.clear()
        self.flat = np.array(list(self.merges.special.values()), np.int32)
        self.counts = np.ones(len(self.flat), np.int64)

    def words(self, text: str) -> list[str]:
        if self.cut and any(s in text for s in self.merges.special):
            return [w for i, part in enumerate(self.cut(text)) for w in ([" " + part] if i % 2 else self._plain(_normal(part)))]
        return self._plain(_normal(text))

    def _plain(self, text: str) -> list[str]:
        if len(text.encode("latin-1", "ignore")) == len(text) or not _A_LATER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_A_LATER.sub(_UNASSIGNED, text))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if len(self.trie.last) > MAX_NODES:
            self.begin()
        which, per_text = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.words(text)
            per_text[i] = len(own)
            which.append(np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own)))
        if self.numbers.new:
            tokens = self.trie.insert([_symbols(w) for w in self.numbers.new])
            self.flat = np.concatenate([self.flat, np.array([t for ts in tokens for t in ts], np.int32)])
            self.counts = np.concatenate([self.counts, np.array([len(ts) for ts in tokens], np.int64)])
            self.numbers.new.clear()
        word = np.concatenate(which) if which else np.zeros(0, np.int64)
        starts = np.cumsum(self.counts) - self.counts
        sizes = np.concatenate([[0], np.cumsum(self.counts[word])])
        ends = np.concatenate([[0], np.cumsum(per_text)])
        return self.flat[_ranges(starts[word], self.counts[word])], np.diff(sizes[ends])


class _Numbers(dict):
    """Numbers of words, in the order they come; new ones are listed too."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _normal(text: str) -> str:
    """Composed and lower-cased, character by character: a sigma at a word's end is one like any other."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return (text.translate(_LOWER) if _HAS_LATER_CAPITAL.search(text) else text).lower()


def _symbols(word: str) -> str:
    data = word.encode()
    return data[:-1].decode("latin-1") + chr(data[-1] + LAST)


def decode_ids(ids: np.ndarray, counts: np.ndarray, merges: Merges) -> list[str]:
    """The texts of consecutive runs of ids."""
    sizes = merges.sizes[ids]
    data = merges.flat[_ranges(merges.starts[ids], sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)].tolist() if len(counts) else []
    return [data[begin : max(begin, end - 1)].decode() for begin, end in zip([0, *ends], ends)]


def encode(docs: DataFrame, merges: Merges, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs, or those to keep, with the ids of their text."""
    shared, own = docs.sparkSession.sparkContext.broadcast(merges), ta.own_column(docs, "text_to_encode")
    kept = [c for c in (docs.columns if keep is None else keep) if c != ids]
    docs = docs.withColumn(own, F.col(text).cast("string")).select(*kept, own)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in ta.text_batches(batches, own, CHUNK_BYTES):
            texts = part.column(part.num_columns - 1).to_pylist()
            tokens, counts = encoder.encode([t or "" for t in texts])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(tokens))], [*kept, ids])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != own), f"`{ids}` array<int>"])
    return docs.mapInArrow(encoded, schema)


def decode(frame: DataFrame, merges: Merges, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of the frame with the text of their ids; an id that the model doesn't have is an error."""
    frame = frame if text == ids else frame.drop(text)
    shared, at = frame.sparkSession.sparkContext.broadcast(merges), frame.columns.index(ids)

    def decoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            lists = part.column(at)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = decode_ids(lists.flatten().to_numpy(zero_copy_only=False), counts, shared.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], [*part.schema.names, text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), f"`{text}` string"])
    return grouping.map_arrow(frame, decoded, schema)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = load()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    done = decode(encode(docs, merges, keep=["doc_id"]), merges)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
