"""Vectorised encoding of Arrow text columns with a public word tokenizer.

The tokenizer drops white space, never joins characters across it, and splits what is left into runs of letters,
single digits and runs of marks, which its model encodes one by one. The bytes of a batch are classed by table and
cut into such runs, each distinct run is encoded once, and the ids of all texts are gathered with numpy. Words with
any other character (apostrophes, "<", letters beyond Latin-1) are one run each, for the whole tokenizer. A bounded
memo carries runs from batch to batch, and from task to task of a worker (see encoder_of).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Letters that are lower case, composed and single code points, marks, a digit: each such run is a token group of its own.
RUN = re.compile("[a-zß-öø-ÿ]+|[!-&(-/:;=-@[-`{-~]+|[0-9]")
#: Ends a text among the bytes of a batch; no byte of UTF-8.
END = b"\xff"
BLANK, ENDING, LETTER, MARK, DIGIT, OTHER = range(6)
#: First byte of the letters from U+00C0 to U+00FF, the second bytes of the two among them that are none, and that of ß, above which all are lower case.
LATIN, SIGNS, SHARP = 0xC3, (0x97, 0xB7), 0x9F


def _kind(byte: int, split: bool) -> int:
    c = chr(byte)
    if c in " \t\n\v\f\r":
        return BLANK
    if byte == END[0]:
        return ENDING
    if not split or byte > 0x7E or byte < 0x20 or c in "'<":
        return OTHER
    return LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK


LOWER = bytes(range(256)).lower()
PIECE_BYTES = 8 << 20


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes batches of texts; at most `memo_pieces` runs of at most 64 bytes are remembered."""

    def __init__(self, path: str, memo_pieces: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo_pieces = memo_pieces
        self.memo: dict[bytes, bytes] = {}
        symbols = byte_symbols()
        self.symbols = {c: "".join(map(symbols.get, chr(c).encode())) for c in range(256)}
        self.split = self._model_alone()
        self.kinds = bytes(_kind(b, self.split) for b in range(256))

    def _model_alone(self) -> bool:
        """Whether the model alone gives what the whole tokenizer gives for runs."""
        probe = ["straße", "élève.", "theand,", "a", "ñandú?", "über;", "xyzzyq!", "to:", "on&&&", "x...", "b_c-", "(2023)", "3.14%", "a1b22", "--é--"]
        return all(b"".join(map(self._run, RUN.findall(p))) == self._whole(p) for p in probe)

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """The ids of one run of letters or of marks, or of a digit, by the model alone."""
        return array("I", map(attrgetter("id"), self.model.tokenize(run if run.isascii() else run.translate(self.symbols)))).tobytes()

    def piece(self, raw: bytes) -> bytes:
        text, most = raw.decode(), self.memo_pieces
        if self.split and RUN.fullmatch(text):
            out = self._run(text)
        else:  # words that are no run are remembered only while there is room for what is frequent
            out, most = self._whole(text), most // 3
        if len(self.memo) < most and len(raw) <= 64:
            self.memo[raw] = out
        return out

    def _runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all runs of all texts, letters lower-cased, each text closed by a run END, and the places where runs begin and end."""
        empty, end = (pa.scalar(b, pa.large_binary()) for b in (b"", END))
        joined = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_binary()), empty), empty, end)
        size = int(np.frombuffer(joined.buffers()[1], np.int64)[joined.offset + len(joined)])
        raw = joined.buffers()[2].slice(0, size)
        data = np.frombuffer(raw, np.uint8)
        kind, low = (np.frombuffer(bytearray(raw).translate(table), np.uint8) for table in (self.kinds, LOWER))
        if self.split:
            at = np.flatnonzero(data == LATIN)
            at = at[~np.isin(data[at + 1], SIGNS)]
            second = data[at + 1]
            kind[at] = kind[at + 1] = LETTER
            low[at + 1] = np.where(second < SHARP, second | 0x20, second)
        edges = np.flatnonzero(np.diff(kind > ENDING, prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        word = np.flatnonzero(np.maximum.reduceat(kind, first) == OTHER) if len(first) else first
        if len(word):  # words that hold a character of no run are runs as they stand
            sizes = last[word] - first[word]
            where = np.repeat(first[word] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            kind[where] = OTHER
            low[where] = data[where]
        begins = (kind == DIGIT) | (kind == ENDING)
        begins[0] = True
        begins[1:] |= kind[1:] != kind[:-1]
        keep = kind != BLANK
        low, at = low[keep], np.flatnonzero(begins[keep])
        return low, np.append(at, len(low))

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32 with end_id after each text, and the n + 1 offsets of the texts. Nulls count as empty."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.memo[END] = end_id.to_bytes(4, "little")
        low, at = self._runs(texts)
        runs = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(low)])
        coded = runs.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found, piece = list(map(self.memo.get, keys)), self.piece
        for k in [k for k, x in enumerate(found) if x is None]:
            found[k] = piece(keys[k])
        lens = np.fromiter(map(len, found), np.int32, len(found)) // 4
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        starts = np.cumsum(lens, dtype=np.int64) - lens
        each = lens[codes]
        ends = np.cumsum(each, dtype=np.int64)
        where = np.repeat(starts[codes] - (ends - each), each)
        where += np.arange(len(where))
        return pool[where], np.concatenate(([0], ends[low[at[:-1]] == END[0]]))


@lru_cache(maxsize=1)
def encoder_of(path: str, memo_pieces: int = 300_000) -> Encoder:
    """The encoder of this worker: it keeps its memo for the worker's next task, with the same bound."""
    return Encoder(path, memo_pieces)


def slices(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `most` bytes, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    run, start = 0, 0
    for k, size in enumerate(sizes):
        if run and run + size > most:
            yield batch.slice(start, k - start)
            run, start = 0, k
        run += size
    if start < batch.num_rows:
        yield batch.slice(start)


class ByteEncoder:
    """Ids of whole texts with the vocabulary of a public byte-level tokenizer.

    Texts of Latin letters and ASCII go to the faster of two libraries, which reads the same vocabulary by rank; all
    others (letters whose class depends on the library's tables, control characters, special tokens) to the
    tokenizer's own. Both are compared on some texts first; where they differ, the tokenizer's own serves all.
    """

    #: What only the tokenizer's own library encodes, besides texts with "<|".
    OTHER = re.compile("[^\t-\r -~\xa1-\u024f\u2010-\u2027]")
    #: First step of byte-level tokenizers: a fixed pattern.
    STEP = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    PROBE = ("The end isn't near.", "a  b \n c\t\n", "straße élève ñandú 12345 ½", "x...!? (b_c)-- ‘q’ — …", "zzzzqzzzz' 'll we'll", "")

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        raw = {s: b for b, s in byte_symbols().items()}
        ranks = {bytes(map(raw.get, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("ranks", pat_str=self.STEP, mergeable_ranks=ranks, special_tokens={})
        self.fast = lambda text: array("I", fast.encode_ordinary(text)).tobytes()
        if any(self.fast(t) != self._own(t) for t in self.PROBE):
            self.fast = None

    def _own(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str, end_id: int = END_ID) -> bytes:
        """The ids of a text and end_id, as little-endian unsigned 32-bit integers."""
        end = end_id.to_bytes(4, "little")
        if self.fast is None or "<|" in text or self.OTHER.search(text):
            return self._own(text) + end
        try:
            return self.fast(text) + end
        except ValueError:  # very long white space is too much for the pattern
            return self._own(text) + end
