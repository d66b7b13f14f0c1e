"""Encoding of whole texts by a tokenizers file whose pieces never cross white space.

A text is the sequence of its words, so the distinct words of a run of texts are encoded once and gathered by their codes.
Words of common characters fall apart into pieces by the file's split pattern; pieces met before are looked up. When that
table reaches ``CACHE_WORDS`` entries a new one is begun, into which pieces come back from the last one as they are met
again; the one before is dropped. That bounds a worker's memory and keeps frequent pieces.
A file with another split pattern or normalisation encodes whole texts by the library, at its speed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces, and words of uncommon characters, kept by a worker before its table starts anew.
CACHE_WORDS = 200_000
#: Characters of text that are held as words at a time.
SLICE_CHARS = 1_000_000
#: Bytes of a column that are handled at a time.
SLICE_BYTES = 4 << 20

#: The split pattern and the normalisation of the tokenizer files that can be encoded by words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
#: Characters that normalisation keeps, but for case.
_PLAIN = r"^[!-~À-ÿ]*$"
#: ``SPLIT`` for lower-cased words of those characters.
_PLAIN_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+)"

_encoders: dict[tuple[str, bool], "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, plain_specials: bool = False) -> "WordEncoder":
    """The worker's encoder for ``path``; it lives as long as the worker."""
    key = (path, plain_specials)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, plain_specials)
    return _encoders[key]


class Recent:
    """A table that forgets what was not asked for since it was last turned over."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def missing(self, keys: list[str]) -> list[str]:
        """The keys that are not known; all others can be looked up in ``now`` until the next call."""
        if len(self.now) > self.most:
            self.old, self.now = self.now, {}
        out = []
        for key in keys:
            if key not in self.now:
                got = self.old.get(key)
                if got is None:
                    out.append(key)
                else:
                    self.now[key] = got
        return out


class WordEncoder:
    """``plain_specials``: the strings of special tokens in a text count as ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False):
        # Spark runs a task on each core; threads of the library's own would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.words, self.pieces = Recent(CACHE_WORDS), Recent(CACHE_WORDS)
        self.by_words = self._splits_at_space(json.loads(self.tokenizer.to_str()))

    def _splits_at_space(self, file: dict) -> bool:
        steps = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        normal = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
        same = steps.get("pattern") == {"Regex": SPLIT} and normal == NORMAL and file["model"].get("end_of_word_suffix") == "</w>"
        return same and file.get("post_processor") is None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, self.dtype).tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_pieces(self, pieces: list[str]) -> pa.Array:
        """Unknown pieces are encoded as one text; the last token of a piece is the one that carries the word end."""
        new, size = [p for p in self.pieces.missing(pieces) if p], self.dtype.itemsize
        self.pieces.now[""] = b""
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            raw = self._library([" ".join(part)])[0]
            cuts = ((np.flatnonzero(self.ends[np.frombuffer(raw, self.dtype)]) + 1) * size).tolist()
            if len(cuts) != len(part):
                raise ValueError("a piece has no single word end")
            self.pieces.now.update(zip(part, (raw[a:b] for a, b in zip([0, *cuts], cuts))))
        return pa.array(list(map(self.pieces.now.__getitem__, pieces)), pa.large_binary())

    def _of_plain(self, words: pa.Array) -> pa.Array:
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words), _PLAIN_PIECE, r"\1 "))
        coded = pieces.flatten().dictionary_encode()
        data, starts = gathered(self._of_pieces(coded.dictionary.to_pylist()), coded.indices)
        return runs(data, starts[bounds(pieces)])

    def _of_others(self, words: list[str]) -> pa.Array:
        new = self.words.missing(words)
        self.words.now.update(zip(new, self._library(new), strict=True))
        return pa.array(list(map(self.words.now.__getitem__, words)), pa.large_binary())

    def _of_words(self, words: pa.Array) -> pa.Array:
        """The ids of each of some distinct words, as bytes."""
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        found = self._of_plain(words.filter(plain))
        if len(found) == len(words):
            return found
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int64)
        place[np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)])] = np.arange(len(words))
        return pa.concat_arrays([found, self._of_others(words.filter(pc.invert(plain)).to_pylist())]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts: all their ids, and where each text's ids begin (one more for the end); null counts as empty."""
        for part in column_slices(texts):
            if self.by_words:
                # White space of ASCII is in every Unicode definition; the library handles all other.
                words = pc.ascii_split_whitespace(part)
                coded = words.flatten().dictionary_encode()
                data, starts = gathered(self._of_words(coded.dictionary), coded.indices)
                starts = starts[bounds(words)]
            else:
                found = self._library(part.to_pylist())
                data, starts = b"".join(found), np.cumsum([0, *map(len, found)])
            yield np.frombuffer(data, self.dtype, int(starts[-1]) // self.dtype.itemsize), starts // self.dtype.itemsize


def gathered(values: pa.Array, index: pa.Array) -> tuple[pa.Buffer | bytes, np.ndarray]:
    """The bytes of ``values`` (large binary) at ``index``, joined, and where each begins (one more for the end)."""
    got = values.take(index)
    if not len(got):
        return b"", np.zeros(1, np.int64)
    _, starts, data = got.buffers()
    return data if data is not None else b"", np.frombuffer(starts, np.int64, len(got) + 1)


def runs(data: pa.Buffer | bytes, starts: np.ndarray) -> pa.Array:
    """The bytes between neighbouring starts, without a copy."""
    starts = np.ascontiguousarray(starts, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)])


def bounds(lists: pa.Array) -> np.ndarray:
    """Where each list of ``lists`` begins in its flat values (one more for the end)."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])


def column_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of rows of about ``size`` bytes; a longer text comes alone, null becomes empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def texts_of(texts: pa.Array) -> Iterator[str]:
    """Each text, null as empty; about ``SLICE_CHARS`` bytes of them are Python's strings at a time."""
    for part in column_slices(texts, SLICE_CHARS):
        yield from part.to_pylist()


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task's function; at its end the memory that Arrow keeps for later goes back to the system, as workers live on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def slices(texts: Iterable[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Texts in lists of about ``chars`` characters; a longer text comes alone."""
    part: list[str] = []
    size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if part and size + len(text) > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part
