"""Token ids of whole columns of texts by a public tokenizer, with a bounded cache of words in each Python worker."""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OTHER = _SPACES.replace("\\s", "\\t\\f\\r ")  # but no line feed
_TOGETHER = f"{_SPACES} | {_SPACES}|{_SPACES}\\z|\n{_OTHER}|{_OTHER}\n|\n\n{_SPACES}"
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?]?)")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else from U+0100 on.
_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then starts[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class _Store:
    """Ids of words, each word once; `lookup` gives where the ids of words stand and how many they are."""

    def __init__(self, encode_all, dtype: np.dtype, cached: int):
        self.encode_all, self.dtype, self.cached = encode_all, dtype, cached
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.starts, self.sizes = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words are distinct."""
        if len(self.words) > self.cached:
            self.clear()
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = words.filter(at.is_null())
            ids, sizes = self.encode_all(new.to_pylist())
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
            fresh = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
            at[fresh] = len(self.words) + np.arange(len(fresh))
            self.words = pa.concat_arrays([self.words, new])
        else:
            at = at.to_numpy()
        return self.ids, self.starts[at], self.sizes[at]


class Encoder:
    """column(texts) gives the ids that the tokenizer gives for each text, flat, and their offsets.

    A byte-level tokenizer never joins across the space or the line feed before a word, so where the
    white space of a text is single spaces and one or two line feeds, its distinct words are encoded
    once and its ids are gathered from theirs. Other texts, and those that hold a special string of the tokenizer, are encoded whole. With special=False such
    strings are ordinary text. The store of words is emptied when it has more than `cached` of them.
    """

    def __init__(self, path: str, special: bool = True, cached: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kind, size = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        self.by_word = type(kind).__name__ == "ByteLevel" and size is None and not getattr(kind, "add_prefix_space", False)
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.words, self.heads = _Store(self._spaced, self.dtype, cached), _Store(self._alone, self.dtype, cached)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that follow a space, or begin with a line feed."""
        model, split = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
        ids, sizes = array("H" if self.dtype.itemsize == 2 else "I"), []
        for word in words:
            before = len(ids)
            if plain := _PLAIN.fullmatch(word):
                ids.extend([x.id for x in model("Ġ" + (plain[1] if word.isascii() else plain[1].encode().decode("latin-1").translate(_LETTERS)))])
                if plain[2]:
                    ids.extend([x.id for x in model(plain[2])])
            else:
                for piece, _ in split(word if not word or word[0] == "\n" else " " + word):
                    ids.extend([x.id for x in model(piece)])
            sizes.append(len(ids) - before)
        return np.frombuffer(ids, self.dtype), np.array(sizes, np.int64)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that begin a text."""
        parts = [self._whole(w) for w in words]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = np.asarray(split.offsets).astype(np.int64)
        flat = split.flatten()
        offsets, first = offsets - offsets[0], offsets[:-1] - offsets[0]
        coded, heads = flat.dictionary_encode(), flat.take(pa.array(first)).dictionary_encode()
        codes, head_codes = coded.indices.to_numpy(), heads.indices.to_numpy()
        ids, starts, sizes = self.words.lookup(coded.dictionary)
        head_ids, head_starts, head_sizes = self.heads.lookup(heads.dictionary)
        where, length = starts[codes], sizes[codes]
        where[first], length[first] = len(ids) + head_starts[head_codes], head_sizes[head_codes]
        return np.concatenate([ids, head_ids])[spread(where, length)], np.append(0, length.cumsum())[offsets]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each text's begin (one more at the end); nulls count as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.equal(texts, "") if self.by_word else pa.array(np.ones(len(texts), bool))
        if self.by_word:
            whole = pc.or_(whole, pc.match_substring_regex(texts, _TOGETHER))
            for name in self.special:
                whole = pc.or_(whole, pc.match_substring(texts, name))
        whole = whole.to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~whole)
        ids, offsets = self._by_word(texts.take(pa.array(plain))) if len(plain) else (np.empty(0, self.dtype), np.zeros(1, np.int64))
        if len(plain) == len(texts):
            return ids, offsets
        parts: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        for n, i in enumerate(plain):
            parts[i] = ids[offsets[n] : offsets[n + 1]]
        for i in np.flatnonzero(whole):
            parts[i] = self._whole(texts[i].as_py())
        return np.concatenate([np.empty(0, self.dtype), *parts]), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.column(pa.array([text]))[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with end_id behind each text."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def default_path() -> str:
    """The byte-level vocabulary of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
