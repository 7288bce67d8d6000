"""Token ids of whole texts, by a public tokenizer file.

The pre-tokenizer of the vocabulary never joins text across a blank or a line feed, so a text's ids are the
ids of its blank-separated chunks in order. Chunks and their words repeat, hence each worker keeps bounded
caches of both. Words that are new are encoded together; the end-of-word suffix tells where each one ends.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of one generation of a worker's cache of chunks, and of that of words; two generations are kept.
CHUNKS, WORDS = 30_000, 120_000
#: Longer chunks are encoded each time.
LONG = 64
#: Bytes of text looked at at once.
PART = 2_000_000
#: Only in chunks of these characters are words found here; the tokenizer itself sees to all others.
#: A plain chunk is one word of letters and at most one sign.
SIMPLE = re.compile(r"[\x21-įı-ɏ]+")
#: The vocabulary's own pattern of words (a fixed value of its file), for such lower-cased chunks.
SIGNS = ".,;:!?"
PLAIN = f"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[{SIGNS}]?$"
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Cache:
    """A dict of two generations: when the new one is full it becomes the old one; what is still in use moves over."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those that have to be made; the others are in `new` afterwards."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        keys = keys.difference(self.new)
        if self.old:
            old = self.old
            kept = [k for k in keys if k in old]
            self.new.update(zip(kept, map(old.__getitem__, kept), strict=True))
            keys.difference_update(kept)
        return list(keys)


class ChunkTokenizer:
    """batch(texts) -> for each its ids as little-endian integers of `dtype`, in one bytes object."""

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocab.values()) > np.iinfo(self.dtype).max:
            raise ValueError(f"{dtype} is too narrow for this vocabulary")
        spec = json.loads(self.tokenizer.to_str())
        self.special, suffix = [x["content"] for x in spec["added_tokens"]], spec["model"].get("end_of_word_suffix")
        del spec
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix) and t not in self.special]] = True
        self.chunks, self.words = Cache(CHUNKS), Cache(WORDS)
        self.signs = [self._raw(c).tobytes() for c in SIGNS]
        # an isolated digit or sign outside \w and \d as this vocabulary counts them must not be taken for another class
        self.odd = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x21, 0x250)) if unicodedata.category(c)[0] not in "LN" and re.match(r"\w", c) and c != "_" or unicodedata.category(c) in ("No", "Nl") or c.isspace() or (unicodedata.category(c)[0] == "L") != bool(re.match(r"[^\W\d_]", c)))) + "]")

    def forget(self) -> None:
        """Empties the caches, at the end of a task."""
        self.chunks, self.words = Cache(CHUNKS), Cache(WORDS)

    def _raw(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _new_words(self, words: list[str]) -> list[bytes]:
        """Encodes them in one go; where the ends don't tell them apart, one by one."""
        ids = self._raw(" ".join(words))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return [self._raw(w).tobytes() for w in words]
        raw, stops = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _new_chunks(self, missing: list[str]) -> None:
        parts = {}
        for c in missing:
            if len(c) > LONG or not SIMPLE.fullmatch(c) or self.odd.search(c) or "<" in c and any(s in c for s in self.special):
                self.chunks.new[c] = self._raw(c).tobytes() if c else b""
            else:
                parts[c] = WORD.findall(c.lower())
        self._need([w for ws in parts.values() for w in ws])
        have = self.words.new
        self.chunks.new.update([(c, b"".join([have[w] for w in ws])) for c, ws in parts.items()])

    def _need(self, words: list[str]) -> None:
        """Sees to it that self.words.new has all of these."""
        missing = self.words.missing(set(words))
        for i in range(0, len(missing), 1000):
            self.words.new.update(zip(part := missing[i : i + 1000], self._new_words(part), strict=True))

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of an Arrow string column; null is the empty text.

        Arrow splits the texts and numbers their distinct chunks, so Python sees each distinct chunk of a part once.
        """
        sizes, out, i = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), [], 0
        stops = np.flatnonzero(np.diff(np.cumsum(sizes) // PART)) + 1
        for j in [*stops.tolist(), len(texts)]:
            if i < j:
                out += self._part(texts.slice(i, j - i))
            i = j
        return out

    def _part(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        chunks, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        is_plain = pc.match_substring_regex(chunks, PLAIN)
        plain, rest = chunks.filter(is_plain), chunks.filter(pc.invert(is_plain)).to_pylist()
        bare = pc.utf8_rtrim(plain, SIGNS)
        words = pc.utf8_lower(bare).dictionary_encode()
        signs = pc.index_in(pc.utf8_slice_codeunits(plain, -1), pa.array(list(SIGNS))).fill_null(-1).to_numpy() + 1
        # units: nothing, each sign, each distinct word, each other chunk; a chunk is two units
        units = [b"", *self.signs]
        names = words.dictionary.to_pylist()
        missing = self.chunks.missing(set(rest))
        self._new_chunks(missing)
        self._need(names)
        have = self.words.new
        units += [have[w] for w in names]
        units += [self.chunks.new[c] for c in rest]
        for c in missing:
            if len(c) > LONG:
                del self.chunks.new[c]
        pair = np.zeros((len(chunks), 2), np.int32)
        mask = is_plain.to_numpy(zero_copy_only=False)
        pair[mask, 0] = words.indices.to_numpy(zero_copy_only=False) + (1 + len(SIGNS))
        pair[mask, 1] = signs
        pair[~mask, 0] = np.arange(len(rest)) + (1 + len(SIGNS) + len(names))
        count = np.fromiter(map(len, units), np.int32, len(units)) // self.dtype.itemsize
        first = np.cumsum(count, dtype=np.int32) - count
        unit = pair[which].ravel()
        n = count[unit]
        end = np.cumsum(n, dtype=np.int64)
        at = np.repeat(first[unit] - (end - n), n)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(units), self.dtype)[at]
        bounds = np.concatenate([[0], end[1::2]])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


@functools.lru_cache(2)
def tokenizer(path: str, dtype: str) -> ChunkTokenizer:
    """One a worker process, so that its caches last over tasks."""
    return ChunkTokenizer(path, dtype)
