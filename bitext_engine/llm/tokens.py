"""Token ids of whole texts, by the public tokenizers library, inside tasks.

The tokenizer's patterns never cross ASCII white space, so a text's ids are those of its white-space
pieces one after the other. A piece that is a plain word and plain punctuation is the two, one after the
other, and the tokenizer itself drops the case of words. So a column of texts is split, its distinct words are looked
up once, and only words that a worker has not met lately (two generations of bounded size, which changes no
result) are encoded, many at a time. The ids of the texts are then put together by array operations.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bitext_engine.llm.worker_memory import claim

END_ID = 2
TOKENIZER = "word_bpe_49k.json"
MEMO = 300_000  # words a generation
LONG_WORD = 256  # longer ones are not kept
PUNCTUATION = ".,!%&*$#|;:?-"  # what is split off words; no apostrophe, as 's and the like are tokens
TOGETHER = 256  # words encoded as one line
CHUNK = 6 << 20  # bytes of text put together at a time
_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Bounded dictionary: when the young generation is full, it becomes the old one."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, keys: list) -> list:
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, keys))
        if self.old:
            for i, value in enumerate(found):
                if value is None:
                    value = self.old.get(keys[i])
                    if value is not None:
                        found[i] = self.young[keys[i]] = value
        return found

    def learn(self, key, value) -> None:
        if len(key) <= LONG_WORD:
            self.young[key] = value


def _plain(word: str) -> bool:
    """Letters only, and nothing but their case would be normalised."""
    if not word.isalpha():
        return False
    if word.isascii():
        return True
    low = word.lower()
    sigma = "Σ" in word or "σ" in low or "ς" in low
    return low.isalpha() and not sigma and unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low)


class Encoder:
    """Ids of texts as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.others = Memo(), Memo()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words: lines of many words, cut behind the ids that end a word."""
        out = []
        groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for group, coded in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[np.frombuffer(coded, "<u4")]) * 4 + 4
            if len(cuts) == len(group) and cuts[-1] == len(coded):
                cuts = cuts.tolist()
                out += [coded[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                out += self._encode(group)
        return out

    def _of_words(self, words: list[str]) -> list[bytes | None]:
        """Ids of words; None where a word is not plain."""
        found = self.words.lookup(words)
        new = [i for i, value in enumerate(found) if value is None and _plain(words[i])]
        for i, coded in zip(new, self._encode_words([words[i].lower() for i in new]), strict=True):
            found[i] = coded
            self.words.learn(words[i], coded)
        return found

    def _of_others(self, pieces: list[str]) -> list[bytes]:
        found = self.others.lookup(pieces)
        new = [i for i, value in enumerate(found) if value is None]
        for i, coded in zip(new, self._encode([pieces[i] for i in new]), strict=True):
            found[i] = coded
            self.others.learn(pieces[i], coded)
        return found

    def _chunk(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id behind each, numbers of ids of each)."""
        lists = pc.ascii_split_whitespace(texts)
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        pieces = pc.list_flatten(lists).dictionary_encode()
        which, pieces = pieces.indices.to_numpy(), pieces.dictionary
        words = pc.ascii_rtrim(pieces, characters=PUNCTUATION)
        cut = pc.binary_length(words).to_numpy() < pc.binary_length(pieces).to_numpy()
        words = words.dictionary_encode()
        word_of, coded = words.indices.to_numpy().copy(), self._of_words(words.dictionary.to_pylist())
        odd = np.fromiter((c is None for c in coded), bool, len(coded))[word_of]
        mark_of = np.full(len(pieces), len(coded))
        coded.append(b"")
        # punctuation behind plain words
        with_mark = np.flatnonzero(cut & ~odd)
        if len(with_mark):
            some = pieces.take(pa.array(with_mark))
            stem = pc.utf8_length(words.dictionary.take(pa.array(word_of[with_mark]))).to_pylist()
            marks = pa.array([p[n:] for p, n in zip(some.to_pylist(), stem, strict=True)], pa.string()).dictionary_encode()
            mark_of[with_mark] = marks.indices.to_numpy() + len(coded)
            coded += self._of_others(marks.dictionary.to_pylist())
        # everything else as it is
        others = np.flatnonzero(odd)
        if len(others):
            word_of[others] = np.arange(len(others)) + len(coded)
            coded += self._of_others(pieces.take(pa.array(others)).to_pylist())
        coded = [c or b"" for c in coded] + [end_id.to_bytes(4, "little")]
        store = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts = np.cumsum(sizes) - sizes
        parts = np.empty(2 * len(which) + len(texts), np.int64)  # word, punctuation, ..., end id
        texts_end = np.cumsum(2 * per_text + 1) - 1
        inside = np.ones(len(parts), bool)
        inside[texts_end] = False
        parts[inside] = np.stack([word_of[which], mark_of[which]], axis=1).ravel()
        parts[texts_end] = len(coded) - 1
        sizes_of = sizes[parts]
        ends = np.cumsum(sizes_of)
        ids = store[np.repeat(starts[parts] - (ends - sizes_of), sizes_of) + np.arange(ends[-1])]
        return ids, np.diff(ends[texts_end], prepend=0)

    def column(self, texts: pa.Array, end_id: int = END_ID):
        """Yield (first row, ids, numbers of ids of each row) for slices of a column; a null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else []
        marked = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK)))
            if marked[at]:  # marks of special tokens are matched before anything is split
                ids = np.asarray(self.tokenizer.encode(texts[at].as_py(), add_special_tokens=False).ids + [end_id], "<u4")
                to, counts = at + 1, np.array([len(ids)])
            else:
                to = at + (int(np.argmax(marked[at:to])) or to - at)
                ids, counts = self._chunk(texts.slice(at, to - at), end_id)
            yield at, ids, counts
            at = to


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    claim("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
