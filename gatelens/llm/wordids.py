"""Token ids by the tokenizers library, with a bounded cache of words.

The tokenizer named here drops white space and never lets a token, a merge or a
normalisation cross it, so a text's ids are its words' ids in order. ASCII
punctuation at a word's end, after a letter or digit, is a pre-token of its own,
and ASCII case is folded by the tokenizer, so such words share their entries.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import lru_cache
from string import punctuation
from unicodedata import is_normalized

import numpy as np

from .textkit import parts_of

VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"
PUNCTUATION = punctuation.encode()
PART = 1 << 21
#: Of the cache's younger half; the older one was as large when it was younger.
CACHE_WORDS = 400_000
CACHE_BYTES = 16 << 20


def latin(word: bytes) -> bool:
    """Whether a word is of Latin letters alone that normalisation and lower case leave letters."""
    s = word.decode("utf-8", "replace")
    return s.isalpha() and max(s) < "\u0250" and is_normalized("NFC", s) and s.lower().isalpha()


@lru_cache(1)
def word_encoder(path: str | None = None) -> WordEncoder:
    """One encoder a process, so that tasks that share a worker share its cache."""
    return WordEncoder(path)


class WordEncoder:
    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _store(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids)

    def _each(self, fresh: list[bytes]) -> None:
        coded = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in fresh], add_special_tokens=False)
        for x, e in zip(fresh, coded, strict=True):
            self._store(x, np.array(e.ids, self.dtype).tobytes())

    def _together(self, fresh: list[bytes]) -> None:
        """Words of Latin letters alone: each is one pre-token, whose last token marks a word's end."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(fresh).decode()], add_special_tokens=False)[0].ids, self.dtype)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(fresh):
            return self._each(fresh)
        data, cuts = ids.tobytes(), (last * self.dtype.itemsize).tolist()
        for x, a, b in zip(fresh, [0, *cuts], cuts, strict=False):
            self._store(x, data[a:b])

    def _learn(self, missing: set[bytes]) -> None:
        known, later, plain, other = self.known, [], set(), set()
        for w in missing:
            if (ids := self.old.get(w)) is not None:
                self._store(w, ids)
                continue
            base = w.rstrip(PUNCTUATION)
            if base != w:
                if b"<|" in w or not base or not (base[-1:].isalnum() or latin(base)):
                    other.add(w)
                    continue
                tail = w[len(base) :]
                later.append((w, base, tail))
                if tail not in known:
                    other.add(tail)
                if base in known:
                    continue
            if base.isalpha() or latin(base):  # bytes: ASCII letters
                plain.add(base)
            else:
                other.add(base)
        for words, code in ((list(plain), self._together), (list(other), self._each)):
            for a in range(0, len(words), 2048):
                code(words[a : a + 2048])
        for w, base, tail in later:
            self._store(w, known[base] + known[tail])

    def encode(self, texts: Iterable[bytes], end: int | None = None) -> list[np.ndarray]:
        """The ids of each whole UTF-8 text, the end id appended if given. Long texts are read in parts."""
        tail = b"" if end is None else np.array([end], self.dtype).tobytes()
        out, short, at = [], [], []
        for t in texts:
            if len(t) > 2 * PART:
                out.append(b"".join(self._encode([p])[0] for p in parts_of(t, PART)))
            else:
                at.append(len(out))
                out.append(b"")
                short.append(t)
        for k, ids in zip(at, self._encode(short), strict=True):
            out[k] = ids
        return [np.frombuffer(x + tail, self.dtype) for x in out]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.old, self.known, self.held = self.known, {}, 0
        get, out, open_, missing = self.known.get, [], [], set()
        for t in texts:
            # added tokens such as <|x|> are matched before case is folded
            w = (t if b"<|" in t else t.lower()).split()
            f = list(map(get, w))
            if None in f:
                new = [k for k, v in enumerate(f) if v is None]
                missing.update([w[k] for k in new])
                open_.append((len(out), f, new, [w[k] for k in new]))
                out.append(b"")
            else:
                out.append(b"".join(f))
        if missing:
            self._learn(missing)
            for k, f, new, w in open_:
                for i, v in zip(new, map(get, w), strict=True):
                    f[i] = v
                out[k] = b"".join(f)
        return out
