"""Ids of a batch of texts by a byte-level vocabulary, in Arrow and numpy.

Texts are cut at each space after a non-space: the byte-level rule never joins
characters over such a place, so the pieces' ids put together are the text's ids.
A batch's pieces become codes by one dictionary encoding; only pieces that the
worker has not met go to the library, many in one call.  Ids lie in one pool, and
a text's ids are taken from it by its codes.
"""

from __future__ import annotations

import functools
import os
import re
import string
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 16 << 20          # texts are encoded in groups of about so many bytes
GATHER = 1 << 20                # codes whose ids are taken at once
CALL_WORDS = 500                # words of one text given to the library
CACHE_PIECES = 800_000          # the worker's pieces are forgotten beyond this number
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_CUT = re.compile(r"(?<=\S)(?= )")
_SIGNS = string.punctuation
_SPACE = chr(0x120)             # the character of byte 32 in byte-level vocabularies


class BatchEncoder:
    """``encode(texts)`` gives (ids of all texts one after the other, number of ids of each text)."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark runs one worker for each core
        from tokenizers import Tokenizer

        self._lib, self.end_id = Tokenizer.from_file(path), end_id
        self._special = [x.content for x in self._lib.get_added_tokens_decoder().values()]
        vocabulary = self._lib.get_vocab(with_added_tokens=True)
        self._opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self._opens[[i for s, i in vocabulary.items() if s.startswith(_SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        self._code: dict[str, int] = {}     # of pieces as they stand
        self._word: dict[str, int] = {}     # of words after a space
        self._pool, self._used = np.empty(1 << 16, "<u4"), 0
        self._at, self._len = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self._known = 0
        self._add([[] if self.end_id is None else [self.end_id]])      # code 0: the end of a text

    def _grow(self, ids: np.ndarray, lens: np.ndarray) -> int:
        """Append pieces to the pool; returns the first one's code."""
        if self._used + len(ids) > len(self._pool):
            self._pool = np.resize(self._pool, max(2 * len(self._pool), self._used + len(ids)))
        self._pool[self._used:self._used + len(ids)] = ids
        self._at.append(self._used + np.cumsum(lens) - lens)
        self._len.append(lens)
        self._used += len(ids)
        self._known += len(lens)
        return self._known - len(lens)

    def _add(self, each: list[list[int]]) -> int:
        lens = np.fromiter(map(len, each), np.int64, len(each))
        return self._grow(np.fromiter((i for x in each for i in x), "<u4", int(lens.sum())), lens)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, pieces: list[str]) -> np.ndarray:
        """Codes of pieces that are encoded each by itself."""
        new = [p for p in dict.fromkeys(pieces) if p not in self._code]
        if new:
            first = self._add(self._library(new))
            self._code.update(zip(new, range(first, first + len(new))))
        return np.fromiter((self._code[p] for p in pieces), np.int64, len(pieces))

    def _words(self, words: list[str]) -> np.ndarray:
        """Codes of " " + word for each of the distinct ``words``."""
        codes = np.fromiter(map(self._word.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(codes < 0)
        new = [words[k] for k in at.tolist()]
        alone = [k for k, w in enumerate(new) if not w or w[-1].isspace()]
        if alone:
            codes[at[alone]] = self._whole([" " + new[k] for k in alone])
            left = np.ones(len(new), bool)
            left[alone] = False
            at, new = at[left], [new[k] for k in np.flatnonzero(left).tolist()]
        roots = [w.rstrip(_SIGNS) for w in new]
        joined = [k for k, (w, r) in enumerate(zip(new, roots)) if len(r) < len(w) and r.isalpha()]
        if joined:                 # letters, then signs: two tokens' texts, each of which is met more often
            root = self._words(list(dict.fromkeys(roots[k] for k in joined)))
            by_root = dict(zip(dict.fromkeys(roots[k] for k in joined), root.tolist()))
            first = np.fromiter((by_root[roots[k]] for k in joined), np.int64, len(joined))
            signs = self._whole([new[k][len(roots[k]):] for k in joined])
            lens, ids = self._taken(np.column_stack([first, signs]).ravel())
            code = self._grow(ids, lens.reshape(-1, 2).sum(axis=1))
            codes[at[joined]] = np.arange(code, code + len(joined))
            self._word.update(zip([new[k] for k in joined], range(code, code + len(joined))))
            left = np.ones(len(new), bool)
            left[joined] = False
            at, new = at[left], [new[k] for k in np.flatnonzero(left).tolist()]
        for k in range(0, len(new), 64 * CALL_WORDS):
            part = new[k:k + 64 * CALL_WORDS]
            groups = [part[j:j + CALL_WORDS] for j in range(0, len(part), CALL_WORDS)]
            ids = np.concatenate([np.array(x, "<u4") for x in self._library([" " + " ".join(g) for g in groups])])
            starts = np.flatnonzero(self._opens[ids])
            if len(starts) != len(part):            # not reached with byte-level rules
                codes[at[k:k + len(part)]] = self._whole([" " + w for w in part])
                continue
            first = self._grow(ids, np.diff(starts, append=len(ids)))
            codes[at[k:k + len(part)]] = np.arange(first, first + len(part))
            self._word.update(zip(part, range(first, first + len(part))))
        return codes

    def _plain_codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(codes, first code of each text and the end) of texts cut at every space."""
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten()
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        coded = words.dictionary_encode()
        codes = self._words(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        codes[at[:-1]] = self._whole(words.take(pa.array(at[:-1])).to_pylist())    # no space before a text
        return codes, at

    def _codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _SPACES)
        for s in self._special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain_codes(texts)
        plain, at = self._plain_codes(texts.filter(pa.array(~odd)))
        parts, k = [], 0
        for is_odd, text in zip(odd, texts):
            if is_odd:
                text = text.as_py()
                special = any(s in text for s in self._special)
                parts.append(self._add(self._library([text])) + np.zeros(1, np.int64) if special
                             else self._whole([p for p in _CUT.split(text) if p]))
            else:
                parts.append(plain[at[k]:at[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _taken(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each code, all their ids)."""
        self._at, self._len = [np.concatenate(self._at)], [np.concatenate(self._len)]
        starts, lens = self._at[0], self._len[0][codes]
        ends = np.concatenate([[0], np.cumsum(lens)])
        out = np.empty(ends[-1], "<u4")
        for k in range(0, len(codes), GATHER):
            n = lens[k:k + GATHER]
            base = starts[codes[k:k + GATHER]] - (ends[k:k + len(n)] - ends[k])
            lo, hi = ends[k], ends[k + len(n)]
            out[lo:hi] = self._pool[np.repeat(base, n) + np.arange(hi - lo)]
        return lens, out

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._known > CACHE_PIECES:
            self._forget()
        codes, at = self._codes(texts)
        lens, out = self._taken(np.insert(codes, at[1:], 0))
        ends = np.concatenate([[0], np.cumsum(lens)])
        return out, np.diff(ends[at + np.arange(len(at))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(sizes // BATCH_BYTES, prepend=0)) if len(texts) else []
        bounds = sorted({0, *map(int, cuts), len(texts)})
        got = [self._group(texts.slice(a, b - a)) for a, b in zip(bounds, bounds[1:])]
        if not got:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


@functools.cache
def batch_encoder(path: str, end_id: int | None = None) -> BatchEncoder:
    """One encoder for each worker process."""
    return BatchEncoder(path, end_id)
