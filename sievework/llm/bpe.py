"""Byte-pair encoding by batched numpy merge rounds, and decoding.

The symbols of many words lie in one flat array. A round looks all neighbouring pairs up by binary search in
the sorted pair keys, finds the lowest rank of each word, and merges that pair in every word at once, left to
right. Words are encoded once per batch and kept in a bounded cache.

The vocabulary file is the JSON format of the tokenizers library; this module reads those of the form: NFC,
white space to one space, lower case; a pattern split; byte-level symbols with an end-of-word suffix.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SPACE = "\t-\r \x85\xa0  -     　"
#: Arrow also splits at these, which are no white space in the pattern's sense.
ODD = "[\x1c-\x1f]"
#: Arrow's splitter decodes one character behind a text that ends in white space, so the last text needs one after it.
GUARD = pa.array(["." * 64])
SPLIT = regex.compile(f"[{SPACE}]+")
CACHE = 600_000
MARKS = tuple(",.;:!?")
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or spec["decoder"] is not None:
            raise ValueError("this vocabulary has other normalisation or splitting rules")
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", SPACE))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * size
        for t, i in (vocab | self.special).items():
            self.tokens[i] = t.encode()
        merges = model["merges"]
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        made = np.array([vocab[x + y] for x, y in merges], np.int32)
        keys = (a << 20) | b
        order = np.argsort(keys)
        self.keys, self.rank_of_key, self.made = keys[order], order.astype(np.int32), made
        self.cache: dict[str, bytes] = {}

    def pretokens(self, word: str) -> list[str]:
        """Of a run without white space and special strings."""
        return self.pattern.findall(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower())

    def rank(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at these places; NONE where no pair of one word merges."""
        inside = at + 1 < len(sym)
        at = np.where(inside, at, 0)
        after = np.where(inside, at + 1, 0)
        key = (sym[at].astype(np.int64) << 20) | sym[after]
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        hit = inside & (owner[at] == owner[after]) & (self.keys[place] == key)
        return np.where(hit, self.rank_of_key[place], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word begins (one more entry for the end)."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        sym = self.first[flat]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[flat[ends]]
        rank = self.rank(sym, owner, np.arange(len(sym)))
        done_sym, done_owner = [], []
        while len(sym):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            going = best < NONE
            best = np.repeat(best, sizes)
            if not going.all():
                going = np.repeat(going, sizes)
                done_sym.append(sym[~going])
                done_owner.append(owner[~going])
                sym, owner, rank, best = sym[going], owner[going], rank[going], best[going]
                if not len(sym):
                    break
            left = np.flatnonzero(rank == best)
            # in a run of overlapping pairs (a a a) every second one merges, from the left
            begins = np.flatnonzero(np.diff(left, prepend=-2) != 1)
            if len(begins) < len(left):
                offset = np.arange(len(left)) - np.repeat(begins, np.diff(np.append(begins, len(left))))
                left = left[offset % 2 == 0]
            sym[left] = self.made[rank[left]]
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            new = left - np.arange(len(left))  # where the merged symbols are now
            again = np.concatenate([new, new[new > 0] - 1])
            rank[again] = self.rank(sym, owner, again)
        sym, owner = np.concatenate([*done_sym, np.empty(0, np.int32)]), np.concatenate([*done_owner, np.empty(0, np.int32)])
        order = np.argsort(owner, kind="stable")
        return sym[order].astype("<u4"), np.searchsorted(owner[order], np.arange(len(words) + 1))

    def learn(self, words: set[str]) -> None:
        """Puts the ids of these white-space-free runs into the cache."""
        special = {w for w in words if "<|" in w and self.special_at and self.special_at.search(w)}
        plain = list(words.difference(special))
        normal = unicodedata.normalize("NFC", "\n".join(plain)).replace("Σ", "σ").lower().split("\n") if plain else []
        if len(normal) != len(plain):  # some word holds a newline after all
            normal = [unicodedata.normalize("NFC", w).replace("Σ", "σ").lower() for w in plain]
        plan: list = []  # the pre-tokens of each word: one as itself, more as a list
        wanted: set[str] = set(MARKS)
        for x in normal:
            if x.isalpha():
                wanted.add(x)
                plan.append(x)
            elif x[-1:] in MARKS and x[:-1].isalpha():  # the common cases don't need the pattern
                wanted.add(x[:-1])
                plan.append((x[:-1], x[-1]))
            else:
                own = self.pattern.findall(x)
                wanted.update(own)
                plan.append(own)
        mixed = {w: [p if p in self.special else self.pretokens(p) for p in self.special_at.split(w) if p] for w in special}
        for own in mixed.values():
            wanted.update(*(p for p in own if not isinstance(p, str)))
        # a word of letters alone in its normal form is its one pre-token, so pre-tokens need no cache of their own
        cache = self.cache
        same = {p for p in wanted if p.isalpha() and p.lower() == p and unicodedata.is_normalized("NFC", p)}
        parts = {p: cache[p] for p in same if p in cache}
        unknown = list(wanted.difference(parts))
        if unknown:
            ids, start = self.merge([p.encode("utf-8", "replace") for p in unknown])
            raw, at = ids.tobytes(), (start * 4).tolist()
            parts.update(zip(unknown, map(raw.__getitem__, map(slice, at, at[1:])), strict=True))
        get = parts.__getitem__
        cache.update(zip(same, map(get, same), strict=True))
        for w, own in zip(plain, plan, strict=True):
            cache[w] = get(own) if type(own) is str else b"".join(map(get, own))
        for w, own in mixed.items():
            cache[w] = b"".join(self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(get, p)) for p in own)

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Words are split and numbered by Arrow, so Python sees each distinct word of the batch once."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if pc.any(pc.match_substring_regex(texts, ODD)).as_py():
            split = pa.array([SPLIT.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            texts = texts.cast(pa.string())
            split = pc.utf8_split_whitespace(pa.concat_arrays([texts, GUARD])).slice(0, len(texts))
        numbered = split.flatten().dictionary_encode()
        words, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy(zero_copy_only=False)
        new = set(words).difference(self.cache)
        new.discard("")
        if len(self.cache) + len(new) > CACHE:
            self.cache = {w: self.cache[w] for w in set(words).intersection(self.cache)}
        self.cache[""] = b""
        if new:
            self.learn(new)
        ids = list(map(self.cache.__getitem__, words))
        pool, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        own = size[number]
        ends = np.concatenate([[0], np.cumsum(own)])
        flat = pool[np.repeat(start[number] - ends[:-1], own) + np.arange(ends[-1])].tobytes()
        at = (4 * ends[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids: bytes) -> bytes:
        """A vocabulary without a decoder gives its token strings, one space between them."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def shared(path: str) -> WordBpe:
    """One for each Python worker, so that its cache outlives a task."""
    return WordBpe(path)
