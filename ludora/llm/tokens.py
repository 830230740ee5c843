"""Exact token ids of whole texts, encoded once for each distinct word.

A text is cut before every single space. Where the tokenizer's own rules can never join what lies on
the two sides of such a cut, the ids of the parts put together are the ids of the text. Each worker
encodes a distinct part once with the library and keeps it in a bounded cache; Arrow cuts the texts and
numbers their parts, numpy puts the ids together. Texts for which the cut isn't safe (runs of white
space, special tokens) go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import values

#: Characters in a part that is kept in the cache.
CACHED_CHARS = 48
#: Parts in a worker's cache; beyond it the less used half goes.
CACHED_PARTS = 600_000
#: Words that the library gets in one text.
LINE = 200
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = r"[\t-\r\x1c- \x{85}\pZ]"


class Parts:
    """Bounded store of the ids of parts: a slot for each, their ids end to end."""

    def __init__(self, limit: int = CACHED_PARTS) -> None:
        self.limit, self.slot = limit, {}
        self.starts, self.lens, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def shrink(self) -> None:
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: self.limit // 2])
        keys = list(self.slot)
        starts, lens = self.starts[keep], self.lens[keep]
        self.flat = self.flat[spread(starts, lens)]
        self.starts, self.lens, self.hits = np.cumsum(lens) - lens, lens, self.hits[keep] // 2
        self.slot = {keys[k]: i for i, k in enumerate(keep.tolist())}

    def add(self, keys: list[str], starts: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.slot)
        self.slot.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.lens = np.concatenate([self.lens, lens])
        self.hits = np.concatenate([self.hits, np.zeros(len(keys), np.int32)])
        self.flat = np.concatenate([self.flat, flat])


#: Parts whose ids are put together at once.
BLOCK = 1 << 16


def gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the parts ``at`` end to end, and the number of them before each part. Block by block: only the result is large."""
    ends = np.concatenate([[0], np.cumsum(lens[at])])
    out = np.empty(int(ends[-1]), np.int32)
    for lo in range(0, len(at), BLOCK):
        some = at[lo : lo + BLOCK]
        out[ends[lo] : ends[lo + len(some)]] = flat[spread(starts[some], lens[some])]
    return out, ends


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... (length of them) for each pair, end to end."""
    total = int(lens.sum())
    out = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return out + np.arange(total)


#: starts, lengths and the ids that they point into
Flat = tuple[np.ndarray, np.ndarray, np.ndarray]


def flattened(ids: list[list[int]]) -> Flat:
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.cumsum(lens) - lens, lens, np.fromiter((x for y in ids for x in y), np.int32, int(lens.sum()))


class Encoder:
    """``ids(texts)`` gives all ids end to end and the number of them in each text."""

    def __init__(self, limit: int = CACHED_PARTS) -> None:
        self.parts = Parts(limit)

    whole_if: str | None = None  # texts that match go to the library whole
    first_as_rest = False  # the first part of a text is encoded like the others

    def library(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        starts, lens, flat = self.encode_flat(parts)
        return [flat[a : a + n].tolist() for a, n in zip(starts.tolist(), lens.tolist(), strict=True)]

    def encode_flat(self, parts: list[str]) -> Flat:
        return flattened(self.library(parts))

    def resolve(self, keys: list[str]) -> Flat:
        store = self.parts
        if len(store.slot) > store.limit:
            store.shrink()
        get = store.slot.get
        at = np.array([get(k, -1) for k in keys], np.int64)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            store.hits[at] += 1
            return store.starts[at], store.lens[at], store.flat
        words = [keys[i] for i in missing.tolist()]
        starts, lens, flat = self.encode_flat(words)
        short = np.array([len(w) <= CACHED_CHARS for w in words])
        if short.all():
            at[missing] = len(store.slot) + np.arange(len(missing))
            store.add(words, starts, lens, flat)
            store.hits[at] += 1
            return store.starts[at], store.lens[at], store.flat
        base = len(store.flat)  # long parts are used and forgotten
        both = np.concatenate([store.flat, flat])
        all_starts, all_lens = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        all_starts[missing], all_lens[missing] = base + starts, lens
        known = np.flatnonzero(at >= 0)
        all_starts[known], all_lens[known] = store.starts[at[known]], store.lens[at[known]]
        store.hits[at[known]] += 1
        kept = np.flatnonzero(short)
        of_kept = flat[spread(starts[kept], lens[kept])]
        store.add([words[i] for i in kept.tolist()], np.cumsum(lens[kept]) - lens[kept], lens[kept], of_kept)
        return all_starts, all_lens, both

    def codes(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct parts, the number of a part at each place, and the number of places in each text."""
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        counts = np.diff(offsets).astype(np.int64)
        if self.first_as_rest:
            return values(words), at, counts
        firsts = (offsets[:-1] - offsets[0]).astype(np.int64)
        lead = pa.array(words.take(pa.array(at[firsts]))).dictionary_encode()
        keys = [" " + w for w in values(words)]
        at = at.copy()
        at[firsts] = len(keys) + lead.indices.to_numpy()
        return keys + values(lead.dictionary), at, counts

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        whole = self.whole(texts)
        if whole.any():
            out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
            for i, x in zip(np.flatnonzero(whole), self.library(values(texts.filter(pa.array(whole)))), strict=True):
                out[i] = np.array(x, np.int32)
            if not whole.all():
                flat, counts = self.joined(texts.filter(pa.array(~whole)))
                for i, x in zip(np.flatnonzero(~whole), np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                    out[i] = x
            return np.concatenate(out), np.fromiter(map(len, out), np.int64, n)
        return self.joined(texts)

    def whole(self, texts: pa.Array) -> np.ndarray:
        if self.whole_if is None:
            return np.zeros(len(texts), bool)
        return pc.match_substring_regex(texts, self.whole_if).to_numpy(zero_copy_only=False)

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        keys, at, counts = self.codes(texts)
        starts, lens, flat = self.resolve(keys)
        ids, ends = gathered(flat, starts, lens, at)
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


class JsonEncoder(Encoder):
    """A ``tokenizers`` file. Two kinds of pre-tokenizer are known to be safe to cut; others get whole texts."""

    def __init__(self, path: str, limit: int = CACHED_PARTS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # what it is given is distinct already: its own cache would only be filled and missed
        with open(path) as f:
            spec = json.load(f)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        before, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
        drops = before.get("type") == "Sequence" and before["pretokenizers"][0].get("behavior") == "Removed" and all(x["type"] in ("NFC", "Lowercase", "Replace") for x in (normal or {}).get("normalizers", []))
        keeps = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None
        self.first_as_rest = drops  # white space is dropped: the cut is always safe
        if keeps:  # a space joins the word after it, or white space before it
            self.whole_if = "|".join([f"{SPACE} {SPACE}", f"{SPACE} $", *special])
        elif not drops:
            self.whole_if = ""

        # the tokens that a run of letters, with a space before it, begins or ends with, and no other of its tokens is
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.mark = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.mark[i] = token.endswith("</w>") if drops else token.startswith("Ġ")
        letters = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
        self.plain = f"^{letters}" if drops else f"^ {letters}" if keeps else None

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: pa.Array) -> Flat:
        """Ids of each; words of letters only go in long lines, in which the marks tell them apart."""
        if self.plain is None:
            return flattened(self.library(values(words)))
        plain = pc.match_substring_regex(words, self.plain).to_numpy(zero_copy_only=False)
        lines, gap = values(words.filter(pa.array(plain))), " " if self.first_as_rest else ""
        flats, sizes = [], []
        for at in range(0, len(lines), LINE):
            some = lines[at : at + LINE]
            ids = np.array(self.library([gap.join(some)])[0], np.int32)
            edges = np.flatnonzero(self.mark[ids])
            if len(edges) != len(some):
                _, lens, ids = flattened(self.library(some))
            else:
                lens = np.diff(edges, prepend=-1) if self.first_as_rest else np.diff(edges, append=len(ids))
            flats.append(ids)
            sizes.append(lens)
        _, lens, flat = flattened(self.library(values(words.filter(pa.array(~plain)))))
        all_lens = np.zeros(len(words), np.int64)
        all_lens[plain], all_lens[~plain] = np.concatenate(sizes) if sizes else 0, lens
        starts, quick = np.zeros(len(words), np.int64), np.concatenate(flats) if flats else np.zeros(0, np.int32)
        starts[plain] = np.cumsum(all_lens[plain]) - all_lens[plain]
        starts[~plain] = len(quick) + np.cumsum(lens) - lens
        return starts, all_lens, np.concatenate([quick, flat])

    def encode_flat(self, parts: list[str]) -> Flat:
        """A word and the punctuation after it are pre-tokens of their own: each distinct one is encoded once."""
        whole = pa.array(parts, pa.large_string())
        heads = pc.utf8_rtrim(whole, PUNCTUATION)
        parted = pc.and_(pc.less(pc.binary_length(heads), pc.binary_length(whole)), pc.match_substring_regex(heads, r"[\pL\pN]$"))
        odd = pc.or_(pc.ends_with(heads, "İ"), pc.match_substring(whole, "<|"))  # İ is two characters in lower case
        cut = pc.and_(parted, pc.invert(odd))
        heads = pc.if_else(cut, heads, whole)
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        tails = [parts[i][n:] for i, n in zip(at.tolist(), pc.utf8_length(heads).to_numpy()[at].tolist(), strict=True)]
        first, second = heads.dictionary_encode(), pa.array(tails, pa.large_string()).dictionary_encode()
        starts, lens, flat = self.words(pa.concat_arrays([first.dictionary, second.dictionary]))
        both = np.zeros((len(parts), 2), np.int64)
        both[:, 0] = first.indices.to_numpy()
        both[at, 1] = len(first.dictionary) + second.indices.to_numpy()
        sizes = lens[both] if len(lens) else np.zeros_like(both)
        tailless = np.ones(len(parts), bool)
        tailless[at] = False
        sizes[tailless, 1] = 0
        ids = flat[spread(starts[both].ravel(), sizes.ravel())]
        lens = sizes.sum(1)
        return np.cumsum(lens) - lens, lens, ids


class PieceEncoder(Encoder):
    """A ``sentencepiece`` BPE model whose pieces hold the space mark at the front only: a cut before a space is safe."""

    first_as_rest = True
    whole_if = "^$|^ |  | $|▁"

    def __init__(self, path: str, limit: int = CACHED_PARTS) -> None:
        import sentencepiece

        super().__init__(limit)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size())):
            self.whole_if = ""

    def library(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def encoder(path: str, cached_parts: int = CACHED_PARTS) -> Encoder:
    """One encoder for each worker process and file."""
    return PieceEncoder(path, cached_parts) if path.endswith(".model") else JsonEncoder(path, cached_parts)
