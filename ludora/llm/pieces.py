"""Op 7: SentencePiece BPE by a table of the last token of every prefix.

Every prefix of a word has one encoding, so one last token. It is the one suffix, among those that an
automaton over the pieces finds to end there, that merging would leave standing after the last token of
the shorter prefix: a pair of tokens stands when encoding their joined text gives back that pair. The
table of a word holds a token for each prefix; ids are recovered from its end backwards. Words are taken
in sorted order, and a word's table goes on from that of the prefix it shares with the word before it.
Pair tests are remembered; each needs the plain merges of a text of two pieces only.

Characters without a piece become bytes. Texts are cut before single spaces (no piece holds the space
mark but at its front) and each distinct word is encoded once per worker cache; texts with runs of
spaces or space marks are one word.

Null or empty texts: the two marks only (begin, end), decoded to an empty text. Repeated rows each get
their row. Empty tables: no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

#: Remembered pair tests of a worker.
PAIRS = 2_000_000


class PrefixTable:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        ordinary = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.text = {i: m.id_to_piece(i) for i in ordinary}
        self.id = {p: i for i, p in self.text.items()}
        self.score = {p: m.get_score(i) for p, i in self.id.items()}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merged(p) == [p]:  # others are never left standing
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self.pairs[key] = self.merged(x + y) == [x, y]
        return known

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, the space mark before it. Characters without a piece have last token -1."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        before, last, size = "", [0], [0]
        matches, pairs, stands = self.automaton.iter, self.pairs, self.stands
        for k in order:
            word = "▁" + words[k].replace(" ", "▁")
            n, shared = len(word), 0
            for shared, (x, y) in enumerate(zip(word, before)):  # noqa: B007
                if x != y:
                    break
            else:
                shared = min(n, len(before))
            del last[shared + 1 :], size[shared + 1 :]
            if shared < n:
                last += [-1] * (n - shared)
                size += [1] * (n - shared)
                for end, (token, length) in matches(word):
                    if end < shared:
                        continue
                    end += 1
                    start = end - length
                    if start:
                        prior = last[start]
                        if prior >= 0:
                            ok = pairs.get(prior << 20 | token)
                            if ok is None:
                                ok = stands(prior, token)
                            if not ok:
                                continue
                    last[end], size[end] = token, length
            before, ids, end = word, [], n
            while end:
                token = last[end]
                if token >= 0:
                    ids.append(token)
                else:
                    ids += [self.bytes[b] for b in reversed(word[end - 1].encode())]
                end -= size[end]
            ids.reverse()
            out[k] = ids
        return out


class TableEncoder(tokens.Encoder):
    first_as_rest = True
    whole_if = "^$|^ |  | $|▁"

    def __init__(self, path: str, limit: int = tokens.CACHED_PARTS) -> None:
        super().__init__(limit)
        self.table = PrefixTable(path)
        if any("▁" in p.lstrip("▁") for p in self.table.id):
            self.whole_if = ""

    def library(self, texts: list[str]) -> list[list[int]]:
        got = iter(self.table.encode([t for t in texts if t]))
        return [next(got) if t else [] for t in texts]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TableEncoder:
    return TableEncoder(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int, begin and end marks included) of every document."""
    return _apply(docs, model, "doc_id long, ids array<int>", False)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded by the table, decoded by the library."""
    return _apply(docs, model, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", True)


def _apply(docs: DataFrame, model: str, schema: str, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        lib = enc.table.model
        bos, eos = lib.bos_id(), lib.eos_id()
        for b in common.slices(batches, limit=16 << 20):
            flat, counts = enc.ids(common.column(b, "text"))
            ends = np.cumsum(counts)
            flat = np.insert(flat, np.stack([ends - counts, ends], 1).ravel(), np.tile([bos, eos], len(counts))).astype("<i4")
            counts = counts + 2
            doc_id = common.column(b, "doc_id")
            if not digests:
                yield pa.record_batch({"doc_id": doc_id, "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))})
                continue
            raw, at, of_ids, of_text = memoryview(flat).cast("B"), 0, [], []
            for n in counts.tolist():
                of_ids.append(hashlib.sha256(raw[4 * at : 4 * (at + n)]).hexdigest())
                of_text.append(hashlib.sha256(lib.decode(flat[at : at + n].tolist()).encode()).hexdigest())
                at += n
            yield pa.record_batch({"doc_id": doc_id, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_text)})

    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return common.map_arrow(rows, run, schema)


def op7_sentencepiece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
