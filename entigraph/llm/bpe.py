"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last of its encoding. An automaton over the vocabulary gives, at each position, the
tokens that end there; a token is the last one if the prefix before it is empty or if the last token of that prefix is compatible with it, which is to
say that merging the two tokens' bytes alone gives those two tokens again. Following the stored tokens back from the end gives the ids. The work is
linear in the length of a piece, however long, and nothing is merged step by step.

Pieces are cut as the tokenizer file says: the strings of added tokens first, then the byte-level pattern. Ids of pieces seen before are kept per task
in tables of bounded size; that changes the time only.

Defined cases: a null text is encoded as an empty one, to no ids; lone surrogates become U+FFFD; repeated rows are encoded alike; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import Recent, map_rows, table

#: The byte-level pre-tokenizer's pattern (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of a task's tables of words, pieces and token pairs.
CACHE = 150_000
#: Texts in which blanks only part words can be cut there.
_ODD_BLANKS = re.compile(r"[^\S\n ]|  | \n|\n |^ | $")


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, file: str) -> None:
        import ahocorasick
        import regex

        spec = json.load(open(file, encoding="utf-8"))
        model, letter = spec["model"], _byte_letters()
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(letter[c] for c in t) for t, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.cut_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.findall = regex.compile(PATTERN).findall
        n = max(self.bytes_of) + 1
        self.rank, self.left, self.right, self.merge = [-1] * n, [-1] * n, [-1] * n, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            t, a, b = vocab[a + b], vocab[a], vocab[b]
            self.merge.setdefault((a, b), r)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, a, b
        self.ends = ahocorasick.Automaton()
        for t, i in vocab.items():
            b = self.bytes_of[i]
            if len(b) == 1 or self.rank[i] >= 0:
                self.ends.add_word(b.decode("latin-1"), (i, len(b)))
        self.ends.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces, self.words = Recent(CACHE), Recent(CACHE)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a, then b, are encoded as just these two tokens.

        The merges that made the two are undone from the last one on, along the boundary: a's right and b's left parts. Where the parts that then
        meet could have been merged before the merge just undone, that would have happened. Of merges of one rank the leftmost comes first.
        """
        merge, rank = self.merge, self.rank
        before = len(rank) + len(merge)
        while True:
            if merge.get((a, b), before) < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.left[b]
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """Ids of one piece: the dynamic program."""
        pairs, compatible = self.pairs, self.compatible
        s = text.encode("utf-8", "replace").decode("latin-1")
        last, size = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        for end, (token, n) in self.ends.iter(s):
            end += 1
            if size[end]:
                continue
            if n < end:
                pair = (last[end - n], token)
                if (ok := pairs.get(pair)) is None:
                    if len(pairs) >= 2 * CACHE:
                        pairs.clear()
                    ok = pairs[pair] = compatible(*pair)
                if not ok:
                    continue
            last[end], size[end] = token, n
        out, end = [], len(s)
        while end:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def _pieces(self, text: str) -> bytes:
        known, out = self.pieces, []
        for p in self.findall(text):
            try:
                b = known[p]
            except KeyError:
                b = array("I", self.piece(p)).tobytes()
                if len(p) <= 64:
                    known.put(p, b)
            out.append(b)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if _ODD_BLANKS.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        words, out = self.words, [self._pieces(first)]
        for w in rest:
            try:
                b = words[w]
            except KeyError:
                b = self._pieces(" " + w)
                if len(w) <= 64:
                    words.put(w, b)
            out.append(b)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as unsigned 32-bit numbers in the machine's (little-endian) order."""
        if not text:
            return b""
        if not self.cut_added:
            return self._plain(text)
        parts = self.cut_added.split(text)
        return b"".join(array("I", [self.added[p]]).tobytes() if i % 2 else self._plain(p) if p else b"" for i, p in enumerate(parts))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


def encode(docs: DataFrame, file: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row. file: a byte-level BPE tokenizer file, there on every executor."""
    file = file or default_file()

    def make():
        e = encoder(file)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [e.encode(t.as_py()) for t in batch.column(1)]
            ends = [0]
            for b in got:
                ends.append(ends[-1] + len(b) // 4)
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(got))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), make, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    file = file or default_file()

    def make():
        e = encoder(file)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

        return f

    return map_rows(tokens.select("doc_id", "ids"), make, "doc_id long, text string")


def digests(tokens: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) from (doc_id, ids)."""
    file = file or default_file()

    def make():
        e, sha = encoder(file), hashlib.sha256

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [x.values.to_numpy() if x.is_valid else [] for x in batch.column(1)]
            cols = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([sha(x.astype("<u4").tobytes() if len(x) else b"").hexdigest() for x in ids]),
                pa.array([sha(e.decode(x.tolist() if len(x) else []).encode()).hexdigest() for x in ids]),
            ]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return f

    return map_rows(tokens.select("doc_id", "ids"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
