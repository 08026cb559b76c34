"""Byte-level BPE: a segment tree over the ranks of adjacent pairs yields the leftmost lowest-rank merge."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import map_rows, read

#: Pieces that a worker remembers; the memory is emptied beyond it, and longer pieces are never kept.
REMEMBERED, REMEMBERED_CHARS = 250_000, 48
#: White space as Unicode has it; Python's own \s also takes four control characters.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Cuts a text where the vocabulary's own pattern surely cuts it: at white space, a space going with what follows.
_PIECES = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary's strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, vocab = _byte_names(), spec["model"]["vocab"]
        raw = {k: bytes(names[c] for c in k) for k in vocab}
        self.bytes_of = {i: raw[k] for k, i in vocab.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for k, i in vocab.items():
            if len(raw[k]) == 1:
                self.byte_ids[raw[k][0]] = i
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.pair_keys = np.array(sorted(a << 32 | b for a, b in self.merges), np.int64)
        self.pair_ranks = np.array([self.merges[k >> 32, k & 0xFFFFFFFF][0] for k in self.pair_keys.tolist()], np.int64)
        self.new_ids = np.zeros(len(self.merges), np.int64)
        for rank, new in self.merges.values():
            self.new_ids[rank] = new
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.added = added
        self.bytes_of |= {i: t.encode() for t, i in added.items()}
        longest_first = sorted(added, key=len, reverse=True)
        self.added_pattern = re.compile("|".join(map(re.escape, longest_first))) if added else None
        self.pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]").replace(r"[^[" + _SPACE + "]", "[^" + _SPACE))
        self.known: dict[str, tuple[bytes, int, bytes]] = {}
        self.long: list[str] = []

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_all(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most ``size`` (a power of two) bytes, end to end, and their number by word.

        One segment tree a word, over the ranks of its adjacent pairs; a node holds the least rank and its
        leftmost place. All words take their root's merge at the same time: three leaves of a tree change
        (the merged pair, the one before and the one after it), each with its path to the root, until no
        root holds a pair.
        """
        none = np.int64(1) << 62
        bits = size.bit_length()
        n = np.array([len(w) for w in words])
        ids = self.byte_ids[np.frombuffer(b"".join([w.ljust(size, b"\0") for w in words]), np.uint8).reshape(-1, size)]
        ids[np.arange(size) >= n[:, None]] = -1
        tree = np.full((len(words), 2 * size), none)
        place = np.arange(size - 1)
        ranks = np.where(ids[:, 1:] >= 0, self._ranks(ids[:, :-1], ids[:, 1:]), -1)
        tree[:, size : 2 * size - 1] = np.where(ranks >= 0, ranks << bits | place, none)
        width = size // 2
        while width:
            below = tree[:, 2 * width : 4 * width]
            np.minimum(below[:, ::2], below[:, 1::2], out=tree[:, width : 2 * width])
            width //= 2
        after, before = (np.tile(np.arange(size, dtype=np.int64) + d, (len(words), 1)) for d in (1, -1))

        def put(row: np.ndarray, i: np.ndarray, value: np.ndarray | np.int64) -> None:
            k = size + i
            tree[row, k] = value
            while k.size and k[0] > 1:
                k = k >> 1
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

        def pair(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            rank = self._ranks(ids[row, i], ids[row, j])
            return np.where(rank >= 0, rank << bits | i, none)

        row = np.flatnonzero(tree[:, 1] < none)
        while len(row):
            root = tree[row, 1]
            i = root & ((1 << bits) - 1)
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = self.new_ids[root >> bits]
            ids[row, j] = -1
            after[row, i] = k
            put(row, j, none)
            more = k < n[row]
            value = np.full(len(row), none)
            value[more] = pair(row[more], i[more], k[more])
            before[row[more], k[more]] = i[more]
            put(row, i, value)
            h = before[row, i]
            has = h >= 0
            put(row[has], h[has], pair(row[has], h[has], i[has]))
            row = row[tree[row, 1] < none]
        live = ids >= 0
        return ids[live].astype(np.int32), live.sum(axis=1)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word of any length, by the same tree without numpy; for long words."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        if n < 2:
            return ids
        merges, none = self.merges, 1 << 62
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                tree[size + i] = m[0] << 32 | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    return
                tree[k] = low

        def pair(i: int) -> int:
            j = after[i]
            m = merges.get((ids[i], ids[j])) if j < n else None
            return m[0] << 32 | i if m else none

        while tree[1] < none:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if j < n - 1:
                put(j, none)
            if i < n - 1:
                put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return [x for x in ids if x >= 0]

    def _learn_words(self, words: list[str]) -> None:
        known, name = self.known, self.bytes_of
        raws = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        below = 0
        for size in (8, 16, 32):
            rows = np.flatnonzero((sizes > below) & (sizes <= size)).tolist()
            below = size
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                flat, counts = self.merge_all([raws[k] for k in part], size)
                tokens = [name[x] for x in flat.tolist()]
                ends = np.cumsum(counts)
                text_ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))[ends - 1].tolist()
                ids, text = flat.tobytes(), b"".join(tokens)
                lo = a = 0
                for k, n, hi, z in zip(part, counts.tolist(), (4 * ends).tolist(), text_ends, strict=True):
                    known[words[k]] = (ids[lo:hi], n, text[a:z])
                    lo, a = hi, z
        for k in np.flatnonzero(sizes > below).tolist():
            ids = self.merge(raws[k])
            known[words[k]] = (np.array(ids, np.int32).tobytes(), len(ids), self.decode_bytes(ids))

    def _learn(self, pieces: list[str]) -> None:
        """Ids as int32 bytes, their number and what they decode to, of each piece."""
        known, whole, cut = self.known, [], []
        for p in pieces:
            if p.isalpha() or p[0] == " " and p[1:].isalpha():  # letters are one word to the pattern
                whole.append(p)
            else:
                cut.append((p, self.pattern.findall(p)))
        words = {w for _, ws in cut for w in ws}
        words.difference_update(known)
        words.update(whole)
        self._learn_words(list(words))
        for p, ws in cut:
            if len(ws) > 1:
                parts = [known[w] for w in ws]
                known[p] = (b"".join([x[0] for x in parts]), sum([x[1] for x in parts]), b"".join([x[2] for x in parts]))
        self.long += [p for p in (*pieces, *words) if len(p) > REMEMBERED_CHARS]

    def pieces(self, texts: list[str | None]) -> list[list[tuple[bytes, int, bytes]]]:
        """Per text: (ids as int32 bytes, their number, decoded bytes) of its pieces."""
        cut: list[list[str]] = []
        special: list[dict[int, int]] = []
        for text in texts:
            found, marks, at = [], {}, 0
            if text and self.added_pattern and (spans := [m.span() for m in self.added_pattern.finditer(text)]):
                for lo, hi in spans:
                    found += _PIECES.findall(text[at:lo])
                    marks[len(found)] = self.added[text[lo:hi]]
                    found.append("")
                    at = hi
                text = text[at:]
            cut.append(found + _PIECES.findall(text or ""))
            special.append(marks)
        every = set().union(*cut)
        every.discard("")
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(list(every.difference(self.known)))
        known = self.known
        known[""] = (b"", 0, b"")
        out = [[known[p] for p in ps] for ps in cut]
        for ps, marks in zip(out, special, strict=True):
            for k, token in marks.items():
                ps[k] = (np.array([token], np.int32).tobytes(), 1, self.bytes_of[token])
        for p in self.long:
            known.pop(p, None)
        self.long.clear()
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([p[0] for p in self.pieces([text])[0]]), np.int32).tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD; an unknown id is an error."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One per worker and file."""
    return Bpe(path)


def encode(df: DataFrame, key: str = "doc_id", path: str | None = None, decoded: bool = False, forget: bool = False) -> DataFrame:
    """(key, n_tokens, ids) of every whole text, and with ``decoded`` what the ids decode to, as ``decoded``.

    A null or empty text has no ids and decodes to the empty text. ``path`` must be readable on the executors.
    Words that one task has met are there for the next one in the same Python worker; with ``forget`` they and the
    vocabulary go when a task ends, so that other jobs' tasks, which get the same workers, do not carry them along.
    """
    path = path or default_path()

    def work(groups):
        bpe = load(path)
        for keys, texts in groups:
            found = bpe.pieces(texts)
            counts = [sum([p[1] for p in f]) for f in found]
            flat = np.frombuffer(b"".join([p[0] for f in found for p in f]), np.int32)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            out = {key: keys, "n_tokens": counts, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))}
            if decoded:
                out["decoded"] = [b"".join([p[2] for p in f]).decode("utf-8", "replace") for f in found]
            yield out
        if forget:
            load.cache_clear()

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, [key, "text"], f"{key} {kind}, n_tokens bigint, ids array<int>" + ", decoded string" * decoded, work)


def decode(df: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text) from a column ``ids``; null ids give a null text."""
    path = path or default_path()

    def run(batches):
        bpe = load(path)
        for b in batches:
            keys, ids = b.columns
            texts = [None if x is None else bpe.decode(x) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([keys, pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, "ids").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to, as digests.

    Null texts count as empty; of pairs with one rank the leftmost is merged first; repeated rows are encoded each; extra
    columns are not read; an empty table gives no rows.
    """
    found = encode(read(spark, sf_dir, "documents"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLE_SQL: dict[str, str] = {}
