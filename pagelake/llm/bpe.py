"""Byte-level BPE with word ends: encoding and decoding.

Merging keeps a segment tree over the ranks of adjacent pairs: its root holds the leftmost
pair of lowest rank; a merge changes three leaves, each a logarithmic point update, until the root
holds no mergeable pair. Short words run as batches (one tree a row of a numpy matrix, all words of
a batch take their next merge together); long ones as one tree in plain Python, so a word of n
symbols costs n log n whatever its length.

Text: added tokens are cut out first; the rest is NFC-normalised, lower-cased and split at white
space and by the word pattern. No split spans white space, so each distinct white-space-separated
chunk is encoded once per worker and found in a bounded cache afterwards.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import releasing, spread, text_batches

_SPACE = "\t-\r \x85\xa0  -     　"
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^%s\p{L}\p{N}]+" % _SPACE)
_CHUNKS = regex.compile("[^%s]+" % _SPACE)
_ODD = regex.compile("[\x1c-\x1f]")  # str.split takes these for white space, the tokenizer doesn't
SHORT = 64
#: What each of a worker's caches holds at most, counted as entries of ENTRY bytes; longer words and chunks count by their length.
CACHE, ENTRY = 150_000, 64
_NONE = 1 << 30


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


class PairTable:
    """(left, right) -> (rank, merged id) as an open-addressing table that numpy reads in bulk."""

    def __init__(self, merges: list[tuple[int, int, int]], bits: int = 18):
        self.shift = np.uint64(64 - bits)
        n = 1 << bits
        self.keys = np.full(n, -1, np.int64)
        self.rank = np.full(n, _NONE, np.int32)
        self.merged = np.zeros(n, np.int32)
        keys = np.array([a << 32 | b for a, b, _ in merges], np.int64)
        slots, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            at = (slots[todo] + self.probes) & (n - 1)
            free = self.keys[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.keys[at[won]] = keys[todo[won]]
            self.rank[at[won]] = todo[won]
            self.merged[at[won]] = [merges[i][2] for i in todo[won]]
            todo = np.delete(todo, won)
            self.probes += 1
        self.one = {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(merges)))}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 where it never merges."""
        keys = left << 32 | right
        base, mask = self._slot(keys), len(self.keys) - 1
        out = np.where(self.keys[base] == keys, base, -1)
        for k in range(1, self.probes):
            at = (base + k) & mask
            out = np.where(self.keys[at] == keys, at, out)
        return out


def _entries(strings) -> int:
    return len(strings) + sum(map(len, strings)) // ENTRY


class Bpe:
    """The tokenizer of one vocabulary file (the JSON of the ``tokenizers`` library)."""

    def __init__(self, spec: str | dict, cache: int | None = None):
        self.most = CACHE if cache is None else cache
        spec = json.loads(spec) if isinstance(spec, str) else spec
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.pairs = PairTable(merges)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        known = {i: t.encode() for t, i in (vocab | self.added).items()}
        self.out = [known.get(i) for i in range(max(known) + 1)]
        self.cut = regex.compile("(%s)" % "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        letters = _byte_letters()
        self.plain = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + self.end, -1) for c in letters], np.int64)
        if min(self.plain.min(), self.last.min()) < 0:
            raise ValueError("the vocabulary lacks a byte")
        self.words: dict[str, bytes] = {}  # ids as little-endian uint32
        self.chunks: dict[str | int, bytes] = {}
        self.held = {"words": 0, "chunks": 0}  # entries, longer ones by their length

    # merging

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all bytes of the words, one after another, and where each word starts (and the last ends)."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        ids = self.plain[raw]
        ids[at[1:] - 1] = self.last[raw[at[1:] - 1]]
        return ids, at

    def merge_one(self, ids: list[int]) -> list[int]:
        """One segment tree in plain Python: O(n log n)."""
        n = len(ids)
        m = 1 << max(1, (n - 1).bit_length())
        tree = [_NONE * m] * (2 * m)
        nxt, prv, find = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.one.get

        def leaf(i: int) -> int:
            j = nxt[i]
            got = find((ids[i], ids[j])) if j < n else None
            return got[0] * m + i if got else _NONE * m

        for i in range(n):
            tree[m + i] = leaf(i)
        for i in range(m - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += m
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while tree[1] < _NONE * m:
            i = tree[1] % m
            j = nxt[i]
            ids[i] = find((ids[i], ids[j]))[1]
            ids[j] = -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            put(j, _NONE * m)
            put(i, leaf(i))
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i]))
        return [x for x in ids if x >= 0]

    def merge_rows(self, sym: np.ndarray, m: int) -> np.ndarray:
        """Segment trees of many words at once; sym: (words, m + 1), -1 where a word has ended."""
        n, far = len(sym), _NONE * m
        nxt = np.tile(np.minimum(np.arange(1, m + 2), m), (n, 1))
        prv = np.tile(np.arange(-1, m), (n, 1))
        tree = np.full((n, 2 * m), far, np.int64)

        def leaf(rows, at):
            left, right = sym[rows, at], sym[rows, nxt[rows, at]]
            slot = self.pairs.find(left, right)
            ok = (slot >= 0) & (left >= 0) & (right >= 0)
            return np.where(ok, self.pairs.rank[slot].astype(np.int64) * m + at, far)

        all_rows, all_at = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        tree[:, m:] = leaf(all_rows, all_at).reshape(n, m)
        level = m // 2
        while level:
            kids = tree[:, 2 * level : 4 * level]
            tree[:, level : 2 * level] = np.minimum(kids[:, ::2], kids[:, 1::2])
            level //= 2

        def put(rows, at, value):
            at = at + m
            tree[rows, at] = value
            while at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        rows = np.flatnonzero(tree[:, 1] < far)
        while len(rows):
            at = tree[rows, 1] % m
            gone = nxt[rows, at]
            slot = self.pairs.find(sym[rows, at], sym[rows, gone])
            sym[rows, at] = self.pairs.merged[slot]
            sym[rows, gone] = -1
            after = nxt[rows, gone]
            nxt[rows, at] = after
            prv[rows, after] = at
            put(rows, np.minimum(gone, m - 1), np.where(gone < m, far, tree[rows, 2 * m - 1]))
            put(rows, at, leaf(rows, at))
            before = prv[rows, at]
            has = before >= 0
            if has.any():
                put(rows[has], before[has], leaf(rows[has], before[has]))
            rows = rows[tree[rows, 1] < far]
        return sym

    def learn_words(self, words: list[str]) -> None:
        """Encode words that the cache lacks."""
        if not words:
            return
        ids, at = self.symbols([w.encode() for w in words])
        sizes = np.diff(at)
        for k in np.flatnonzero(sizes > SHORT):
            done = self.merge_one(ids[at[k] : at[k + 1]].tolist())
            self.words[words[k]] = struct.pack(f"<{len(done)}I", *done)
        low, m = 0, 2
        while low < SHORT:
            of = np.flatnonzero((sizes > low) & (sizes <= m))
            for k in range(0, len(of), 8192):
                some = of[k : k + 8192]
                place = np.arange(m + 1)
                inside = place < sizes[some, None]
                sym = np.where(inside, ids[np.minimum(at[some, None] + place, len(ids) - 1)], -1)
                done = self.merge_rows(sym, m)
                left = done >= 0
                flat, cut = done[left].astype("<u4").tobytes(), (4 * np.cumsum(left.sum(1))).tolist()
                self.words.update(zip([words[i] for i in some.tolist()], [flat[a:b] for a, b in zip([0, *cut], cut)]))
            low, m = m, 2 * m

    # texts

    def learn_chunks(self, chunks: set[str]) -> None:
        """Encode chunks that the cache lacks."""
        if self.held["words"] > self.most:
            self.words, self.held["words"] = {}, 0
        whole, mixed = [], []
        for c in chunks:
            low = c.lower() if c.isascii() else unicodedata.normalize("NFC", c).replace("Σ", "σ").lower()
            if low.isalpha():
                whole.append((c, low))
            else:
                mixed.append((c, _PIECES.findall(low)))
        need = {w for _, w in whole}
        need.update(*(ps for _, ps in mixed))
        need = need.difference(self.words)
        self.held["words"] += _entries(need)
        self.held["chunks"] += _entries(chunks)
        self.learn_words(list(need))
        find = self.words.__getitem__
        self.chunks.update([(c, find(w)) for c, w in whole])
        self.chunks.update([(c, b"".join(map(find, ps))) for c, ps in mixed])

    def split(self, text: str) -> list[str | int]:
        """White-space-separated chunks; ints are added tokens."""
        if self.cut is not None and "<|" in text:
            out: list[str | int] = []
            for part in self.cut.split(text):
                out += [self.added[part]] if part in self.added else _CHUNKS.findall(part)
            return out
        return _CHUNKS.findall(text) if _ODD.search(text) else text.split()

    def encode_texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian uint32, null as empty."""
        split = [self.split(t or "") for t in texts]
        if not self.chunks or self.held["chunks"] > self.most:
            self.chunks, self.held["chunks"] = {i: struct.pack("<I", i) for i in self.added.values()}, 0
        seen: set = set()
        for s in split:
            seen.update(s)
        self.learn_chunks(seen.difference(self.chunks))
        find = self.chunks.__getitem__
        for s in split:
            yield b"".join(map(find, s))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_texts([text])), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens of known ids, joined by spaces."""
        return b" ".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, added ones included; unknown ids are left out."""
        known = [self.out[i] for i in ids if 0 <= i < len(self.out) and self.out[i] is not None]
        return b" ".join(known).decode()


def _batches(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, texts) of a batch in parts of about ``most`` characters."""
    part, size, start = [], 0, 0
    for k, t in enumerate(batch.column(0)):
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size > most or k == batch.num_rows - 1:
            yield batch.slice(start, len(part)), part
            start, part, size = k + 1, [], 0


def encode_documents(docs: DataFrame, path: str, digest: bool = False, carry: tuple[str, ...] = (), cache: int = CACHE) -> DataFrame:
    """doc_id and token ids (``ids``, array of int) of every text; with ``digest``, doc_id, n_tokens,
    ids_sha256 and decoded_sha256 instead; then the columns that ``carry`` names. A worker's caches hold ``cache`` entries.

    ``path`` names a vocabulary file that the driver reads once and broadcasts (its size is fixed).
    Null and empty texts have no tokens; null ids and repeated rows stay as they are; an empty
    table gives an empty result; columns other than doc_id and text are ignored. Map-only.
    """
    spark = docs.sparkSession
    text_batches(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    wanted = (
        [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        if digest
        else [("ids", pa.list_(pa.int32()))]
    )

    def run(batches):
        bpe = Bpe(spec.value, cache)
        gc.disable()  # nothing here makes cycles, and collections would scan the caches
        try:
            yield from encoded(bpe, batches)
        finally:
            gc.enable()

    def encoded(bpe, batches):
        for batch in batches:
            for part, texts in _batches(batch):
                rows = bpe.encode_texts(texts)
                if digest:
                    done = [
                        (len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(bpe.decode_bytes(i)).hexdigest()) for i in rows
                    ]
                    cols = list(zip(*done))
                else:
                    cols = [[np.frombuffer(i, "<u4").astype(np.int32) for i in rows]]
                arrays = [part.column(1), *(pa.array(c, t) for c, (_, t) in zip(cols, wanted)), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(n for n, _ in wanted), *carry])

    schema = "doc_id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    taken = docs.select(docs["text"].cast("string"), docs["doc_id"].cast("long"), *carry)
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return spread(taken).mapInArrow(releasing(run), schema)


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text (tokens joined as the tokenizer's decode does) from doc_id and ids; null ids give empty text."""
    spark = tokens.sparkSession
    text_batches(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = Bpe(spec.value)
        for b in batches:
            texts = [bpe.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(tokens["doc_id"].cast("long"), "ids").mapInArrow(releasing(run), "doc_id long, text string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, vocabulary(), digest=True)
