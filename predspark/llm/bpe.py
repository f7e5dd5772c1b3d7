"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Unicode white space, as the tokenizers' regular expressions have it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_fine = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_coarse = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_wide_space = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_beside_space = ["  ", *(f" {c}" for c in "\t\n\v\f\r"), *(f"{c} " for c in "\t\n\v\f\r")]

#: Symbols above which a piece has merge rounds of its own, and places in a block of these.
LONG, BLOCK = 400, 256
#: Chunks that a worker remembers; it starts anew when there are more.
REMEMBERED = 300_000
#: Characters of text that are encoded at a time.
SLICE = 4_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def chunks_of(text: str) -> list[str]:
    """Cut a text where no piece crosses: before a space that has no white space beside it, or else at white space."""
    if any(x in text for x in _beside_space) or not text.isascii() and _wide_space.search(text):
        return _coarse.findall(text)
    first, *rest = text.split(" ")
    return [*([first] if first else ()), *[f" {x}" for x in rest]]


class ByteBPE:
    """A byte-level BPE tokenizer read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[p[0] + p[1]] for p in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = len(pairs)
        born = {}
        for rank, token in enumerate(made.tolist()):
            born.setdefault(token, rank)
        # a round may merge all places of a pair at once only if no pair that this makes comes before it
        if any(max(born.get(a, -1), born.get(b, -1)) >= rank for rank, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))):
            raise ValueError("merges are not listed after the merges that make their parts")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        back = {c: b for b, c in enumerate(alphabet)}
        tokens = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.added.items()}}
        spelled = [bytes(back[c] for c in tokens[i]) if i in tokens and all(c in back for c in tokens[i]) else tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self.token_len = np.array([len(x) for x in spelled], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, self.none for pairs that do not merge, and what they make."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], self.none), self.made[at]

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The merge rounds of one long piece, over linked symbols, so that a round touches only what it merges.  The
        lowest rank is found from the least of each block of BLOCK places."""
        n = len(symbols)
        size = -(-n // BLOCK) * BLOCK
        symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(size, self.none, np.int64)
        rank[: n - 1] = self._rank(symbols[:-1], symbols[1:])[0]
        blocks = rank.reshape(-1, BLOCK)
        least = blocks.min(1)
        while (low := int(least.min())) < self.none:
            own = np.flatnonzero(least == low)
            rows, places = np.nonzero(blocks[own] == low)
            at = own[rows] * BLOCK + places
            # of places that overlap, as in a run of one symbol, every second counts, from the left
            new = np.append(True, after[at[:-1]] != at[1:])
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))) % 2 == 0]
            gone = after[at]
            symbols[at] = self._rank(symbols[at], symbols[gone])[1]
            after[at] = after[gone]
            follows = after[at]
            before[follows[follows < n]] = at[follows < n]
            rank[gone] = self.none
            changed = np.unique(np.concatenate([at, before[at[before[at] >= 0]]]))
            right = after[changed]
            rank[changed] = np.where(right < n, self._rank(symbols[changed], symbols[np.minimum(right, n - 1)])[0], self.none)
            touched = np.unique(np.concatenate([own, changed // BLOCK, gone // BLOCK]))
            least[touched] = blocks[touched].min(1)
            symbols[gone] = -1
        return symbols[symbols >= 0]

    def merge_rounds(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and how many each has.  The symbols of all pieces lie in one array; each
        round finds the lowest-ranked pair of every piece by binary search over the sorted pair keys and merges it
        wherever it stands in that piece.  A round passes over all symbols of pieces that still merge, so pieces of more
        than LONG symbols have rounds of their own."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        long = {i: self._merge_long(self.byte_ids[np.frombuffer(pieces[i], np.uint8)]) for i in np.flatnonzero(lengths > LONG).tolist()}
        short = b"".join(p for p in pieces if len(p) <= LONG)
        symbols = self.byte_ids[np.frombuffer(short, np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), np.where(lengths > LONG, 0, lengths))
        done_symbols, done_owner = [], []
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], self.none)
            rank = np.append(rank, self.none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            live = np.repeat(best < self.none, sizes)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
            low = np.repeat(best, sizes)[live]
            symbols, owner, rank = symbols[live], owner[live], rank[live]
            if not len(symbols):
                break
            hit = rank == low
            # of places that overlap, as in a run of one symbol, every second counts, from the left
            spot = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit, -1, spot))
            hit &= (spot - run) % 2 == 1
            where = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[where] = self.made[np.searchsorted(self.keys, symbols[where] << 32 | symbols[where + 1])]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        for i, ids in long.items():
            done_symbols.append(ids)
            done_owner.append(np.full(len(ids), i))
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def _learn(self, new: list[str]) -> None:
        """Encode chunks that are not known yet: cut to pieces, merge the distinct pieces together, join them again."""
        pieces: dict[str, int] = {}
        cut = [[pieces.setdefault(p, len(pieces)) for p in _fine.findall(c)] for c in new]
        ids, counts = self.merge_rounds([p.encode() for p in pieces])
        starts = np.cumsum(counts) - counts
        parts = np.array([i for c in cut for i in c], np.int64)
        per = np.array([len(c) for c in cut], np.int64)
        flat = gather(ids, starts[parts], counts[parts])
        chunk_count = np.add.reduceat(np.append(counts[parts], 0), np.minimum(np.cumsum(per) - per, len(parts))) * (per > 0)
        base = len(self.at)
        self.at = np.append(self.at, len(self.flat) + np.cumsum(chunk_count) - chunk_count)
        self.count = np.append(self.count, chunk_count)
        self.flat = np.append(self.flat, flat)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        if len(self.known) > REMEMBERED:
            self._reset()
        cut: list[list[str]] = []
        for text in texts:
            if self._added is None or self._added.search(text) is None:
                cut.append(chunks_of(text))
                continue
            own, at = [], 0
            for m in self._added.finditer(text):
                own += [*chunks_of(text[at : m.start()]), f"\0{m[0]}"]
                at = m.end()
            cut.append(own + chunks_of(text[at:]))
        known = self.known
        new = {c for own in cut for c in own if c not in known}
        if special := [c for c in new if c[:1] == "\0" and c[1:] in self.added]:
            for c in special:
                new.discard(c)
                known[c] = len(self.at)
                self.at, self.count, self.flat = np.append(self.at, len(self.flat)), np.append(self.count, 1), np.append(self.flat, np.int32(self.added[c[1:]]))
        if new:
            self._learn(sorted(new))
        chunks = np.fromiter((known[c] for own in cut for c in own), np.int64, sum(map(len, cut)))
        counts = self.count[chunks]
        ends = np.cumsum([len(own) for own in cut])
        total = np.append(0, np.cumsum(counts))
        return gather(self.flat, self.at[chunks], counts), np.diff(np.append(0, total[ends]))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids end to end; bytes that are not UTF-8 become U+FFFD."""
        sizes = self.token_len[ids]
        raw = gather(self.token_bytes, self.token_at[ids], sizes).tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each s, n, end to end."""
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return flat[shift + np.arange(len(shift))]


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def slices(texts: list[str], most: int = SLICE) -> Iterator[slice]:
    """Consecutive slices of about `most` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again: doc_id, ids (array of int), decoded.

    The file at tokenizer_path must be readable on every executor.  No shuffle: each task encodes its texts in slices
    and remembers chunks up to a bound.  Defined cases: a null or empty text has no ids and decodes to ''; null and
    repeated doc_ids and repeated rows are encoded each; an empty table gives an empty result; other columns are
    ignored; added tokens in a text become their own ids."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                ids, counts = bpe.encode(texts[part])
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], lists, pa.array(bpe.decode(ids, counts), pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
