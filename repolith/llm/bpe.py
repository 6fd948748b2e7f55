"""Encoding of whole text columns with a public byte-level BPE vocabulary.

Every Arrow batch is one unit: its distinct pre-tokens are laid out as one array of byte symbols, an index maps each
pair of neighbouring symbols to all its positions, and the active merge ranks are applied in ascending order, each over
all its positions at once; a merge only touches the index entries of its two neighbours. Texts are never cut, and work
stays inside the scan's partitions: there is no shuffle and nothing reaches the driver.

Results: a null and an empty text give an empty list; spellings of special tokens are ordinary text; repeated texts and
rows are encoded row by row. Extra columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Characters that are split and merged together; bounds the pre-tokens held at once. A longer text is a unit of its own.
UNIT_CHARS = 2_000_000
#: Distinct pre-tokens whose ids a worker keeps between units; the memory's bound, results don't depend on it.
KEPT_WORDS = 300_000


LETTER, NUMBER, BLANK = 1, 2, 3


def _classes() -> np.ndarray:
    """Letter, number, blank or other (0) of each code point."""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    table = np.zeros(0x110000, dtype=np.uint8)
    for kind, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(prop, every):
            table[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = kind
    return table


def pretoken_starts(codes: np.ndarray, kinds: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts that lie one after another: runs of one kind take a space before them along,
    the last blank of a run stands alone unless it is such a space, and an apostrophe takes an English ending along."""
    n = len(codes)
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = kinds[1:] != kinds[:-1]
    edge[text_starts] = True
    edge[n] = True
    first = edge.copy()
    runs = np.nonzero(edge)[0]
    new_text = np.zeros(n + 1, dtype=bool)
    new_text[text_starts] = True
    new_text[n] = True
    inner = runs[(runs > 0) & ~new_text[runs]]  # starts of runs that follow another run of their text
    after_blank = inner[kinds[inner - 1] == BLANK]
    first[after_blank - 1] = True  # the last blank of the run before
    spaced = codes[after_blank - 1] == 0x20
    first[after_blank[spaced]] = False

    quote = np.nonzero(codes[:-1] == 0x27)[0]
    quote = quote[first[quote] & edge[quote + 1] & ~new_text[quote + 1] & (kinds[quote + 1] == LETTER) & (kinds[quote] == 0) & edge[quote]]
    if len(quote):
        a = codes[quote + 1]
        b = codes[np.minimum(quote + 2, n - 1)]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (quote + 2 < n) & ~new_text[np.minimum(quote + 2, n)]
        first[quote[two | three] + 1] = False
        first[quote[two] + 2] = True
        first[quote[three] + 3] = True
    return np.nonzero(first[:n])[0]


def _byte_symbols() -> dict[int, str]:
    """Printable stand-ins of bytes in the vocabulary file: printable Latin-1 stays, the rest is moved up from 256 on."""
    kept = {b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)}
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}


class PairIndexEncoder:
    """Byte-level BPE over many words at once by an index from merge rank to positions."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.symbol_of_byte = np.array([vocab[s] for _, s in sorted(_byte_symbols().items())], dtype=np.int64)
        self.pair = [(vocab[a], vocab[b]) for a, b in merges]
        self.merged = [vocab[a + b] for a, b in merges]
        self.rank = {(a << 32) | b: k for k, (a, b) in enumerate(self.pair)}
        byte_of_symbol = {int(s): b for b, s in enumerate(self.symbol_of_byte)}
        self.byte_rank = np.full((256, 256), -1, dtype=np.int64)
        for k, (a, b) in enumerate(self.pair):
            if a in byte_of_symbol and b in byte_of_symbol:
                self.byte_rank[byte_of_symbol[a], byte_of_symbol[b]] = k
        self.kinds = _classes()
        self.known: dict[str, bytes] = {}

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes of 32-bit integers."""
        if not words:
            return []
        coded = [w.encode("utf-8", "replace") for w in words]
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)))
        first = self.byte_rank[raw[:-1], raw[1:]]
        first[ends[:-1] - 1] = -1  # no pair crosses two words
        at = np.nonzero(first >= 0)[0]
        order = np.argsort(first[at], kind="stable")
        ranks, starts = np.unique(first[at][order], return_index=True)
        places = dict(zip(ranks.tolist(), (x.tolist() for x in np.split(at[order], starts[1:])), strict=True)) if len(at) else {}

        n = len(raw)
        symbol = self.symbol_of_byte[raw].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends.tolist():
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        rank, pair, merged = self.rank, self.pair, self.merged
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right = pair[r]
            new = merged[r]
            spots = places.pop(r)
            spots.sort()
            for p in spots:
                if symbol[p] != left:
                    continue
                q = after[p]
                if q < 0 or symbol[q] != right:
                    continue
                symbol[p], symbol[q] = new, -1
                s = after[p] = after[q]
                if s >= 0:
                    before[s] = p
                    k = rank.get((new << 32) | symbol[s])
                    if k is not None:
                        if k in places:
                            places[k].append(p)
                        else:
                            places[k] = [p]
                            heapq.heappush(active, k)
                o = before[p]
                if o >= 0:
                    k = rank.get((symbol[o] << 32) | new)
                    if k is not None:
                        if k in places:
                            places[k].append(o)
                        else:
                            places[k] = [o]
                            heapq.heappush(active, k)
        left_over = np.array(symbol, dtype=np.int32)
        ids = left_over[left_over >= 0]
        bounds = np.concatenate([[0], np.cumsum(left_over >= 0)[ends - 1]]).tolist()
        packed = ids.tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        whole = "".join(texts)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        if not whole:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int32)
        codes = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)
        text_ends = np.cumsum(lengths)
        starts = pretoken_starts(codes, self.kinds[codes], (text_ends - lengths)[lengths > 0])
        cuts = starts.tolist()
        words = [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)], strict=True)]
        known = self.known
        new = list({w: None for w in words if w not in known})
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list(dict.fromkeys(words))
        known.update(zip(new, self.merge_words(new), strict=True))
        coded = list(map(known.__getitem__, words))
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4)])
        bounds = sums[np.searchsorted(starts, np.concatenate([[0], text_ends]))]
        return np.frombuffer(b"".join(coded), dtype=np.int32), np.diff(bounds).astype(np.int32)


_encoders: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    """One encoder for each Python worker; workers are reused between tasks."""
    if path not in _encoders:
        _encoders[path] = PairIndexEncoder(path)
    return _encoders[path]


def _units(texts: list[str]) -> Iterator[list[str]]:
    unit: list[str] = []
    held = 0
    for t in texts:
        unit.append(t)
        held += len(t)
        if held >= UNIT_CHARS:
            yield unit
            unit, held = [], 0
    if unit:
        yield unit


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids array<int>) for each row of df, by the vocabulary file `folder`/`vocabulary`.json."""
    path = f"{folder}/{vocabulary}.json"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = 0
            for unit in _units(texts):
                ids, sizes = own.encode(unit)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(unit)), lists], names=[key, "ids"])
                done += len(unit)

    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
