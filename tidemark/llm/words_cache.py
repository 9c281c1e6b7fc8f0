"""Encoding texts word by word where the tokenizer's own cuts make words independent of each other.

A tokenizer that never joins across some boundary gives a text the ids of its parts, one after the other. Parts recur,
so each distinct one is encoded by the library once as long as the cache holds it. The cache is bounded and per worker process: it
has two generations, and what was not asked for during a whole generation goes.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.memory import give_back

MOST_ENTRIES = 1 << 18  # of one generation
LONGEST_KEPT = 64
JOINED = 256


@lru_cache(maxsize=1)
def live_caches() -> WeakSet[WordCache]:
    """The caches of this worker process."""
    return WeakSet()


# Functions, cached by lru_cache, that hold the models of this worker process.
MODEL_LOADERS: list[Callable] = []


def release_caches() -> None:
    """Give back what the tokenizers of earlier stages hold and what earlier tasks have freed: a worker goes on with the
    tasks of other operators.

    A cache that is asked again fills again, a model is built again.
    """
    held = [cache for cache in live_caches() if cache.known or cache.older]
    models = [load for load in MODEL_LOADERS if load.cache_info().currsize]
    for cache in held:
        cache.clear()
    for load in models:
        load.cache_clear()
    if models:
        gc.collect()  # a backend and its cache refer to each other
    give_back()


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work of a task, begun without what earlier operators left in its worker; it leaves no freed memory there."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


class WordCache:
    """`encode` gives the ids of many strings; every part stands for `lead` + part.

    New parts are handed to the library many at a time, joined. `opens[id]` says whether an id's text begins with the
    lead; a part without a lead inside has exactly one such id, its first, so the joined ids fall apart again there.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], list[list[int]]],
        lead: str,
        opens: np.ndarray,
        returns: Callable[[list[str], list[list[int]]], list[bool]] | None = None,
    ):
        """`returns` says of new parts whether decoding their ids gives the part back; `lossy` has those for which it does not."""
        self.encode, self.lead, self.opens, self.returns = encode, lead, opens, returns
        self.clear()
        live_caches().add(self)

    def clear(self) -> None:
        self.lossy: set[str] = set()
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        self.older: dict[str, bytes] = {}

    def _new(self, parts: list[str]) -> None:
        plain = [p for p in parts if p and self.lead not in p]
        runs = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        for run, ids in zip(runs, self.encode([self.lead + self.lead.join(run) for run in runs]), strict=True):
            numbers = np.array(ids, "<u4")
            at = np.flatnonzero(self.opens[numbers])
            if len(at) != len(run) or at[0] != 0:
                raise ValueError("a word does not begin where the tokenizer should begin it")
            if self.returns and not self.returns([self.lead + self.lead.join(run)], [ids])[0]:
                pieces = [ids[a:b] for a, b in zip(at.tolist(), [*at.tolist()[1:], len(ids)], strict=True)]
                good = self.returns([self.lead + p for p in run], pieces)
                self.lossy.update(p for p, same in zip(run, good, strict=True) if not same)
            raw, starts = numbers.tobytes(), (4 * at).tolist()
            self.known.update(zip(run, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)])), strict=True))
        odd = [p for p in parts if not p or self.lead in p]
        found = self.encode([self.lead + p for p in odd])
        if self.returns and odd:
            good = self.returns([self.lead + p for p in odd], found)
            self.lossy.update(p for p, same in zip(odd, good, strict=True) if not same)
        for part, ids in zip(odd, found, strict=True):
            self.known[part] = np.array(ids, "<u4").tobytes()

    def _fetch(self, wanted: set[str]) -> None:
        """Have all these parts in `known`."""
        if len(self.lossy) > MOST_ENTRIES:  # what is forgotten here has to be met as new again
            self.clear()
        missing = wanted.difference(self.known)
        if missing:
            older = self.older
            met = missing.intersection(older)
            self.known.update((part, older[part]) for part in met)
            self._new(list(missing - met if met else missing))

    def _forget(self, long: list[str]) -> None:
        for part in long:
            self.known.pop(part, None)
        if len(self.known) > MOST_ENTRIES:
            self.older, self.known = self.known, {}

    def raw(self, texts: list[list[str]], tail: bytes = b"") -> list[bytes]:
        """The ids of each text from its parts, then `tail`, as little-endian 32-bit numbers."""
        wanted = set().union(*texts)
        self._fetch(wanted)
        found = [b"".join([*map(self.known.__getitem__, parts), tail]) for parts in texts]
        self._forget([part for part in wanted if len(part) > LONGEST_KEPT])
        return found

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of many words one after the other, how many each word has, and which words do not come back.

        Arrow finds the distinct words; only those are looked up one by one.
        """
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._fetch(set(distinct))
        raw = list(map(self.known.__getitem__, distinct))
        self._forget(coded.dictionary.filter(pc.greater(pc.binary_length(coded.dictionary), LONGEST_KEPT)).to_pylist())
        flat = np.frombuffer(b"".join(raw), "<u4")
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        counts = size[at]
        ends = np.cumsum(counts)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - (ends - counts), counts)
        lossy = np.zeros(len(distinct), bool)
        if self.lossy:
            lossy = np.fromiter(map(self.lossy.__contains__, distinct), bool, len(distinct))
        return flat[index], counts, lossy[at]


def split_at_blanks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All parts between single blanks of many texts as one Arrow column, and the number of parts of each text."""
    blank = data == 32
    places = np.flatnonzero(blank)
    parts = np.diff(np.searchsorted(places, offsets)) + 1
    # A part ends at its blank or where its text ends; what stands between are the bytes without blanks.
    ends = np.sort(np.concatenate([places, offsets[1:]]), kind="stable")
    bounds = ends - np.searchsorted(places, ends)
    content = data[~blank]
    buffers = [None, pa.py_buffer(np.concatenate([[0], bounds]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(content))]
    return pa.Array.from_buffers(pa.string(), len(bounds), buffers), parts


# A blank that white space or the end of the text follows.
_INNER = re.compile(r" (?:\s|$)")


def parts_before_words(text: str) -> list[str]:
    """Split at every blank that a character other than white space follows; the blank is dropped.

    Other blanks stay in the part before. So a text is parts[0], then blank + part for each further one.
    """
    parts = text.split(" ")
    if len(parts) == 1 or not _INNER.search(text):
        return parts
    merged = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            merged.append(part)
        else:
            merged[-1] += " " + part
    return merged


# Bytes that begin white space beyond ASCII; other characters begin with some of them too.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True


def cut_at_every_blank(data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> np.ndarray:
    """Texts of which `parts_before_words` gives exactly the parts between blanks."""
    plain = np.ones(len(texts), bool)
    blanks = np.flatnonzero(data == 32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.append(data, np.uint8(32))[blanks + 1]
    text = np.searchsorted(offsets, blanks, "right") - 1
    plain[text[edge[blanks + 1] | _SPACE[after]]] = False
    for k in np.unique(text[_MAYBE_SPACE[after]]).tolist():
        if plain[k] and _INNER.search(texts[k]):
            plain[k] = False
    return plain
